"""Record formats between the stages: delimited text, nested JSON, flat JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace import schemas
from dialtrace.functions.text import all_digits, empty_to_null, payload_bytes, printable
from dialtrace.functions.time import ns_to_seconds_text
from dialtrace.operators.headers import header_block, last_via, sdp_codecs
from dialtrace.operators.validate import FLAT_REPORT, flat_malformed_reasons


# fixed value: timestamp, source, target and payload of a delimited line
TEXT_WIRE = r"^(?:[0-9]{1,18}|[1-8][0-9]{18})\|[0-9]{1,10}:[0-9]{1,5}\|[0-9]{1,10}:[0-9]{1,5}\|[0-9]{1,9}:[^:]*$"


def read_text_wire(lines: DataFrame, value: str = "value") -> DataFrame:
    """Packets of the ``ts|src:port|dst:port|offset:hex`` lines; this form carries IPv4 only.

    The form is tested by one pattern on the raw line, so no field is cut out of a
    line that is dropped.
    """
    fields = F.split(F.col(value), r"\|", 4)
    rest = [c for c in lines.columns if c != value]
    pieces = lines.where(F.col(value).rlike(TEXT_WIRE)).select(
        *rest, *[fields[i].alias(name) for i, name in enumerate(("_ts", "_src", "_dst", "_body"))]
    )

    def part(field: str, position: int, kind: str) -> Column:
        return F.split_part(F.col(field), F.lit(":"), F.lit(position)).cast(kind)

    return pieces.select(
        *rest,
        F.col("_ts").cast("bigint").alias("timestamp_ns"),
        part("_src", 1, "bigint").alias("src_ip"),
        part("_src", 2, "int").alias("src_port"),
        part("_dst", 1, "bigint").alias("dst_ip"),
        part("_dst", 2, "int").alias("dst_port"),
        F.lit(4).alias("ip_version"),
        part("_body", 1, "int").alias("payload_offset"),
        F.substring_index("_body", ":", -1).alias("pkt_hex"),
    ).withColumn("len", F.call_function("div", F.length("pkt_hex"), F.lit(2)).cast("int"))


def text_wire_rejects(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(~F.coalesce(F.col(value).rlike(TEXT_WIRE), F.lit(False)))


def envelope(parsed: DataFrame) -> Column:
    """Nested envelope of a parsed message; code 0 stands for a request."""
    return F.struct(
        "timestamp_ns",
        F.struct(
            F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")).alias("src"),
            F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("dst"),
            F.col("payload_offset"),
        ).alias("ip"),
        F.struct(
            F.col("callid").alias("call_id"),
            F.col("`to`"),
            F.col("`from`"),
            F.col("request_method").alias("sip_method"),
            F.coalesce("response_code", F.lit(0)).alias("status_code"),
            F.col("callid_rc").alias("rc_session_id"),
            F.col("user_agent").alias("ua"),
            "maxfwd",
            "cseq",
        ).alias("sip"),
        F.struct(F.col("pkt_hex").alias("pkt")).alias("raw"),
    )


def encode_envelope(parsed: DataFrame) -> DataFrame:
    return parsed.select("pkt_id", F.to_json(envelope(parsed), {"ignoreNullFields": "false"}).alias("value"))


def _decoded(records: DataFrame, value: str) -> DataFrame:
    """Envelope columns and ``_corrupt`` next to the raw record.

    The one-element array makes each record decode once: the filters on the result
    stay behind it and are not turned into decodings of their own.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    decoded = F.from_json(value, f"{schemas.ENVELOPE}, _corrupt STRING", options)
    return records.select("*", F.inline(F.array(decoded)))


def _undecodable() -> Column:
    return F.col("_corrupt").isNotNull() | (F.col("raw").isNull() & F.col("sip").isNull())


def decode_envelope(records: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns (``timestamp_ns``, ``ip``, ``sip``, ``raw``) of the records that decode."""
    return _decoded(records, value).where(~_undecodable()).drop(value, "_corrupt")


def envelope_rejects(records: DataFrame, value: str = "value") -> DataFrame:
    return _decoded(records, value).where(_undecodable()).select(*records.columns)


def parsed_from_envelope(envelopes: DataFrame) -> DataFrame:
    """Decoded envelopes as parsed-message columns, ready for validation and storage."""
    text = payload_bytes(F.col("raw.pkt"), F.col("ip.payload_offset")).cast("string")
    return (
        envelopes.withColumn("_raw", text)
        .withColumns({"utf8_ok": F.is_valid_utf8("_raw"), "text": F.make_valid_utf8("_raw")})
        .select(
            "pkt_id",
            "timestamp_ns",
            F.col("ip.src.ip").alias("src_ip"),
            F.col("ip.src.port").alias("src_port"),
            F.col("ip.dst.ip").alias("dst_ip"),
            F.col("ip.dst.port").alias("dst_port"),
            F.col("ip.payload_offset").alias("payload_offset"),
            F.col("raw.pkt").alias("pkt_hex"),
            "utf8_ok",
            "text",
            header_block(F.col("text")).alias("head"),
            empty_to_null(F.col("sip.call_id")).alias("callid"),
            empty_to_null(F.col("sip.`to`")).alias("to"),
            empty_to_null(F.col("sip.`from`")).alias("from"),
            empty_to_null(F.col("sip.sip_method")).alias("request_method"),
            F.nullif(F.col("sip.status_code"), F.lit(0)).alias("response_code"),
            empty_to_null(F.col("sip.rc_session_id")).alias("callid_rc"),
            empty_to_null(F.col("sip.ua")).alias("user_agent"),
            F.col("sip.maxfwd").alias("maxfwd"),
            F.when(
                F.col("sip.cseq").isNotNull(),
                F.struct(
                    empty_to_null(F.col("sip.cseq.number")).alias("number"),
                    empty_to_null(F.col("sip.cseq.method")).alias("method"),
                ),
            ).alias("cseq"),
        )
    )


def encode_flat_envelope(parsed: DataFrame) -> DataFrame:
    """Flat envelope of parsed messages (Call-ID with host), with the report of a malformed one."""
    reasons = flat_malformed_reasons()
    text = F.col("text")
    data = F.struct(
        F.col("src_ip").cast("string").alias("source_ip"),
        F.col("src_port").cast("string").alias("source_port"),
        F.col("dst_ip").cast("string").alias("destination_ip"),
        F.col("dst_port").cast("string").alias("destination_port"),
        F.col("`from`"),
        F.col("`to`"),
        "callid",
        "callid_rc",
        "request_method",
        F.col("response_code").cast("string").alias("response_code"),
        "user_agent",
        F.concat(F.col("cseq.number"), F.lit(" "), F.col("cseq.method")).alias("cseq"),
        F.when(all_digits(F.col("maxfwd")), F.col("maxfwd")).alias("maxfwd"),
        last_via(F.col("head")).alias("via"),
        sdp_codecs(text).alias("enc_name"),
        ns_to_seconds_text(F.col("timestamp_ns")).alias("micro_ts"),
        printable(text).alias("msg"),
    )
    report = F.when(F.col("reasons") != "", F.format_string(FLAT_REPORT, "reasons", "pkt_hex"))
    return (
        parsed.withColumn("reasons", reasons)
        .select("pkt_id", data.alias("data"), report.alias("malformed_data"))
        .select("pkt_id", F.to_json(F.struct("data", "malformed_data"), {"ignoreNullFields": "false"}).alias("value"))
    )


