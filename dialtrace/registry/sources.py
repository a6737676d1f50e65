"""Queries for sources and sinks: what was written is read back."""

from pyspark.sql import functions as F

from dialtrace import schemas
from dialtrace.operators import counters
from dialtrace.operators.headers import METHODS, parse, with_headers
from dialtrace.operators.validate import accepted, with_malformed
from dialtrace.plans.ingest import capture_rows, to_capture, to_sdp
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query
from dialtrace.registry.headers import decoded, parsed
from dialtrace.session import work_dir
from dialtrace.sources import pcap, records, tables
from dialtrace.registry.wire import text_wire
from dialtrace.streaming import ingest as stream

_PACKET = "pkt_id, timestamp_ns, src_ip, src_port, dst_ip, dst_port, ip_version, payload_offset, len, pkt_hex"


@query("packet_scan", oracle.on("packets", f"SELECT {_PACKET} FROM packets"))
def packet_scan(spark, sf_dir):
    return inputs.packets(spark, sf_dir)


@query(
    "text_wire_scan",
    oracle.on(
        "packets",
        "SELECT pkt_id, timestamp_ns, src_ip, src_port, dst_ip, dst_port, payload_offset, "
        "CAST(length(pkt_hex) / 2 AS INTEGER) AS len, pkt_hex FROM packets WHERE pkt_id % 101 <> 0",
    ),
)
def text_wire_scan(spark, sf_dir):
    return records.read_text_wire(text_wire(inputs.packets(spark, sf_dir))).drop("ip_version")


@query(
    "text_wire_rejects",
    oracle.on(
        "packets",
        "SELECT pkt_id, timestamp_ns || '|' || src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port AS value "
        "FROM packets WHERE pkt_id % 101 = 0",
    ),
)
def text_wire_rejects(spark, sf_dir):
    return records.text_wire_rejects(text_wire(inputs.packets(spark, sf_dir)))


ENVELOPE = """to_json({'timestamp_ns': timestamp_ns,
  'ip': {'src': {'ip': src_ip, 'port': src_port}, 'dst': {'ip': dst_ip, 'port': dst_port}, 'payload_offset': payload_offset},
  'sip': {'call_id': callid, 'to': "to", 'from': "from", 'sip_method': request_method, 'status_code': coalesce(response_code, 0),
    'rc_session_id': callid_rc, 'ua': user_agent, 'maxfwd': maxfwd, 'cseq': {'number': cseq_number, 'method': cseq_method}},
  'raw': {'pkt': pkt_hex}})::VARCHAR"""


@query("envelope_encode", oracle.on("parsed", f"SELECT pkt_id, {ENVELOPE} AS value FROM parsed"))
def envelope_encode(spark, sf_dir):
    return records.encode_envelope(parsed(spark, sf_dir))


def envelopes(spark, sf_dir):
    """Stored envelope records, as a message log holds them."""

    def write(path):
        records.encode_envelope(parsed(spark, sf_dir)).write.parquet(path)

    return spark.read.schema("pkt_id BIGINT, value STRING").parquet(inputs.stored(spark, sf_dir, "envelopes", write))


def _damaged(spark, sf_dir):
    """Envelopes, every 103rd cut to half its length."""
    cut = F.substr("value", F.lit(1), F.call_function("div", F.length("value"), F.lit(2)).cast("int"))
    return envelopes(spark, sf_dir).select(
        "pkt_id", F.when(F.col("pkt_id") % 103 == 0, cut).otherwise(F.col("value")).alias("value")
    )


@query(
    "envelope_decode",
    oracle.on(
        "parsed",
        """SELECT pkt_id, timestamp_ns, src_ip, src_port, dst_ip, dst_port, payload_offset, callid AS call_id, "to" AS to_user,
        "from" AS from_user, request_method AS sip_method, coalesce(response_code, 0) AS status_code, callid_rc AS rc_session_id,
        user_agent AS ua, maxfwd, cseq_number, cseq_method, pkt_hex AS pkt FROM parsed WHERE pkt_id % 103 <> 0""",
    ),
)
def envelope_decode(spark, sf_dir):
    return records.decode_envelope(_damaged(spark, sf_dir)).select(
        "pkt_id",
        "timestamp_ns",
        F.col("ip.src.ip").alias("src_ip"),
        F.col("ip.src.port").alias("src_port"),
        F.col("ip.dst.ip").alias("dst_ip"),
        F.col("ip.dst.port").alias("dst_port"),
        "ip.payload_offset",
        "sip.call_id",
        F.col("sip.`to`").alias("to_user"),
        F.col("sip.`from`").alias("from_user"),
        "sip.sip_method",
        "sip.status_code",
        "sip.rc_session_id",
        "sip.ua",
        "sip.maxfwd",
        F.col("sip.cseq.number").alias("cseq_number"),
        F.col("sip.cseq.method").alias("cseq_method"),
        "raw.pkt",
    )


@query(
    "envelope_rejects",
    oracle.on("parsed", f"SELECT pkt_id, left(value, length(value) // 2) AS value FROM (SELECT pkt_id, {ENVELOPE} AS value FROM parsed WHERE pkt_id % 103 = 0)"),
)
def envelope_rejects(spark, sf_dir):
    return records.envelope_rejects(_damaged(spark, sf_dir))


@query("capture_from_envelopes", oracle.on("capture", "SELECT * FROM capture"))
def capture_from_envelopes(spark, sf_dir):
    """Capture rows by way of the nested envelope."""
    decoded_records = records.decode_envelope(envelopes(spark, sf_dir))
    return capture_rows(with_malformed(records.parsed_from_envelope(decoded_records)))


FLAT_REASONS = r"""(CASE WHEN NOT utf8_ok THEN ' include non UTF8 symbols in payload_data |' ELSE '' END ||
  CASE WHEN callid IS NULL OR "from" IS NULL OR "to" IS NULL OR cseq_number IS NULL OR cseq_method IS NULL
    OR NOT contains(text, 'Via: ') THEN ' required headers is None or empty |' ELSE '' END ||
  CASE WHEN contains(text, 'User-Agent: ' || chr(13)) THEN ' user agent defined but empty |' ELSE '' END ||
  CASE WHEN request_method IS NOT NULL AND coalesce(maxfwd, '') = '' THEN ' Max-Forwards header required for SIP requests |' ELSE '' END)"""


@query(
    "flat_envelope_encode",
    oracle.on(
        "parsed",
        rf"""SELECT pkt_id, to_json({{'data': {{'source_ip': src_ip::VARCHAR, 'source_port': src_port::VARCHAR,
          'destination_ip': dst_ip::VARCHAR, 'destination_port': dst_port::VARCHAR, 'from': "from", 'to': "to",
          'callid': callid || '@pbx.example.com', 'callid_rc': callid_rc, 'request_method': request_method,
          'response_code': response_code::VARCHAR, 'user_agent': user_agent, 'cseq': cseq_number || ' ' || cseq_method,
          'maxfwd': nullif(maxfwd, ''), 'via': regexp_extract(text, '\nVia: ([^\r\n]*)', 1),
          'enc_name': regexp_extract_all(text, '\na=rtpmap:\d+ ([\w-]+)/\d+', 1),
          'micro_ts': (timestamp_ns // 1000000000)::VARCHAR || '.' || lpad((timestamp_ns // 1000 % 1000000)::VARCHAR, 6, '0'),
          'msg': replace(text, chr(65533), '')}},
          'malformed_data': CASE WHEN {FLAT_REASONS} <> '' THEN 'Malformed reason: ' || {FLAT_REASONS} || ' ' || chr(10) || 'Data: ' || chr(10) || pkt_hex END
        }})::VARCHAR AS value FROM parsed""",
    ),
)
def flat_envelope_encode(spark, sf_dir):
    return records.encode_flat_envelope(with_headers(decoded(spark, sf_dir), keep_host=True))


@query("capture_append", oracle.on("capture", "SELECT *, CAST(datetime AS DATE) AS date FROM capture"))
def capture_append(spark, sf_dir):
    """Parse, validate and store all packets, then read the table back."""
    path = work_dir(spark, "appended")
    tables.append_capture(to_capture(inputs.packets(spark, sf_dir)), path)
    return tables.read_capture(spark, path)


@query(
    "sdp_append",
    oracle.on("sdp", "SELECT s.id, s.codec, CAST(c.datetime AS DATE) AS date FROM sdp s JOIN capture c ON c.id = s.id"),
)
def sdp_append(spark, sf_dir):
    path = work_dir(spark, "appended-sdp")
    tables.append_sdp(to_sdp(inputs.packets(spark, sf_dir)), path)
    return tables.read_sdp(spark, path)


@query(
    "capture_scan",
    oracle.on(
        "capture",
        "SELECT id, datetime, callid, request_method FROM capture WHERE request_method = 'INVITE' AND malformed = 0",
    ),
)
def capture_scan(spark, sf_dir):
    df = inputs.capture(spark, sf_dir).where((F.col("request_method") == "INVITE") & (F.col("malformed") == 0))
    return df.select("id", "datetime", "callid", "request_method")


def _savefiles(spark, sf_dir):
    return inputs.stored(
        spark, sf_dir, "savefiles", lambda path: pcap.write_savefiles(inputs.packets(spark, sf_dir), path)
    )


@query(
    "pcap_dump",
    oracle.on(
        "packets",
        """SELECT CAST(count(*) AS BIGINT) AS packets,
        CAST(sum(16 + (CASE ip_version WHEN 4 THEN 42 ELSE 62 END) + (length(pkt_hex) // 2 - payload_offset)) AS BIGINT) AS record_bytes FROM packets""",
    ),
)
def pcap_dump(spark, sf_dir):
    """Sizes of the files written, less their file headers, next to the packets read back."""
    path = _savefiles(spark, sf_dir)
    files = spark.read.format("binaryFile").load(path).select("length")
    sizes = files.agg(F.sum(F.col("length") - pcap.FILE_HEADER).alias("record_bytes"))
    return pcap.read_savefiles(spark, path).agg(F.count(F.lit(1)).alias("packets")).withColumn(
        "record_bytes", sizes.scalar()
    )


@query(
    "pcap_scan",
    oracle.on(
        "packets",
        """SELECT timestamp_ns, CASE ip_version WHEN 4 THEN src_ip END AS src_ip, src_port, CASE ip_version WHEN 4 THEN dst_ip END AS dst_ip,
        dst_port, ip_version, CAST(CASE ip_version WHEN 4 THEN 42 ELSE 62 END AS INTEGER) AS payload_offset,
        CAST((CASE ip_version WHEN 4 THEN 42 ELSE 62 END) + length(pkt_hex) // 2 - payload_offset AS INTEGER) AS len,
        substr(pkt_hex, payload_offset * 2 + 1) AS payload FROM packets""",
    ),
)
def pcap_scan(spark, sf_dir):
    df = pcap.read_savefiles(spark, _savefiles(spark, sf_dir), split_bytes=1 << 16)
    payload = F.substr(F.col("pkt_hex"), F.col("payload_offset") * 2 + 1)
    return df.withColumn("payload", payload).drop("pkt_hex")


def _savefile_index(spark, sf_dir):
    """Index of savefiles of the packets that go to the parser, in many runs."""
    path = inputs.stored(spark, sf_dir, "accepted-savefiles", lambda path: pcap.write_savefiles(accepted(inputs.packets(spark, sf_dir)), path))
    return pcap.index_savefiles(spark, path, split_bytes=1 << 16)


@query("pcap_to_capture", oracle.on("capture", "SELECT * EXCLUDE (id) REPLACE (split_part(msg, 'RAW PACKET:', 1) AS msg) FROM capture"))
def pcap_to_capture(spark, sf_dir):
    """Savefiles to capture rows.

    Ids count the packets in order of the files, so they are checked by themselves. The
    frame in a report has the link and address headers of the savefile, which the writer
    builds anew, so reports are compared up to it.
    """
    rows = to_capture(pcap.indexed_packets(_savefile_index(spark, sf_dir))).drop("id")
    return rows.withColumn("msg", F.substring_index("msg", "RAW PACKET:", 1))


@query(
    "pcap_packet_ids",
    oracle.on("capture", """SELECT CAST(count(*) AS BIGINT) AS packets, CAST(count(*) AS BIGINT) AS different, CAST(1 AS BIGINT) AS least,
        CAST(count(*) AS BIGINT) AS most FROM capture"""),
)
def pcap_packet_ids(spark, sf_dir):
    packets = pcap.indexed_packets(_savefile_index(spark, sf_dir))
    return packets.agg(
        F.count(F.lit(1)).alias("packets"), F.countDistinct("pkt_id").alias("different"), F.min("pkt_id").alias("least"), F.max("pkt_id").alias("most")
    )


@query(
    "pcap_time_range",
    oracle.on(
        "packets",
        """SELECT timestamp_ns, src_ip, src_port, dst_ip, dst_port, substr(pkt_hex, payload_offset * 2 + 1) AS payload
        FROM sound, span WHERE timestamp_ns BETWEEN least + size // 4 AND least + size // 2""",
        "sound AS (SELECT * FROM packets WHERE ip_version = 4 AND payload_offset < len AND length(pkt_hex) = 2 * len)",
        "span AS (SELECT min(timestamp_ns) AS least, max(timestamp_ns) - min(timestamp_ns) AS size FROM sound)",
    ),
)
def pcap_time_range(spark, sf_dir):
    """The packets of the second quarter of the time that the index spans."""
    index = _savefile_index(spark, sf_dir)
    least, most = index.agg(F.min("least_ns"), F.max("most_ns")).first()
    found = pcap.indexed_packets(index, least + (most - least) // 4, least + (most - least) // 2)
    payload = F.substr(F.col("pkt_hex"), F.col("payload_offset") * 2 + 1).alias("payload")
    return found.select("timestamp_ns", "src_ip", "src_port", "dst_ip", "dst_port", payload)


@query("message_publish", oracle.on("parsed", f"SELECT {ENVELOPE} AS value FROM parsed"))
def message_publish(spark, sf_dir):
    path = work_dir(spark, "published")
    packets = tables.stream_packets(spark, inputs.packet_path(spark, sf_dir))
    messages = records.encode_envelope(parse(accepted(packets)))
    stream.publish(messages, path, work_dir(spark, "publish-checkpoint")).awaitTermination()
    return spark.read.text(path)


def metric_path(spark, sf_dir):
    """Running traffic gauges per second and channel, written as METRIC rows."""

    def write(path):
        gauges = counters.running(counters.per_second(inputs.packets(spark, sf_dir)), ["packets", "bytes"])
        counters.as_metrics(gauges, "capture", ["packets", "bytes"]).write.mode("append").parquet(path)

    return inputs.stored(spark, sf_dir, "metrics", write)


def metrics(spark, sf_dir):
    return spark.read.schema(schemas.METRIC).parquet(metric_path(spark, sf_dir))


SECONDS = """seconds AS (
  SELECT date_trunc('second', make_timestamp(timestamp_ns // 1000)) AS ts, 'ch' || ((src_ip + src_port + dst_ip + dst_port) % 4)::VARCHAR AS sensor,
    CAST(count(*) AS BIGINT) AS packets, CAST(sum(len + 24) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2
)"""
RUNNING = """running AS (
  SELECT ts, sensor, CAST(sum(packets) OVER w AS BIGINT) AS packets, CAST(sum(bytes) OVER w AS BIGINT) AS bytes
  FROM seconds WINDOW w AS (PARTITION BY sensor ORDER BY ts ROWS UNBOUNDED PRECEDING)
)"""
METRICS = """metrics AS (
  SELECT ts, 'capture.packets' AS metric, sensor, CAST(packets AS DOUBLE) AS value FROM running
  UNION ALL SELECT ts, 'capture.bytes', sensor, CAST(bytes AS DOUBLE) FROM running
)"""


_GAUGES = {
    "brokenPkts": "c.pkt_id IS NULL", "request": "request_method IS NOT NULL", "response": "request_method IS NULL AND response_code IS NOT NULL", "malformed": "malformed = 1",
    **{m.lower(): f"request_method = '{m}'" for m in METHODS}, **{f"status_{n}xx": f"response_code // 100 = {n}" for n in range(1, 7)},
}
ALL_METRICS = f"""counted AS (
  SELECT date_trunc('second', make_timestamp(p.timestamp_ns // 1000)) AS ts, 'ch' || ((p.src_ip + p.src_port + p.dst_ip + p.dst_port) % 4)::VARCHAR AS sensor,
    count(*) AS packets, sum(p.len + 24) AS bytes, {", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in _GAUGES.items())}
  FROM packets p LEFT JOIN checked c ON p.pkt_id = c.pkt_id GROUP BY 1, 2
), summed AS (
  SELECT ts, sensor, {", ".join(f"CAST(sum({c}) OVER w AS DOUBLE) AS {c}" for c in ("packets", "bytes", *_GAUGES))}
  FROM counted WINDOW w AS (PARTITION BY sensor ORDER BY ts ROWS UNBOUNDED PRECEDING)
), all_metrics AS ({" UNION ALL ".join(f"SELECT ts, '{'capture' if c in ('packets', 'bytes', 'brokenPkts') else 'sip_stat'}.{c}' AS metric, sensor, {c} AS value FROM summed" for c in ("packets", "bytes", *_GAUGES))})"""


@query("metric_sink", oracle.on("checked", "SELECT ts, metric, sensor, value FROM all_metrics", ALL_METRICS))
def metric_sink(spark, sf_dir):
    """All running gauges, written as METRIC rows and read back."""

    def write(path):
        counters.all_gauges(inputs.packets(spark, sf_dir)).write.mode("append").parquet(path)

    return spark.read.schema(schemas.METRIC).parquet(inputs.stored(spark, sf_dir, "all-metrics", write))


@query("wait_quantiles")
def wait_quantiles(spark, sf_dir):
    """Quantiles of the waits between packets by channel, from sketches per minute that are stored and merged."""

    def write(path):
        counters.wait_sketches(inputs.packets(spark, sf_dir)).write.mode("append").parquet(path)

    return counters.wait_quantiles(spark.read.parquet(inputs.stored(spark, sf_dir, "wait-sketches", write)))
