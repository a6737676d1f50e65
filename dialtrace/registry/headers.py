"""Queries for payload decoding and header extraction."""

from pyspark.sql import functions as F

from dialtrace.functions import text as tx
from dialtrace.functions import time as tm
from dialtrace.functions.net import endpoint, ip_text
from dialtrace.operators import headers as h
from dialtrace.operators.validate import accepted
from dialtrace.plans import callflow
from dialtrace.plans.ingest import to_capture
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query


def decoded(spark, sf_dir):
    return h.with_text(accepted(inputs.packets(spark, sf_dir)))


def parsed(spark, sf_dir):
    return h.parse(accepted(inputs.packets(spark, sf_dir)))


def _head(spark, sf_dir, column, name):
    return decoded(spark, sf_dir).select("pkt_id", column.alias(name))


@query(
    "methods_and_codes",
    oracle.on("parsed", "SELECT request_method, response_code, count(*) AS packets FROM parsed GROUP BY ALL"),
)
def methods_and_codes(spark, sf_dir):
    head = F.col("head")
    rows = decoded(spark, sf_dir).select(
        h.method(head).alias("request_method"), h.status_code(head).alias("response_code")
    )
    return rows.groupBy("request_method", "response_code").agg(F.count(F.lit(1)).alias("packets"))


@query(
    "payload_slice",
    oracle.on("packets", "SELECT pkt_id, upper(substr(pkt_hex, payload_offset * 2 + 1)) AS payload FROM packets"),
)
def payload_slice(spark, sf_dir):
    df = inputs.packets(spark, sf_dir)
    return df.select("pkt_id", F.hex(tx.payload_bytes(F.col("pkt_hex"), F.col("payload_offset"))).alias("payload"))


@query("hex_encode", oracle.on("packets", "SELECT pkt_id, pkt_hex AS encoded FROM packets"))
def hex_encode(spark, sf_dir):
    df = inputs.packets(spark, sf_dir)
    return df.select("pkt_id", tx.hex_text(F.unhex("pkt_hex")).alias("encoded"))


@query(
    "printable_text",
    oracle.on("decoded", "SELECT pkt_id, replace(text, chr(65533), '') AS text FROM decoded"),
)
def printable_text(spark, sf_dir):
    return decoded(spark, sf_dir).select("pkt_id", tx.printable(F.col("text")).alias("text"))


@query("start_line_method", oracle.on("parsed", "SELECT pkt_id, request_method FROM parsed"))
def start_line_method(spark, sf_dir):
    return _head(spark, sf_dir, h.method(F.col("head")), "request_method")


@query(
    "known_methods_only",
    oracle.on("parsed", "SELECT pkt_id, request_method FROM parsed WHERE request_method IN ('INVITE', 'ACK', 'BYE', "
              "'CANCEL', 'OPTIONS', 'REGISTER', 'PRACK', 'SUBSCRIBE', 'NOTIFY', 'PUBLISH', 'INFO', 'REFER', 'MESSAGE', 'UPDATE')"),
)
def known_methods_only(spark, sf_dir):
    return start_line_method(spark, sf_dir).where(F.col("request_method").isin(h.METHODS))


@query("status_code", oracle.on("parsed", "SELECT pkt_id, response_code FROM parsed"))
def status_code(spark, sf_dir):
    return _head(spark, sf_dir, h.status_code(F.col("head")), "response_code")


@query("from_user", oracle.on("parsed", 'SELECT pkt_id, "from" AS from_user FROM parsed'))
def from_user(spark, sf_dir):
    return _head(spark, sf_dir, h.from_user(F.col("head")), "from_user")


@query("to_user", oracle.on("parsed", 'SELECT pkt_id, "to" AS to_user FROM parsed'))
def to_user(spark, sf_dir):
    return _head(spark, sf_dir, h.to_user(F.col("head")), "to_user")


@query(
    "call_id",
    oracle.on("parsed", "SELECT pkt_id, callid, callid || '@pbx.example.com' AS callid_with_host FROM parsed"),
)
def call_id(spark, sf_dir):
    head = F.col("head")
    return decoded(spark, sf_dir).select(
        "pkt_id", h.call_id(head).alias("callid"), h.call_id(head, keep_host=True).alias("callid_with_host")
    )


@query("session_id", oracle.on("parsed", "SELECT pkt_id, callid_rc FROM parsed"))
def session_id(spark, sf_dir):
    return _head(spark, sf_dir, h.session_id(F.col("head")), "callid_rc")


@query("user_agent", oracle.on("parsed", "SELECT pkt_id, user_agent FROM parsed"))
def user_agent(spark, sf_dir):
    return _head(spark, sf_dir, h.user_agent(F.col("head")), "user_agent")


@query(
    "max_forwards",
    oracle.on("parsed", "SELECT pkt_id, maxfwd, maxfwd IS NULL AS missing, coalesce(maxfwd = '', false) AS empty FROM parsed"),
)
def max_forwards(spark, sf_dir):
    df = parsed(spark, sf_dir)
    return df.select(
        "pkt_id",
        "maxfwd",
        F.col("maxfwd").isNull().alias("missing"),
        F.coalesce(F.col("maxfwd") == "", F.lit(False)).alias("empty"),
    )


@query("cseq", oracle.on("parsed", "SELECT pkt_id, cseq_number, cseq_method FROM parsed"))
def cseq(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "pkt_id", F.col("cseq.number").alias("cseq_number"), F.col("cseq.method").alias("cseq_method")
    )


@query(
    "via_hops",
    oracle.on(
        "decoded",
        r"""SELECT pkt_id, CAST(0 AS INTEGER) AS hop, '2.0' AS version, 'UDP' AS protocol, '10.0.0.1' AS host, '5060' AS port,
        regexp_extract(text, '\nVia: ([^\r\n]*)', 1) AS last_via FROM decoded""",
    ),
)
def via_hops(spark, sf_dir):
    df = decoded(spark, sf_dir).select(
        "pkt_id", h.last_via(F.col("head")).alias("last_via"), F.posexplode(h.via_hops(F.col("head"))).alias("hop", "via")
    )
    return df.select("pkt_id", "hop", "via.version", "via.protocol", "via.host", "via.port", "last_via")


@query(
    "sdp_codecs",
    oracle.on(
        "decoded",
        r"""SELECT pkt_id, array_to_string(regexp_extract_all(text, '\na=rtpmap:\d+ ([\w-]+)/', 1), ',') AS codecs,
        len(regexp_extract_all(text, '\na=rtpmap:'))::INTEGER AS codec_count FROM decoded""",
    ),
)
def sdp_codecs(spark, sf_dir):
    df = decoded(spark, sf_dir).select("pkt_id", h.sdp_codecs(F.col("text")).alias("codecs"))
    return df.select("pkt_id", F.array_join("codecs", ",").alias("codecs"), F.size("codecs").alias("codec_count"))


@query(
    "compact_headers",
    oracle.on("parsed", 'SELECT pkt_id, "from" AS from_user, "to" AS to_user, callid FROM parsed'),
)
def compact_headers(spark, sf_dir):
    """The same headers under their one-letter names."""
    head = F.col("head")
    for long, short in (("From", "f"), ("To", "t"), ("Call-ID", "i")):
        head = F.replace(head, F.lit(f"\n{long}:"), F.lit(f"\n{short}:"))
    compact = decoded(spark, sf_dir).withColumn("head", head)
    return compact.select(
        "pkt_id",
        h.from_user(F.col("head")).alias("from_user"),
        h.to_user(F.col("head")).alias("to_user"),
        h.call_id(F.col("head")).alias("callid"),
    )


@query(
    "ns_to_timestamp",
    oracle.on("packets", "SELECT pkt_id, make_timestamp(timestamp_ns // 1000) AS datetime FROM packets"),
)
def ns_to_timestamp(spark, sf_dir):
    return inputs.packets(spark, sf_dir).select("pkt_id", tm.ns_to_timestamp(F.col("timestamp_ns")).alias("datetime"))


@query(
    "ns_to_seconds_text",
    oracle.on(
        "packets",
        "SELECT pkt_id, (timestamp_ns // 1000000000)::VARCHAR || '.' || "
        "lpad((timestamp_ns // 1000 % 1000000)::VARCHAR, 6, '0') AS seconds FROM packets",
    ),
)
def ns_to_seconds_text(spark, sf_dir):
    return inputs.packets(spark, sf_dir).select("pkt_id", tm.ns_to_seconds_text(F.col("timestamp_ns")).alias("seconds"))


_EMPTIED = ["from", "to", "callid", "callid_rc", "request_method", "user_agent"]


@query(
    "empty_to_null",
    oracle.on("parsed", 'SELECT pkt_id, "from", "to", callid, callid_rc, request_method, user_agent FROM parsed'),
)
def empty_to_null(spark, sf_dir):
    """Missing headers arrive as blank text and are stored as NULL."""
    df = parsed(spark, sf_dir)
    blanked = df.select("pkt_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(c) for c in _EMPTIED])
    return blanked.select("pkt_id", *[tx.empty_to_null(F.col(f"`{c}`")).alias(c) for c in _EMPTIED])


@query(
    "message_label",
    oracle.on("capture", "SELECT id, coalesce(request_method, '') || coalesce(response_code::VARCHAR, '') AS label FROM capture"),
)
def message_label(spark, sf_dir):
    df = inputs.capture(spark, sf_dir)
    return df.select("id", tx.message_label(F.col("request_method"), F.col("response_code")).alias("label"))


@query(
    "endpoint_label",
    oracle.on(
        "capture",
        f"""SELECT id, {oracle.endpoint('source_ip', 'source_port')} AS source, {oracle.endpoint('destination_ip', 'destination_port')} AS destination,
        {oracle.ip('source_ip')} || ':0' AS source_without_port FROM capture""",
    ),
)
def endpoint_label(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select(
        "id",
        endpoint(F.col("source_ip"), F.col("source_port")).alias("source"),
        endpoint(F.col("destination_ip"), F.col("destination_port")).alias("destination"),
        endpoint(F.col("source_ip"), F.lit(None).cast("int")).alias("source_without_port"),
    )


@query(
    "epoch_seconds",
    oracle.on("capture", "SELECT id, CAST(floor((epoch_us(datetime) + 500000) / 1000000.0) AS BIGINT) AS seconds FROM capture"),
)
def epoch_seconds(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", tm.epoch_seconds(F.col("datetime")).alias("seconds"))


@query("capture_rows", oracle.on("capture", "SELECT * FROM capture"))
def capture_rows(spark, sf_dir):
    """Parse, validate and shape all packets, without storing them."""
    return to_capture(inputs.packets(spark, sf_dir))


@query("stored_message", oracle.on("capture", "SELECT id, malformed, msg FROM capture"))
def stored_message(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", "malformed", "msg")


RENDERED = (
    "'DateTime: ' || strftime(datetime, '%Y-%m-%d %H:%M:%S.%f') || chr(10) || 'SRC/DST IP: ' || "
    + oracle.endpoint("source_ip", "source_port")
    + " || ' -> ' || "
    + oracle.endpoint("destination_ip", "destination_port")
    + " || chr(10) || chr(10) || msg"
)


@query("rendered_message", oracle.on("capture", f"SELECT id, {RENDERED} AS rendered FROM capture"))
def rendered_message(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", callflow.rendered_message().alias("rendered"))


NOTE = (
    "trim(replace(replace(replace(replace(replace(replace(split_part(split_part(msg, chr(10), 1), chr(13), 1), "
    "'&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;'), 'SIP/2.0', ''))"
)


@query("flow_note", oracle.on("capture", f"SELECT id, {NOTE} AS note FROM capture"))
def flow_note(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", tx.flow_note(F.col("msg")).alias("note"))


COLOUR = (
    "CASE WHEN response_code IS NULL THEN 'black' WHEN response_code // 100 = 1 THEN 'DodgerBlue' "
    "WHEN response_code // 100 = 2 THEN 'LimeGreen' WHEN response_code // 100 = 3 THEN 'yellow' ELSE 'red' END"
)
ARROW = "CASE WHEN response_code // 100 IN (1, 3) THEN '-->' ELSE '->' END"


@query(
    "status_style",
    oracle.on("capture", f"SELECT DISTINCT request_method, response_code, {COLOUR} AS colour, {ARROW} AS arrow FROM capture"),
)
def status_style(spark, sf_dir):
    code = F.col("response_code")
    distinct = inputs.capture(spark, sf_dir).select("request_method", "response_code").distinct()
    return distinct.select(
        "request_method",
        "response_code",
        callflow.status_colour(code).alias("colour"),
        callflow.status_arrow(code).alias("arrow"),
    )


@query(
    "flow_line",
    oracle.on(
        "capture",
        f"""SELECT id, {oracle.ip('source_ip')} || ' ' || {ARROW} || ' ' || {oracle.ip('destination_ip')} || '  [label = ''' ||
        coalesce(request_method, '') || coalesce(response_code::VARCHAR, '') || ''', note = ''' || {NOTE} || ''', color = ''' || {COLOUR} || ''' ]; ' || chr(10)
        AS line FROM capture""",
    ),
)
def flow_line(spark, sf_dir):
    rows = callflow.flow_rows(inputs.capture(spark, sf_dir))
    return rows.select("id", callflow.flow_line().alias("line"))


@query(
    "ipv4_text",
    oracle.on("capture", f"SELECT id, {oracle.ip('source_ip')} AS source, {oracle.ip('destination_ip')} AS destination FROM capture"),
)
def ipv4_text(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select(
        "id", ip_text(F.col("source_ip")).alias("source"), ip_text(F.col("destination_ip")).alias("destination")
    )
