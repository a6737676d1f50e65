"""Queries for call correlation and call flows."""

from pyspark.sql import functions as F

from dialtrace.functions.hashing import message_checksum
from dialtrace.operators import correlate
from dialtrace.operators.counters import flow_traffic
from dialtrace.operators.dedup import without_retransmissions
from dialtrace.operators.ranking import first_per
from dialtrace.plans import callflow, dashboards
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query
from dialtrace.registry.headers import ARROW, COLOUR, NOTE, RENDERED

# the message whose flow the single-flow queries show: first of dialog 3, which dialog 4 names as its session
SEED = 21

# The definition word for word, one key set per seed call: its id, its session
# id, and the calls that name either as theirs.
SEEDS = """seeds AS (
  SELECT callid AS cid, min(CASE WHEN callid_rc <> '' THEN callid_rc END) AS rc FROM capture WHERE callid <> '' GROUP BY callid
),
seed_keys AS (
  SELECT cid, cid AS key FROM seeds UNION SELECT cid, rc FROM seeds WHERE rc IS NOT NULL
  UNION SELECT s.cid, c.callid FROM seeds s JOIN capture c ON c.callid_rc = coalesce(s.rc, s.cid) AND c.callid <> ''
),
seed_members AS (
  SELECT k.cid, c.id FROM seed_keys k JOIN capture c ON c.callid = k.key
  UNION SELECT k.cid, c.id FROM seed_keys k JOIN capture c ON c.callid_rc = k.key
),
members AS (
  SELECT DISTINCT coalesce(s.rc, s.cid) AS session, m.id FROM seed_members m JOIN seeds s ON s.cid = m.cid
)"""

CHECKSUM = (
    "sha1(coalesce(\"from\", '') || coalesce(\"to\", '') || source_ip || coalesce(source_port, 0) || "
    "destination_ip || coalesce(destination_port, 0) || msg)"
)

FLOWS = f"""hashed AS (
  SELECT *, {CHECKSUM} AS chsumm, {NOTE} AS note, coalesce(request_method, '') || coalesce(response_code::VARCHAR, '') AS label FROM capture
),
distinct_members AS (
  SELECT session, h.* FROM members m JOIN hashed h ON h.id = m.id
  QUALIFY row_number() OVER (PARTITION BY session, chsumm ORDER BY datetime, h.id) = 1
),
flows AS (
  SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY datetime, id) AS INTEGER) AS number, id, datetime,
    {oracle.ip('source_ip')} AS source_ip, {oracle.ip('destination_ip')} AS destination_ip, label, note, response_code
  FROM distinct_members QUALIFY row_number() OVER (PARTITION BY session ORDER BY datetime, id) <= 1000
)"""

LANES = """seen AS (
  SELECT session, source_ip AS ip, number * 2 AS place FROM flows UNION ALL SELECT session, destination_ip, number * 2 + 1 FROM flows
),
lanes AS (
  SELECT session, ip, CAST(row_number() OVER (PARTITION BY session ORDER BY min(place)) AS INTEGER) AS lane FROM seen GROUP BY session, ip
)"""

FLOW_COLUMNS = "session, number, id, datetime, source_ip, destination_ip, label, note"

LINE = (
    f"source_ip || ' ' || {ARROW} || ' ' || destination_ip || '  [label = ''' || label || ''', note = ''' || note || "
    f"''', color = ''' || {COLOUR} || ''' ]; ' || chr(10)"
)


def flow_path(spark, sf_dir):
    """All flows, stored once: several queries go on from them."""
    return inputs.stored(
        spark, sf_dir, "flows", lambda path: callflow.call_flows(inputs.capture(spark, sf_dir)).write.parquet(path)
    )


def flows(spark, sf_dir):
    return spark.read.parquet(flow_path(spark, sf_dir))


@query("call_correlation", oracle.on("capture", "SELECT session, id FROM members", SEEDS))
def call_correlation(spark, sf_dir):
    return callflow.flow_members(inputs.capture(spark, sf_dir))


@query(
    "seed_flows",
    oracle.on("capture", "SELECT c.id, coalesce(s.rc, s.cid) AS session FROM capture c JOIN seeds s ON c.callid = s.cid", SEEDS),
)
def seed_flows(spark, sf_dir):
    return callflow.seed_flows(inputs.capture(spark, sf_dir))


@query(
    "session_calls",
    oracle.on("capture", "SELECT DISTINCT callid_rc AS session, callid FROM capture WHERE callid_rc <> '' AND callid <> ''"),
)
def session_calls(spark, sf_dir):
    return correlate.session_calls(correlate.call_pairs(inputs.capture(spark, sf_dir)))


@query(
    "call_session",
    oracle.on("capture", "SELECT cid AS callid, coalesce(rc, cid) AS session FROM seeds", SEEDS),
)
def call_session(spark, sf_dir):
    return correlate.call_sessions(correlate.call_pairs(inputs.capture(spark, sf_dir)))


@query("call_flows", oracle.on("capture", f"SELECT {FLOW_COLUMNS} FROM flows", SEEDS, FLOWS))
def call_flows(spark, sf_dir):
    return callflow.call_flows(inputs.capture(spark, sf_dir))


_ONE = f"session = (SELECT coalesce(s.rc, s.cid) FROM capture c JOIN seeds s ON s.cid = c.callid WHERE c.id = {SEED})"


@query("call_flow", oracle.on("capture", f"SELECT {FLOW_COLUMNS} FROM flows WHERE {_ONE}", SEEDS, FLOWS))
def call_flow(spark, sf_dir):
    return callflow.call_flow(inputs.capture(spark, sf_dir), SEED)


@query(
    "flow_messages",
    oracle.on("capture", f"SELECT f.session, f.number, f.id, {RENDERED.replace('datetime,', 'c.datetime,').replace('source_ip', 'c.source_ip').replace('destination_ip', 'c.destination_ip')} AS rendered FROM flows f JOIN capture c ON c.id = f.id", SEEDS, FLOWS),
)
def flow_messages(spark, sf_dir):
    df = callflow.flow_messages(flows(spark, sf_dir), inputs.capture(spark, sf_dir))
    return df.select("session", "number", "id", "rendered")


@query("message_lookup", oracle.on("capture", f"SELECT id, {RENDERED} AS msg FROM capture WHERE id = {SEED}"))
def message_lookup(spark, sf_dir):
    return callflow.message(inputs.capture(spark, sf_dir), SEED)


@query(
    "retransmission_dedup",
    oracle.on(
        "capture",
        f"SELECT id, datetime, {CHECKSUM} AS chsumm FROM capture QUALIFY row_number() OVER (PARTITION BY {CHECKSUM} ORDER BY datetime, id) = 1",
    ),
)
def retransmission_dedup(spark, sf_dir):
    return without_retransmissions(inputs.capture(spark, sf_dir)).select("id", "datetime", "chsumm")


_NULLABLE = (
    "sha1(\"from\" || \"to\" || source_ip || coalesce(source_port, 0) || destination_ip || coalesce(destination_port, 0) || msg)"
)


@query(
    "retransmission_dedup_nulls_collapse",
    oracle.on(
        "capture",
        f"SELECT id, {_NULLABLE} AS chsumm FROM capture QUALIFY row_number() OVER (PARTITION BY {_NULLABLE} ORDER BY datetime, id) = 1",
    ),
)
def retransmission_dedup_nulls_collapse(spark, sf_dir):
    return without_retransmissions(inputs.capture(spark, sf_dir), null_collapses=True).select("id", "chsumm")


@query("message_sha1", oracle.on("capture", f"SELECT id, {CHECKSUM} AS chsumm FROM capture"))
def message_sha1(spark, sf_dir):
    return inputs.capture(spark, sf_dir).select("id", message_checksum().alias("chsumm"))


@query(
    "message_numbers",
    oracle.on("capture", "SELECT session, id, number FROM flows", SEEDS, FLOWS),
)
def message_numbers(spark, sf_dir):
    return flows(spark, sf_dir).select("session", "id", "number")


@query("participant_lanes", oracle.on("capture", "SELECT session, ip, lane FROM lanes", SEEDS, FLOWS, LANES))
def participant_lanes(spark, sf_dir):
    return callflow.lanes(flows(spark, sf_dir))


@query(
    "lane_spans",
    oracle.on(
        "capture",
        """SELECT f.session, f.number, f.id, least(a.lane, b.lane) AS left_lane, greatest(abs(a.lane - b.lane), 1) AS span FROM flows f
        JOIN lanes a ON a.session = f.session AND a.ip = f.source_ip JOIN lanes b ON b.session = f.session AND b.ip = f.destination_ip""",
        SEEDS, FLOWS, LANES,
    ),
)
def lane_spans(spark, sf_dir):
    return callflow.lane_spans(flows(spark, sf_dir)).select("session", "number", "id", "left_lane", "span")


@query(
    "first_message_per_call",
    oracle.on("capture", "SELECT callid, id, datetime FROM capture QUALIFY row_number() OVER (PARTITION BY callid ORDER BY datetime, id) = 1"),
)
def first_message_per_call(spark, sf_dir):
    rows = inputs.capture(spark, sf_dir).select("callid", "id", "datetime")
    return first_per(rows, ["callid"], [F.col("datetime"), F.col("id")])


@query(
    "flow_limit",
    oracle.on(
        "capture",
        f"""SELECT session, CAST(count(*) AS INTEGER) AS messages, count(*) >= 1000 AS limit_reached,
        string_agg({LINE}, '' ORDER BY number) || CASE WHEN count(*) >= 1000 THEN '=== Limit reached ===' ELSE '' END AS flow
        FROM flows GROUP BY session""",
        SEEDS,
        FLOWS,
    ),
)
def flow_limit(spark, sf_dir):
    return callflow.flow_texts(flows(spark, sf_dir))


_ASCII = (
    "replace(replace(replace(replace(rendered, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(65533), '&#65533;')"
)
_QUALIFIED = RENDERED.replace("datetime,", "c.datetime,").replace("source_ip", "c.source_ip").replace("destination_ip", "c.destination_ip")
_EXPORT = f"""texts AS (
  SELECT session, string_agg({LINE}, '' ORDER BY number) AS flow FROM flows GROUP BY session
),
messages AS (
  SELECT session, number, id, {_ASCII} AS text FROM (SELECT f.session, f.number, f.id, {_QUALIFIED} AS rendered FROM flows f JOIN capture c ON c.id = f.id)
),
documents AS (
  SELECT m.session, to_json({{'flow': any_value(t.flow), 'msg': MAP(list(m.id::VARCHAR ORDER BY number), list(text ORDER BY number))}})::VARCHAR AS document
  FROM messages m JOIN texts t ON t.session = m.session GROUP BY m.session
)"""


@query("flow_export", oracle.on("capture", "SELECT session, document FROM documents", SEEDS, FLOWS, _EXPORT))
def flow_export(spark, sf_dir):
    """Documents written as text files by session, read back."""

    def write(path):
        documents = callflow.export_flows(flows(spark, sf_dir), inputs.capture(spark, sf_dir))
        documents.select("session", "document").write.json(path)

    path = inputs.stored(spark, sf_dir, "exports", write)
    return spark.read.schema("session STRING, document STRING").json(path)


@query("flow_export_single", oracle.on("capture", f"SELECT session, document FROM documents WHERE {_ONE}", SEEDS, FLOWS, _EXPORT))
def flow_export_single(spark, sf_dir):
    return callflow.export_flow(inputs.capture(spark, sf_dir), SEED)


@query(
    "message_codecs",
    oracle.on("sdp", "SELECT c.id, c.request_method, c.response_code, s.codec FROM capture c JOIN sdp s ON s.id = c.id "
              "WHERE c.request_method = 'INVITE' OR c.response_code = 200"),
)
def message_codecs(spark, sf_dir):
    rows = inputs.capture(spark, sf_dir).where((F.col("request_method") == "INVITE") | (F.col("response_code") == 200))
    joined = dashboards.with_codecs(rows.select("id", "date", "request_method", "response_code"), inputs.sdp(spark, sf_dir))
    return joined.select("id", "request_method", "response_code", "codec")


@query(
    "symmetric_flows",
    oracle.on(
        "packets",
        """SELECT CASE WHEN forward THEN src_ip ELSE dst_ip END AS low_ip, CASE WHEN forward THEN src_port ELSE dst_port END AS low_port,
        CASE WHEN forward THEN dst_ip ELSE src_ip END AS high_ip, CASE WHEN forward THEN dst_port ELSE src_port END AS high_port,
        CAST(count(*) AS BIGINT) AS packets, CAST(sum(len + 24) AS BIGINT) AS bytes
        FROM (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS forward FROM packets) GROUP BY 1, 2, 3, 4""",
    ),
)
def symmetric_flows(spark, sf_dir):
    return flow_traffic(inputs.packets(spark, sf_dir))
