"""Queries for counters, dashboards and segments."""

from pyspark.sql import functions as F

from dialtrace.operators import counters, validate
from dialtrace.operators.headers import METHODS
from dialtrace.plans import dashboards
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query
from dialtrace.registry.headers import parsed
from dialtrace.registry.sources import METRICS, RUNNING, SECONDS, metrics


@query(
    "message_kinds",
    oracle.on(
        "parsed",
        """SELECT CASE WHEN request_method IS NOT NULL THEN 'request' WHEN response_code IS NOT NULL THEN 'response' ELSE 'unknown' END AS kind,
        CAST(count(*) AS BIGINT) AS messages FROM parsed GROUP BY 1""",
    ),
)
def message_kinds(spark, sf_dir):
    return counters.kind_counts(parsed(spark, sf_dir))


_CHANNEL = "'ch' || ((src_ip + src_port + dst_ip + dst_port) % 4)::VARCHAR"


@query(
    "method_counters",
    oracle.on(
        "parsed",
        f"SELECT {_CHANNEL} AS sensor, "
        + ", ".join(f"CAST(count(*) FILTER (request_method = '{m}') AS BIGINT) AS {m.lower()}" for m in METHODS)
        + " FROM parsed GROUP BY 1",
    ),
)
def method_counters(spark, sf_dir):
    return counters.method_counts(parsed(spark, sf_dir), [counters.channel().alias("sensor")])


@query(
    "status_class_counters",
    oracle.on(
        "parsed",
        f"SELECT {_CHANNEL} AS sensor, "
        + ", ".join(f"CAST(count(*) FILTER (response_code // 100 = {n}) AS BIGINT) AS status_{n}xx" for n in range(1, 7))
        + " FROM parsed GROUP BY 1",
    ),
)
def status_class_counters(spark, sf_dir):
    return counters.status_class_counts(parsed(spark, sf_dir), [counters.channel().alias("sensor")])


@query(
    "traffic_counters",
    oracle.on(
        "packets",
        f"SELECT {_CHANNEL} AS sensor, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len + 24) AS BIGINT) AS bytes FROM packets GROUP BY 1",
    ),
)
def traffic_counters(spark, sf_dir):
    return counters.traffic(inputs.packets(spark, sf_dir), [counters.channel().alias("sensor")])


@query(
    "reject_counters",
    oracle.on(
        "packets",
        """SELECT reason, CAST(count(*) AS BIGINT) AS packets FROM (SELECT CASE WHEN payload_offset >= len THEN 'empty payload'
        WHEN ip_version <> 4 THEN 'not IPv4' WHEN length(pkt_hex) <> 2 * len THEN 'length mismatch' END AS reason FROM packets)
        WHERE reason IS NOT NULL GROUP BY 1""",
    ),
)
def reject_counters(spark, sf_dir):
    return counters.rejects_by_reason(validate.rejected(inputs.packets(spark, sf_dir)))


@query(
    "malformed_counters",
    oracle.on(
        "checked",
        """SELECT reason, CAST(count(*) AS BIGINT) AS messages FROM
        (SELECT unnest(string_split(reasons, ' |' || chr(10))) AS reason FROM checked WHERE reasons <> '') GROUP BY 1""",
    ),
)
def malformed_counters(spark, sf_dir):
    checked = validate.with_malformed(parsed(spark, sf_dir))
    return counters.malformed_by_reason(checked, validate.reason_list(F.col("reasons")))


@query("second_counters", oracle.on("packets", "SELECT ts, sensor, packets, bytes FROM seconds", SECONDS))
def second_counters(spark, sf_dir):
    return counters.per_second(inputs.packets(spark, sf_dir))


@query("running_counters", oracle.on("packets", "SELECT ts, sensor, packets, bytes FROM running", SECONDS, RUNNING))
def running_counters(spark, sf_dir):
    return counters.running(counters.per_second(inputs.packets(spark, sf_dir)), ["packets", "bytes"])


FLUSHED = """flushed AS (
  SELECT date_trunc('minute', ts) AS ts, metric, sensor, arg_max(value, ts) AS value FROM metrics GROUP BY 1, 2, 3
)"""


@query(
    "gauge_flush",
    oracle.on("packets", "SELECT ts, metric, sensor, value FROM flushed", SECONDS, RUNNING, METRICS, FLUSHED),
)
def gauge_flush(spark, sf_dir):
    return counters.flush(metrics(spark, sf_dir))


@query(
    "interval_peak",
    oracle.on(
        "packets",
        """SELECT second, CAST(max(wait) AS BIGINT) AS peak_us FROM (
          SELECT timestamp_ns // 1000000000 AS second, (timestamp_ns - lag(timestamp_ns) OVER (
            PARTITION BY least(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port), greatest(src_ip * 65536 + src_port, dst_ip * 65536 + dst_port)
            ORDER BY timestamp_ns)) // 1000 AS wait FROM packets) WHERE wait IS NOT NULL GROUP BY 1""",
    ),
)
def interval_peak(spark, sf_dir):
    return counters.interval_peak(inputs.packets(spark, sf_dir))


@query(
    "sampled_metrics",
    oracle.on("capture", "SELECT id, malformed FROM capture WHERE CAST('0x' || substr(md5(id::VARCHAR), 1, 8) AS BIGINT) < 429496729"),
)
def sampled_metrics(spark, sf_dir):
    return counters.sampled(inputs.capture(spark, sf_dir), 0.1).select("id", "malformed")


_RECENT = "recent AS (SELECT * FROM capture WHERE datetime >= (SELECT max(datetime) FROM capture) - INTERVAL {days} DAY)"


def _dashboard(name, kind, days, sql, stage="capture"):
    @query(name, oracle.on(stage, sql, _RECENT.format(days=days)))
    def run(spark, sf_dir):
        codecs = inputs.sdp(spark, sf_dir) if kind.startswith("sdp") else None
        return dashboards.dashboard(inputs.capture(spark, sf_dir), codecs, kind, days)

    run.__name__ = name


_VALUE = "CAST(count(*) AS BIGINT) AS value"
_REGISTER = "request_method = 'REGISTER'"
_BY_METHOD = f"SELECT request_method AS label, {_VALUE} FROM recent WHERE request_method IS NOT NULL GROUP BY 1"
_BY_AGENT = f"SELECT coalesce(user_agent, 'unknown') AS label, {_VALUE} FROM recent WHERE {_REGISTER} GROUP BY 1"
_BY_SOURCE = f"SELECT {oracle.ip('source_ip')} AS label, {_VALUE} FROM recent WHERE {_REGISTER} GROUP BY 1"
_BY_CODEC = f"SELECT s.codec AS label, {_VALUE} FROM recent r JOIN sdp s ON s.id = r.id WHERE {{0}} GROUP BY 1"

for _days, _suffix in ((1, ""), (30, "_month")):
    _dashboard(f"dashboard_methods{_suffix}", "method", _days, _BY_METHOD)
    _dashboard(f"dashboard_register_sources{_suffix}", "ip", _days, _BY_SOURCE)
    _dashboard(f"dashboard_register_agents{_suffix}", "ua", _days, _BY_AGENT)
    _dashboard(f"dashboard_request_codecs{_suffix}", "sdp-codec-req", _days, _BY_CODEC.format("request_method = 'INVITE'"), "sdp")
    _dashboard(f"dashboard_response_codecs{_suffix}", "sdp-codec-resp", _days, _BY_CODEC.format("response_code = 200"), "sdp")
    _dashboard(
        f"dashboard_rows_per_hour{_suffix}",
        "data-per-hour",
        _days,
        """SELECT strftime(date_trunc('hour', datetime), '%Y-%m-%d %H:00') AS label, CAST(count(*) FILTER (malformed = 0) AS BIGINT) AS ok,
        CAST(count(*) FILTER (malformed = 1) AS BIGINT) AS mal FROM recent GROUP BY 1""",
    )


def _top(name, build, method, party):
    sql = f"""SELECT "{party}" AS phone, CAST(count(*) AS BIGINT) AS count FROM capture WHERE request_method = '{method}' AND "{party}" IS NOT NULL
      GROUP BY 1 ORDER BY count DESC, phone LIMIT 10"""

    @query(name, oracle.on("capture", sql))
    def run(spark, sf_dir):
        return build(inputs.capture(spark, sf_dir))

    run.__name__ = name


_top("top_register", dashboards.top_register, "REGISTER", "from")
_top("top_caller", dashboards.top_caller, "INVITE", "from")
_top("top_called", dashboards.top_called, "INVITE", "to")


def _segments(spark, sf_dir):
    return dashboards.by_source(inputs.capture(spark, sf_dir))


_SEGMENTS = f"segments AS (SELECT {oracle.ip('source_ip')} AS label, {_VALUE} FROM capture WHERE {_REGISTER} GROUP BY 1)"
_SHARES = "shares AS (SELECT label, value, CAST(value AS DOUBLE) / (SELECT sum(value)::DOUBLE FROM segments) * 100.0::DOUBLE AS share FROM segments)"


@query("share_of_total", oracle.on("capture", "SELECT label, value, share FROM shares", _SEGMENTS, _SHARES))
def share_of_total(spark, sf_dir):
    return dashboards.with_share(_segments(spark, sf_dir))


@query(
    "small_segments",
    oracle.on(
        "capture",
        "SELECT CASE WHEN share <= 1 THEN 'Other' ELSE label END AS label, share <= 1 AS grouped, CAST(sum(value) AS BIGINT) AS value FROM shares GROUP BY 1, 2",
        _SEGMENTS,
        _SHARES,
    ),
)
def small_segments(spark, sf_dir):
    return dashboards.group_small(_segments(spark, sf_dir), 1)


@query(
    "small_segments_absolute",
    oracle.on(
        "capture",
        "SELECT CASE WHEN value <= 5 THEN 'Other' ELSE label END AS label, value <= 5 AS grouped, CAST(sum(value) AS BIGINT) AS value FROM segments GROUP BY 1, 2",
        _SEGMENTS,
    ),
)
def small_segments_absolute(spark, sf_dir):
    return dashboards.group_small(_segments(spark, sf_dir), 5, unit="value")


for _order, _sql in (
    ("none", ""),
    ("value-asc", "ORDER BY value, label"),
    ("value-desc", "ORDER BY value DESC, label"),
    ("label-asc", "ORDER BY lower(label), label"),
    ("label-desc", "ORDER BY lower(label) DESC, label DESC"),
):

    def _ordered(name, order, sql):
        @query(name, oracle.on("capture", f"SELECT label, value FROM segments {sql}", _SEGMENTS))
        def run(spark, sf_dir):
            return dashboards.sort_segments(_segments(spark, sf_dir), order)

        run.__name__ = name

    _ordered(f"segments_{_order.replace('-', '_')}", _order, _sql)
