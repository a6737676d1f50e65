"""Queries for the search page."""

from pyspark.sql import functions as F

from dialtrace.functions.hashing import colour_bucket, palette, signed_crc32
from dialtrace.functions.net import endpoint
from dialtrace.operators import filters
from dialtrace.plans import search as plan
from dialtrace.registry import inputs, oracle
from dialtrace.registry.base import query


def _search(name, where="true", rows=10, page=1, grouping=1, **fields):
    sql = oracle.searched(where, grouping != 0, rows, page)

    @query(name, sql)
    def run(spark, sf_dir):
        return plan.search(inputs.capture(spark, sf_dir), rows=rows, page=page, grouping=grouping, **fields)

    run.__name__ = name


def _rows(name, where, **fields):
    """All matching rows, ungrouped and unpaged."""
    sql = oracle.on("capture", f"SELECT id, datetime, callid FROM capture WHERE {where}")

    @query(name, sql)
    def run(spark, sf_dir):
        return plan.matches(inputs.capture(spark, sf_dir), grouping=0, **fields).select("id", "datetime", "callid")

    run.__name__ = name


_rows("search_malformed", "malformed = 1", malformed=1)
_rows("search_source_ip", f"{oracle.ip('source_ip')} = '10.0.1.1'", src_ip="10.0.1.1")
_rows("search_destination_ip", f"{oracle.ip('destination_ip')} = '192.168.1.5'", dst_ip="192.168.1.5")
_rows("search_call_id", "callid = 'call-3' OR callid_rc = 'call-3'", sip_callid="call-3")
_rows("search_method", "request_method = 'REGISTER'", sip_method="REGISTER")
_rows(
    "search_from_number",
    "\"from\" IN ('6505550012', '+6505550012', '+16505550012', '16505550012')",
    from_user="6505550012",
)
_rows(
    "search_from_pattern",
    "\"from\" LIKE '650555%_2' OR \"from\" LIKE '+650555%_2' OR \"from\" LIKE '+1650555%_2' OR \"from\" LIKE '1650555%_2'",
    from_user="650555%_2",
)
_rows("search_to_number", "\"to\" IN ('4085550031', '+4085550031', '+14085550031', '14085550031')", to_user="4085550031")
_rows("search_to_pattern", "\"to\" LIKE '408555__3%'", to_user="408555__3%")
_rows(
    "search_time_range",
    "datetime >= TIMESTAMP '2024-01-03 06:00:00' AND datetime <= TIMESTAMP '2024-01-12 18:30:00'",
    date_start="2024-01-03 06:00:00",
    date_end="2024-01-12 18:30:00",
)
_rows("search_ports", "source_port = 5060 AND destination_port = 1030", src_port=5060, dst_port=1030)
_rows("search_no_filter", "true")
_rows("search_case_insensitive", "lower(request_method) = 'invite'", sip_method="invite", ci=True)

_search("search_first_page")
_search("search_page", rows=50, page=3)
_search("search_ungrouped_page", rows=25, page=2, grouping=0)
_search("search_deep_page", rows=50, page=201, grouping=0)
_search(
    "search_combined",
    "request_method = 'INVITE' AND datetime >= TIMESTAMP '2024-01-02 00:00:00' AND from_user LIKE '%650555%' AND malformed = 1",
    rows=20,
    malformed=1,
    sip_method="INVITE",
    date_start="2024-01-02 00:00:00",
    from_user="%650555%",
)
_search(
    "search_call_messages",
    "callid = 'call-3' OR callid_rc = 'call-3'",
    rows=1000,
    page=0,
    grouping=0,
    sip_callid="call-3",
)


@query("group_by_call", oracle.on("capture", f"SELECT {oracle.RESULT} FROM found", oracle.matching()))
def group_by_call(spark, sf_dir):
    return plan.call_groups(inputs.capture(spark, sf_dir))


@query(
    "found_rows",
    oracle.on("capture", "SELECT CAST(count(*) AS BIGINT) AS total FROM (SELECT callid FROM capture WHERE malformed = 1 GROUP BY callid)"),
)
def found_rows(spark, sf_dir):
    return plan.total(inputs.capture(spark, sf_dir), malformed=1)


@query("time_order", oracle.on("capture", "SELECT id, datetime FROM capture ORDER BY datetime, id LIMIT 500"))
def time_order(spark, sf_dir):
    found = plan.matches(inputs.capture(spark, sf_dir), grouping=0)
    return plan.take_page(found, 500, 0).select("id", "datetime")


@query("time_order_all", oracle.on("capture", "SELECT id, datetime, row_number() OVER (ORDER BY datetime, id) AS place FROM capture"))
def time_order_all(spark, sf_dir):
    found = plan.matches(inputs.capture(spark, sf_dir), grouping=0)
    return plan.in_time_order(found).select("id", "datetime", "place")


@query(
    "sort_grid",
    oracle.on("capture", f"SELECT {oracle.RESULT} FROM found WHERE malformed = 1 ORDER BY method DESC, from_user, id", oracle.matching()),
)
def sort_grid(spark, sf_dir):
    found = plan.call_groups(inputs.capture(spark, sf_dir)).where("malformed = 1")
    return plan.sort_grid(found, "method,from_user,id", "desc,asc,asc")


_DOCUMENT = """{'id': id, 'date': date, 'source_ip': source_ip, 'destination_ip': destination_ip, 'callid': callid, 'method': method,
  'from_user': from_user, 'to_user': to_user, 'color': palette || ':' || colour::VARCHAR}"""


@query(
    "search_response",
    oracle.on(
        "capture",
        f"""SELECT to_json({{'result': 'success', 'msg': 'success msg', 'total': (SELECT count(*) FROM found),
          'rows': (SELECT list({_DOCUMENT} ORDER BY datetime, id) FROM (SELECT * FROM found ORDER BY datetime, id LIMIT 10))}})::VARCHAR AS document""",
        oracle.matching(),
    ),
)
def search_response(spark, sf_dir):
    return plan.search_document(inputs.capture(spark, sf_dir))


@query(
    "search_response_empty",
    oracle.on(
        "capture",
        """SELECT CASE WHEN (SELECT count(*) FROM capture WHERE callid = 'no such call' OR callid_rc = 'no such call') = 0
           THEN '{"result":"warning","msg":"Records not found","rows":[]}' END AS document""",
    ),
)
def search_response_empty(spark, sf_dir):
    return plan.search_document(inputs.capture(spark, sf_dir), sip_callid="no such call")


@query(
    "endpoint_colour",
    oracle.on("capture", "SELECT id, colour, palette FROM shaped", oracle.COLOURS),
)
def endpoint_colour(spark, sf_dir):
    source = endpoint(F.col("source_ip"), F.col("source_port"))
    target = endpoint(F.col("destination_ip"), F.col("destination_port"))
    return inputs.capture(spark, sf_dir).select(
        "id", colour_bucket(source, target).alias("colour"), palette(F.col("malformed")).alias("palette")
    )


@query(
    "crc32",
    oracle.on(
        "capture",
        "SELECT source, destination, CAST(CASE WHEN crc >= 2147483648 THEN crc - 4294967296 ELSE crc END AS BIGINT) AS crc FROM checksums",
        oracle.COLOURS,
    ),
)
def crc32(spark, sf_dir):
    source = endpoint(F.col("source_ip"), F.col("source_port"))
    target = endpoint(F.col("destination_ip"), F.col("destination_port"))
    pairs = inputs.capture(spark, sf_dir).select(source.alias("source"), target.alias("destination")).distinct()
    return pairs.withColumn("crc", signed_crc32(F.concat_ws(" ", "source", "destination")))


def _grid(name, rules, where, match="all"):
    @query(name, oracle.on("capture", f"SELECT id, callid, request_method FROM capture WHERE {where}"))
    def run(spark, sf_dir):
        rows = inputs.capture(spark, sf_dir)
        return filters.rules_filter(rows, rules, match).select("id", "callid", "request_method")

    run.__name__ = name


_grid(
    "grid_rules_all",
    [("user_agent", "contains", "PHONE"), ("request_method", "beginwith", "in"), ("source_port", "less", 1060), ("id", "greaterorequal", 100)],
    "user_agent ILIKE '%phone%' AND request_method ILIKE 'in%' AND source_port < 1060 AND id >= 100",
)
_grid(
    "grid_rules_any",
    [("callid", "endwith", "77"), ("response_code", "equal", 503), ("request_method", "equal", "BYE")],
    "callid LIKE '%77' OR response_code = 503 OR request_method = 'BYE'",
    "any",
)
_grid(
    "grid_rules_bounds",
    [("request_method", "notequal", "ACK"), ("source_port", "lessorequal", 5060), ("destination_port", "greater", 1050)],
    "coalesce(request_method, '') <> 'ACK' AND source_port <= 5060 AND destination_port > 1050",
)
