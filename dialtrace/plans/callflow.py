"""Call flows: correlated messages in order, with lanes, notes and styles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialtrace.functions.hashing import message_checksum
from dialtrace.functions.net import endpoint, ip_text
from dialtrace.functions.text import ascii_html, flow_note, message_label
from dialtrace.functions.time import microsecond_text
from dialtrace.operators.correlate import call_pairs, call_sessions, pair_sessions
from dialtrace.operators.ranking import first_per, top_distinct_per, top_per
from dialtrace.session import keep

# fixed values: limit, marker and text forms
FLOW_LIMIT = 1000
LIMIT_MARKER = "=== Limit reached ==="
FLOW_LINE = "%s %s %s  [label = '%s', note = '%s', color = '%s' ]; \n"
RENDERED = "DateTime: {time}\nSRC/DST IP: {source} -> {destination}\n\n{msg}"

ORDER = ["datetime", "id"]


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def rendered_message() -> Column:
    """Message text below its time and endpoints; NULL if any part is missing."""
    parts = {
        "{time}": microsecond_text(F.col("datetime")),
        "{source}": endpoint(F.col("source_ip"), F.col("source_port")),
        "{destination}": endpoint(F.col("destination_ip"), F.col("destination_port")),
        "{msg}": F.col("msg"),
    }
    pieces = re.split(r"(\{\w+\})", RENDERED)
    return F.concat(*[parts[piece] if piece in parts else F.lit(piece) for piece in pieces])


def message(capture: DataFrame, message_id: int) -> DataFrame:
    """The rendered message with an id."""
    return capture.where(F.col("id") == message_id).limit(1).select("id", rendered_message().alias("msg"))


def flow_rows(capture: DataFrame, null_collapses: bool = False) -> DataFrame:
    """The narrow columns of a message that a flow shows; ``msg`` itself stays behind."""
    return capture.select(
        "id",
        "datetime",
        F.coalesce("callid", F.lit("")).alias("callid"),
        F.coalesce("callid_rc", F.lit("")).alias("callid_rc"),
        ip_text(F.col("source_ip")).alias("source_ip"),
        ip_text(F.col("destination_ip")).alias("destination_ip"),
        message_label(F.col("request_method"), F.col("response_code")).alias("label"),
        flow_note(F.col("msg")).alias("note"),
        message_checksum(null_collapses).alias("chsumm"),
    )


def flow_members(capture: DataFrame) -> DataFrame:
    """``(session, id)``: every message of every flow, retransmissions included."""
    rows = capture.select(
        "id", F.coalesce("callid", F.lit("")).alias("callid"), F.coalesce("callid_rc", F.lit("")).alias("callid_rc")
    )
    sessions = pair_sessions(keep(call_pairs(capture), "pairs"))
    return rows.join(sessions, ["callid", "callid_rc"]).select("session", "id")


def call_flows(capture: DataFrame, null_collapses: bool = False) -> DataFrame:
    """All flows at once: up to 1000 messages per session in order, numbered from 1.

    A flow takes all or none of the rows of one ``(callid, callid_rc)`` pair, so
    the first 1000 of each pair are enough for the first 1000 of each flow. The
    rows are cut to that before they meet the sessions: a call that is in many
    flows repeats a bounded number of rows, and the cut loses nothing. The cut and
    the join use the same partitioning.
    """
    sessions = pair_sessions(keep(call_pairs(capture), "pairs"))
    rows = flow_rows(capture, null_collapses)
    originals = first_per(rows, ["callid", "callid_rc", "chsumm"], _order())
    leading = top_per(originals, ["callid", "callid_rc"], _order(), FLOW_LIMIT, "_n").drop("_n")
    return _numbered(leading.join(sessions, ["callid", "callid_rc"]))


def _numbered(joined: DataFrame) -> DataFrame:
    numbered = top_distinct_per(joined, ["session"], "chsumm", _order(), FLOW_LIMIT, "number")
    return numbered.select(
        "session", "number", "id", "datetime", "source_ip", "destination_ip", "label", "note"
    )


def seed_flows(capture: DataFrame) -> DataFrame:
    """The flow each message leads to: ``(id, session)``."""
    sessions = call_sessions(call_pairs(capture))
    return capture.where("callid <> ''").select("id", "callid").join(sessions, "callid").select("id", "session")


MAX_LISTED_KEYS = 1000
MAX_BROADCAST_KEYS = 1_000_000


def call_flow(capture: DataFrame, message_id: int, null_collapses: bool = False) -> DataFrame:
    """The flow that a message belongs to; empty if it has no call id.

    Three small lookups find the keys. Few keys become an IN list, which the
    Parquet scan can use; up to a million are broadcast; beyond that the rows are
    joined by shuffle.
    """
    spark = capture.sparkSession
    seed = capture.where((F.col("id") == message_id) & (F.col("callid") != "")).select("callid").limit(1).collect()
    if not seed:
        return _numbered(flow_rows(capture.limit(0)).withColumn("session", F.lit("")))
    callid = seed[0][0]
    rc = capture.where((F.col("callid") == callid) & (F.col("callid_rc") != "")).agg(F.min("callid_rc")).collect()[0][0]
    session = rc or callid
    calls = capture.where((F.col("callid_rc") == session) & (F.col("callid") != "")).select(F.col("callid").alias("key")).distinct()
    keys = calls.union(spark.createDataFrame([(session,)], "key string")).distinct()
    listed = [r[0] for r in keys.limit(MAX_LISTED_KEYS + 1).collect()]
    if len(listed) <= MAX_LISTED_KEYS:
        member = F.col("callid").isin(listed) | F.col("callid_rc").isin(listed)
        rows = capture.where(member)
    else:
        small = keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
        lookup = F.broadcast(keys) if small else keys
        by_call = capture.join(lookup, F.col("callid") == F.col("key"), "left_semi")
        by_session = capture.join(lookup, F.col("callid_rc") == F.col("key"), "left_semi").join(
            lookup, F.col("callid") == F.col("key"), "left_anti"
        )
        rows = by_call.union(by_session)
    return _numbered(flow_rows(rows, null_collapses).withColumn("session", F.lit(session)))


def lanes(flow: DataFrame) -> DataFrame:
    """Endpoints of each flow numbered from 1 by first appearance, source before destination."""
    seen = flow.select(
        "session",
        F.posexplode(F.array("source_ip", "destination_ip")).alias("side", "ip"),
        "number",
    ).where(F.col("ip").isNotNull())
    first = seen.groupBy("session", "ip").agg(F.min(F.col("number") * 2 + F.col("side")).alias("first_seen"))
    lane = F.row_number().over(W.partitionBy("session").orderBy("first_seen"))
    return first.select("session", "ip", lane.alias("lane"))


def lane_spans(flow: DataFrame) -> DataFrame:
    """Flow messages with their leftmost lane and the number of lanes they cross, at least 1.

    A flow holds at most 1000 messages, so its lanes fit in one map; the join is
    on the session only and reuses the partitioning of the flow.
    """
    by_session = lanes(flow).groupBy("session").agg(
        F.map_from_entries(F.collect_list(F.struct("ip", "lane"))).alias("lane_of")
    )
    placed = flow.join(by_session, "session")
    start, end = F.col("lane_of")[F.col("source_ip")], F.col("lane_of")[F.col("destination_ip")]
    return placed.withColumns(
        {"left_lane": F.least(start, end), "span": F.greatest(F.abs(start - end), F.lit(1))}
    ).drop("lane_of")


def status_colour(code: Column) -> Column:
    # fixed values: colours; the upper bound of each range stays black
    return (
        F.when(code.between(100, 198), "DodgerBlue")
        .when(code.between(200, 298), "LimeGreen")
        .when(code.between(300, 398), "yellow")
        .when(code.between(400, 698), "red")
        .otherwise("black")
    )


def status_arrow(code: Column) -> Column:
    solid = code.isNull() | code.between(200, 298) | code.between(400, 698)
    return F.when(solid, "->").otherwise("-->")


def label_code(label: Column) -> Column:
    """Number of a numeric label, NULL for a request."""
    return label.try_cast("int")


def flow_line() -> Column:
    """One line of the flow text."""
    code = label_code(F.col("label"))
    return F.format_string(
        FLOW_LINE, "source_ip", status_arrow(code), "destination_ip", "label", "note", status_colour(code)
    )


def flow_texts(flow: DataFrame) -> DataFrame:
    """Text of each flow, lines in order, with a marker where the limit was reached."""
    lines = flow.select("session", F.struct("number", flow_line().alias("line")).alias("entry"))
    grouped = lines.groupBy("session").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    text = F.array_join(F.col("entries.line"), "")
    reached = F.size("entries") >= FLOW_LIMIT
    return grouped.select(
        "session",
        F.size("entries").alias("messages"),
        reached.alias("limit_reached"),
        F.concat(text, F.when(reached, LIMIT_MARKER).otherwise("")).alias("flow"),
    )


def flow_messages(flow: DataFrame, capture: DataFrame) -> DataFrame:
    """Flow rows with their rendered messages, joined on the message id."""
    return capture.select("id", rendered_message().alias("rendered")).join(flow, "id")


def export_flows(flow: DataFrame, capture: DataFrame) -> DataFrame:
    """One JSON document per flow: its text and its messages by id, safe for HTML."""
    return _documents(flow, flow_messages(flow, capture))


def _documents(flow: DataFrame, messages: DataFrame) -> DataFrame:
    # an id that is stored several times has one message, that of its first line
    once = messages.groupBy("session", "id").agg(F.min(F.struct("number", "rendered")).alias("m"))
    entries = once.select(
        "session",
        F.struct("m.number", F.col("id").cast("string").alias("id"), ascii_html(F.col("m.rendered")).alias("text")).alias("entry"),
    )
    by_session = entries.groupBy("session").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    mapped = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["id"], e["text"])))
    return (
        flow_texts(flow)
        .join(by_session, "session")
        .select("session", F.to_json(F.struct("flow", mapped.alias("msg")), {"ignoreNullFields": "false"}).alias("document"))
    )


def export_flow(capture: DataFrame, message_id: int) -> DataFrame:
    """The document of one flow; its at most 1000 rows go to the scan of the messages."""
    flow = call_flow(capture, message_id)
    return _documents(flow, flow_messages(F.broadcast(flow), capture))
