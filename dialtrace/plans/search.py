"""Message search: filter, one row per call, order, page, total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialtrace.functions.hashing import colour_bucket, palette
from dialtrace.functions.net import endpoint
from dialtrace.functions.text import message_label
from dialtrace.functions.time import epoch_seconds
from dialtrace.operators.filters import search_filter
from dialtrace.operators.ranking import first_per, numbered
from dialtrace.session import keep

# up to here Spark keeps the leading rows in a heap; later pages go by counts per time step
HEAP_ROWS = 10_000


def _order() -> list[Column]:
    return [F.col("datetime"), F.col("id")]


def matches(capture: DataFrame, grouping: int | str = 1, **fields) -> DataFrame:
    """Rows that satisfy the search fields; with grouping the first of each call.

    Rows without a call id form one group. ``msg`` is never read.
    """
    columns = [
        "id", "datetime", "source_ip", "source_port", "destination_ip", "destination_port",
        "callid", "request_method", "response_code", "from", "to", "malformed", "date",
    ]
    found = capture.where(search_filter(**fields)).select(*[f"`{c}`" for c in columns])
    return found if str(grouping) == "0" else first_per(found, ["callid"], _order())


def total(capture: DataFrame, grouping: int | str = 1, **fields) -> DataFrame:
    """Number of matches before paging, as one row; counts calls without ranking their rows."""
    found = capture.where(search_filter(**fields))
    if str(grouping) != "0":
        found = found.select("callid").distinct()
    return found.agg(F.count(F.lit(1)).alias("total"))


def call_groups(capture: DataFrame, **fields) -> DataFrame:
    """One row per call, the earliest, in result form."""
    return result_columns(matches(capture, 1, **fields))


def result_columns(rows: DataFrame) -> DataFrame:
    source = endpoint(F.col("source_ip"), F.col("source_port"))
    target = endpoint(F.col("destination_ip"), F.col("destination_port"))
    return rows.select(
        "id",
        "datetime",
        epoch_seconds(F.col("datetime")).alias("date"),
        source.alias("source_ip"),
        target.alias("destination_ip"),
        "callid",
        message_label(F.col("request_method"), F.col("response_code")).alias("method"),
        F.col("`from`").alias("from_user"),
        F.col("`to`").alias("to_user"),
        "malformed",
        colour_bucket(source, target).alias("colour"),
        palette(F.col("malformed")).alias("palette"),
    )


def page_bounds(rows: int | str | None = None, page: int | str | None = None) -> tuple[int, int]:
    """Limit and offset; defaults for missing or empty arguments."""
    limit = int(rows) if rows not in (None, "") else 10
    number = int(page) if page not in (None, "") else 1
    return limit, max(number - 1, 0) * limit


# time steps that narrow down a deep page, in microseconds
_STEPS = [3_600_000_000, 1_000_000]
# the step of rows without a time, which come first
_NO_TIME = -(2**62)


def in_time_order(found: DataFrame) -> DataFrame:
    """All rows with their place in time order, from 1, in column ``place``; for exports of whole results."""
    return numbered(found, _order(), "place")


def take_page(found: DataFrame, limit: int, offset: int) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` in time order, exactly.

    A page near the front is a top-k. For a page further back no task could hold
    all rows before it, so counts per hour, and per second inside the hours that
    matter, tell which seconds the page is in. Only the rows of those seconds are
    sorted, and their time limits reach the scan. Rows without a time come first on
    both ways, as a step of their own.
    """
    if offset + limit <= HEAP_ROWS:
        return found.orderBy(*_order()).offset(offset).limit(limit)
    rows = found
    for step in _STEPS:
        micros = F.unix_micros("datetime")
        slot = F.coalesce(F.call_function("div", micros - F.pmod(micros, F.lit(step)), F.lit(step)), F.lit(_NO_TIME))
        counts = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        # one row per time step, so the single-partition window stays small
        upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("slot")))
        hit = upto.where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit))
        first, last, before = hit.agg(F.min("slot"), F.max("slot"), F.min(F.col("upto") - F.col("n"))).first()
        if first is None:
            return found.limit(0)
        offset -= before
        if last == _NO_TIME:
            rows = rows.where(F.col("datetime").isNull())
            break
        end = F.timestamp_micros(F.lit((last + 1) * step))
        if first == _NO_TIME:
            rows = rows.where(F.col("datetime").isNull() | (F.col("datetime") < end))
            continue
        start = F.timestamp_micros(F.lit(first * step))
        rows = rows.where((F.col("datetime") >= start) & (F.col("datetime") < end))
        if "date" in rows.columns:
            rows = rows.where((F.col("date") >= F.to_date(start)) & (F.col("date") <= F.to_date(end)))
    return rows.orderBy(*_order()).offset(offset).limit(limit)


def search(
    capture: DataFrame,
    rows: int | str | None = None,
    page: int | str | None = None,
    grouping: int | str | None = 1,
    with_total: bool = True,
    **fields,
) -> DataFrame:
    """A page of search results, each row with the ``total`` of all pages."""
    grouping = 1 if grouping is None else grouping
    limit, offset = page_bounds(rows, page)
    found = matches(capture, grouping, **fields)
    if str(grouping) != "0" and offset + limit > HEAP_ROWS:
        # a deep page looks at the groups several times
        found = keep(found, "groups")
    result = result_columns(take_page(found, limit, offset))
    if with_total:
        result = result.withColumn("total", total(capture, grouping, **fields).scalar())
    return result


def search_document(capture: DataFrame, **arguments) -> DataFrame:
    """The page as one JSON document: result, msg, total, rows; a warning if nothing is found."""
    found = search(capture, **arguments)
    entry = F.struct(
        "id", "date", "source_ip", "destination_ip", "callid", "method", "from_user", "to_user",
        F.concat_ws(":", "palette", F.col("colour").cast("string")).alias("color"),
    )
    # at most one page of rows
    page = found.agg(
        F.sort_array(F.collect_list(F.struct("datetime", "id", entry.alias("entry")))).alias("page"),
        F.max("total").alias("total"),
    )
    entries = F.transform("page", lambda r: r["entry"])
    as_json = {"ignoreNullFields": "false"}
    success = F.to_json(
        F.struct(F.lit("success").alias("result"), F.lit("success msg").alias("msg"), "total", entries.alias("rows")), as_json
    )
    warning = F.to_json(
        F.struct(F.lit("warning").alias("result"), F.lit("Records not found").alias("msg"), entries.alias("rows")), as_json
    )
    return page.select(F.when(F.size("page") > 0, success).otherwise(warning).alias("document"))


def sort_grid(rows: DataFrame, names: str, orders: str) -> DataFrame:
    """Sort by comma-separated column names and directions."""
    keys = [
        F.col(f"`{name}`").asc() if order == "asc" else F.col(f"`{name}`").desc()
        for name, order in zip(names.split(","), orders.split(","), strict=True)
    ]
    return rows.orderBy(*keys)
