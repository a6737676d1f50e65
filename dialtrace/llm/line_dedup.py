"""Removal of lines that many pages of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import SPACE, with_text
from dialtrace.session import keep

#: A line on more than this share of a host's pages is boilerplate, from so many pages on.
#: Of the 5418 places of the 35 lines that 50 pages or more of sf0.1 have, 0.1 finds 634, 0.05 1061,
#: 0.02 2973, 0.01 4219 and 0.005 4559; the most widespread line, on 4 to 13% of the pages of each
#: of the 20 sources, is found on all its 1061 pages from 0.05 down.
RATIO = 0.01
LEAST_PAGES = 5

HAS_WORD = f"[^{SPACE}]"
ENDS = f"^[{SPACE}]+|[{SPACE}]+$"


def line_key(line: Column) -> Column:
    """Lines that differ only in white space at their ends are the same line."""
    return F.xxhash64(F.regexp_replace(line, ENDS, ""))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Host and the keys of its boilerplate lines, one row per host that has any.

    The lists stay short whatever the number of pages: a page has L lines on average,
    so at most L / ratio of a host's lines can be on more than that share of its pages.
    Counting is combined in each task before the exchange, so a hot host or line sends
    one row per task.
    """
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.split("text", "\n").alias("lines"))
    keys = F.transform(F.filter("lines", lambda x: x.rlike(HAS_WORD)), line_key)
    counted = pages.select("host", F.explode(F.array_distinct(keys)).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("total"))
    common = counted.where(F.col("pages") >= least_pages).join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("total"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("common"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The documents without their boilerplate lines, and n_lines and n_dropped.

    A page is one row; a line counts once a page, without regard to white space at its
    ends. Lines without a word are never dropped. A missing host is a host of its own, a
    missing text stays missing and has no lines; repeated rows are pages of their own.
    All columns of the documents are returned; columns of theirs that are named n_lines
    or n_dropped are replaced. An empty table gives no rows. The table of hosts is joined by what its size allows:
    the planner broadcasts a small one and else shuffles by host, splitting hot hosts.
    """
    lines = keep(boilerplate(docs, host, ratio, least_pages), "boilerplate")
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(lines, "host", "left").select("row", "common", F.split("row.text", "\n").alias("lines"))
    left = joined.select(
        "row",
        "lines",
        F.when(F.col("common").isNull(), F.col("lines"))
        .otherwise(F.filter("lines", lambda x: ~(x.rlike(HAS_WORD) & F.array_contains(F.col("common"), line_key(x)))))
        .alias("left"),
    )
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    n_lines = F.when(F.col("lines").isNull(), F.lit(0).cast("bigint")).otherwise(size("lines"))
    n_left = F.when(F.col("left").isNull(), F.lit(0).cast("bigint")).otherwise(size("left"))
    counts = left.select("row", F.array_join("left", "\n").alias("new_text"), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"))
    return with_text(counts, "row", F.col("new_text"), F.col("n_lines"), F.col("n_dropped"))
