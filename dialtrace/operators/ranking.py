"""First and top-k rows per group, bounded per task whatever the group size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialtrace.session import keep


def first_per(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """First row of each group.

    Spark keeps one row per group and task ahead of the exchange for a rank
    filter, so a group of any size sends only as many rows as there are tasks.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, number: str) -> DataFrame:
    """First ``k`` rows of each group, numbered from 1 in column ``number``.

    As above at most ``k`` rows of a group leave each task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(number, rank).where(F.col(number) <= k)


def top_distinct_per(
    df: DataFrame, keys: list[str], distinct: str, order: list[Column], k: int, number: str, salts: int = 32
) -> DataFrame:
    """First ``k`` rows of each group after keeping one row per value of ``distinct``.

    One row per value leaves each task, and values are spread over all tasks however
    large their group is. Of those at most ``k`` rows of a group leave each task, to
    ``salts`` tasks a group, so the task that numbers a group in the end sees at most
    ``k * salts`` of its rows.
    """
    unique = first_per(df, [*keys, distinct], order).withColumn("_salt", F.pmod(F.xxhash64(distinct), F.lit(salts)))
    return top_per(top_per(unique, [*keys, "_salt"], order, k, "_rank").drop("_rank", "_salt"), keys, order, k, number)


def numbered(df: DataFrame, order: list, number: str, first: int = 1, weight: Column | None = None) -> DataFrame:
    """All rows in order, each with its place in column ``number``, counted from ``first``.

    With ``weight`` the number is ``first`` plus the weights of all rows before it. Rows
    are cut into ranges of the order and stored; each range is numbered by itself, on top
    of what the ranges before it add up to, so no task sees more than a range. Rows that
    are equal in ``order`` have different numbers in no particular order. Without rows
    there are none.
    """
    one = F.lit(1) if weight is None else weight
    rows = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # as many rows as the shuffle has partitions
    sizes = rows.groupBy("_range").agg(F.sum(one).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_before"))
    within = F.sum(one).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "_range")
    return placed.withColumn(number, (F.col("_before") + F.col("_within") + first).cast("bigint")).drop("_range", "_before", "_within")
