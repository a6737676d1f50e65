"""Counters on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialtrace.functions.time import ns_to_timestamp
from dialtrace.operators.counters import FRAMING_BYTES, channel
from dialtrace.streaming.epochs import FANOUT, EpochStore


def second_counters(packets: DataFrame) -> DataFrame:
    """Packets and bytes per second and channel of the given packets."""
    timed = packets.select(
        F.date_trunc("second", ns_to_timestamp(F.col("timestamp_ns"))).alias("ts"), channel().alias("sensor"), F.col("len")
    )
    return timed.groupBy("ts", "sensor").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("len") + FRAMING_BYTES).cast("bigint").alias("bytes"),
    )


def last_gauges(metrics: DataFrame, interval: str = "60 seconds") -> DataFrame:
    """Last value of each gauge per interval, and when it was taken."""
    return (
        metrics.groupBy(F.window("ts", interval).alias("w"), "metric", "sensor")
        .agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("taken"))
        .select(F.col("w.start").alias("ts"), "metric", "sensor", "value", "taken")
    )


#: Partial results that epochs leave, and how those of several become one.
SECOND_COUNTERS = "ts TIMESTAMP, sensor STRING, packets BIGINT, bytes BIGINT"
LAST_GAUGES = "ts TIMESTAMP, metric STRING, sensor STRING, value DOUBLE, taken TIMESTAMP"


def sum_counters(partial: DataFrame) -> DataFrame:
    return partial.groupBy("ts", "sensor").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def newest_gauges(partial: DataFrame) -> DataFrame:
    return partial.groupBy("ts", "metric", "sensor").agg(F.max_by("value", "taken").alias("value"), F.max("taken").alias("taken"))


MERGES = {second_counters: (SECOND_COUNTERS, sum_counters), last_gauges: (LAST_GAUGES, newest_gauges)}


def write_partials(rows: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fanout: int = FANOUT) -> StreamingQuery:
    """Stores what ``partial`` makes of each micro-batch, and merges the results of many epochs in levels.

    There is no watermark and no state: a late row is part of its own batch, and the
    readers below put the partial results together, so nothing is lost however late it
    comes and however the input falls into batches. A batch that is run again replaces
    its own rows. A merge can be broken off anywhere and counts once it is whole, so
    readers open a few folders whatever the number of epochs.
    """
    store_of = EpochStore(rows.sparkSession, path, fanout)
    schema, merge = MERGES[partial]

    def store(batch: DataFrame, epoch: int) -> None:
        store_of.commit(epoch, {"partial": lambda folder: partial(batch).write.parquet(folder)})
        store_of.compact(epoch, {"partial": (schema, merge, [])})

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Per second and channel the sum of all partial counts."""
    return sum_counters(EpochStore(spark, path).read("partial", SECOND_COUNTERS))


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """Per interval and gauge the value taken last in any batch."""
    return newest_gauges(EpochStore(spark, path).read("partial", LAST_GAUGES)).drop("taken")


def tap(packets: DataFrame, name: str = "tap") -> tuple[DataFrame, Observation]:
    """Counts packets and bytes that flow through, at no extra pass."""
    seen = Observation(name)
    return packets.observe(
        seen, F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes")
    ), seen
