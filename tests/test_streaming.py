"""Streams give what the batch plan gives, in any number of micro-batches and after a restart."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialtrace.functions.hashing import message_checksum
from dialtrace.operators import counters
from dialtrace.plans.ingest import to_capture
from dialtrace.session import work_dir
from dialtrace.sources import tables
from dialtrace.streaming import ingest as stream
from dialtrace.streaming import metrics as stream_metrics


@pytest.fixture(scope="module")
def arriving(spark, packets):
    """The packets in four parts, in time order, one file each."""
    ordered = packets.withColumn("_part", F.ntile(4).over(Window.orderBy("timestamp_ns")))
    return [ordered.where(F.col("_part") == n).drop("_part").coalesce(1) for n in (1, 2, 3, 4)]


def test_ingest_in_batches_and_after_a_restart(spark, packets, arriving):
    path = work_dir(spark, "in")
    out, state = work_dir(spark, "out"), work_dir(spark, "state")
    for part in arriving:
        part.write.mode("append").parquet(path)
        source = tables.stream_packets(spark, path, files_per_trigger=1)
        stream.ingest(source, out, state).awaitTermination()
    # nothing new: a further start adds nothing
    stream.ingest(tables.stream_packets(spark, path), out, state).awaitTermination()
    stored, batch = tables.read_capture(spark, out).drop("date"), to_capture(packets)
    assert stored.count() == batch.count()
    assert stored.exceptAll(batch).count() == 0


def test_counters_over_batches(spark, packets, arriving):
    path = work_dir(spark, "in")
    out, state = work_dir(spark, "out"), work_dir(spark, "state")
    for part in arriving:
        part.write.mode("append").parquet(path)
    source = tables.stream_packets(spark, path, files_per_trigger=1)
    stream_metrics.write_partials(source, stream_metrics.second_counters, out, state).awaitTermination()
    got = stream_metrics.read_counters(spark, out).select("ts", "sensor", "packets", "bytes")
    expected = counters.per_second(packets).select("ts", "sensor", "packets", "bytes")
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0


def test_retransmissions_in_a_later_batch_are_dropped(spark, packets, arriving):
    path = work_dir(spark, "in")
    for part in arriving:
        part.write.mode("append").parquet(path)
    # the same packets again half a second later, as a file of its own
    late = arriving[3].withColumns(
        {"pkt_id": F.col("pkt_id") + 10**12, "timestamp_ns": F.col("timestamp_ns") + 500_000_000}
    )
    late.write.mode("append").parquet(path)
    out, state = work_dir(spark, "out"), work_dir(spark, "state")
    source = tables.stream_packets(spark, path, files_per_trigger=1)
    stream.ingest_deduplicated(source, out, state).awaitTermination()
    kept = spark.read.parquet(out)
    distinct = to_capture(packets).select(message_checksum().alias("c")).distinct()
    assert kept.count() == distinct.count() == kept.select("chsumm").distinct().count()


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_nothing_is_lost_when_the_newest_comes_first(spark, packets, arriving, files_per_batch):
    """Days of data in reverse order: the number of files in a batch changes nothing."""
    path = work_dir(spark, "in")
    for k, part in enumerate(reversed(arriving)):
        part.withColumn("timestamp_ns", F.col("timestamp_ns") - k * 3 * 86_400 * 10**9).write.mode("append").parquet(path)
    whole = tables.read_packets(spark, path)
    out, state, kept, kept_state = (work_dir(spark, x) for x in ("out", "state", "kept", "kept-state"))
    source = lambda: tables.stream_packets(spark, path, files_per_trigger=files_per_batch)
    stream_metrics.write_partials(source(), stream_metrics.second_counters, out, state).awaitTermination()
    got, expected = stream_metrics.read_counters(spark, out), counters.per_second(whole)
    columns = ["ts", "sensor", "packets", "bytes"]
    assert got.count() == expected.count() and got.select(columns).exceptAll(expected.select(columns)).isEmpty()
    stream.ingest_deduplicated(source(), kept, kept_state).awaitTermination()
    distinct = to_capture(whole).select(message_checksum().alias("c")).distinct()
    stored = spark.read.parquet(kept)
    assert stored.count() == distinct.count() == stored.select("chsumm").distinct().count()
    assert tables.read_capture(spark, kept).where("date IS NULL").isEmpty()


def test_tap_counts_what_flows(spark, packets):
    tapped, seen = stream_metrics.tap(packets, "test-tap")
    tapped.write.mode("overwrite").format("noop").save()
    assert seen.get["packets"] == packets.count()


def test_running_totals_do_not_depend_on_the_day_split(spark):
    rows = [(f"2024-01-0{1 + i // 3} 0{i}:00:00", "ch0", i, 10 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "t string, sensor string, packets bigint, bytes bigint").withColumn("ts", F.col("t").cast("timestamp"))
    got = counters.running(df.drop("t"), ["packets", "bytes"]).orderBy("ts").collect()
    assert [r["packets"] for r in got] == [sum(range(i + 1)) for i in range(9)]


def test_peak_waits_across_seconds(spark):
    from tests import make

    base = 1_700_000_000_000_000_000
    there = {"src_ip": 1, "dst_ip": 2, "src_port": 10, "dst_port": 20}
    back = {"src_ip": 2, "dst_ip": 1, "src_port": 20, "dst_port": 10}
    rows = [
        make.packet(1, "x", base, **there),
        make.packet(2, "x", base + 300_000_000, **back),
        make.packet(3, "x", base + 900_000_000, **there),
        make.packet(4, "x", base + 2_100_000_000, **back),
        make.packet(5, "x", base + 2_200_000_000, **{**there, "src_port": 11}),
    ]
    got = {r["second"] - 1_700_000_000: r["peak_us"] for r in counters.interval_peak(make.packets(spark, *rows)).collect()}
    assert got == {0: 600_000, 2: 1_200_000}


def test_sample_is_stable_and_about_right(spark, capture):
    first = {r["id"] for r in counters.sampled(capture, 0.1).select("id").collect()}
    again = {r["id"] for r in counters.sampled(capture.repartition(3), 0.1).select("id").collect()}
    assert first == again
    assert 0.05 < len(first) / capture.count() < 0.15
    assert counters.sampled(capture, 1.0).count() == capture.count()
