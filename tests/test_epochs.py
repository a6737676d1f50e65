"""Tables that a stream advances together: restarts, merges in levels, and what a batch reads."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from dialtrace import maintenance
from dialtrace.functions.hashing import message_checksum
from dialtrace.operators import counters
from dialtrace.plans.ingest import to_capture, to_rejects, to_sdp
from dialtrace.session import work_dir
from dialtrace.sources import files, tables
from dialtrace.streaming import ingest as stream
from dialtrace.streaming import metrics as stream_metrics
from dialtrace.streaming.epochs import EpochStore

SUMS = "k INT, n BIGINT"


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def add(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def put(spark, store, epoch, rows):
    df = spark.createDataFrame(rows, SUMS).coalesce(1)
    store.commit(epoch, {"sums": lambda folder: df.write.parquet(folder)})


def test_many_epochs_are_a_few_folders_with_equal_sums(spark):
    store = EpochStore(spark, work_dir(spark, "levels"), fanout=3)
    for epoch in range(40):
        put(spark, store, epoch, [(epoch % 3, epoch), (5, 1)])
        store.compact(epoch, {"sums": (SUMS, add, [])})
    expected = {0: sum(range(0, 40, 3)), 1: sum(range(1, 40, 3)), 2: sum(range(2, 40, 3)), 5: 40}
    assert {r["k"]: r["n"] for r in add(store.read("sums", SUMS)).collect()} == expected
    # two entries of each level at most and those of the newest epochs
    assert len(store.folders("sums")) <= 2 * 4 + 2
    assert max(e.level for e in store.entries()) == 3
    # what was merged is gone from the disk but for the last two steps
    assert len(files.names(spark, f"{store.path}/data/sums")) <= 3 * len(store.folders("sums"))


def test_merge_that_breaks_off_changes_nothing(spark, monkeypatch):
    store = EpochStore(spark, work_dir(spark, "crash"), fanout=3)
    for epoch in range(5):
        put(spark, store, epoch, [(1, epoch)])
    whole = add(store.read("sums", SUMS)).collect()

    def broken(entry):
        raise OSError("lost")

    monkeypatch.setattr(store, "_publish", broken)
    with pytest.raises(OSError):
        store.compact(5, {"sums": (SUMS, add, [])})
    monkeypatch.undo()
    assert add(store.read("sums", SUMS)).collect() == whole
    assert len(store.folders("sums")) == 5
    store.compact(5, {"sums": (SUMS, add, [])})
    assert add(store.read("sums", SUMS)).collect() == whole
    assert len(store.folders("sums")) == 3
    # the folder of the broken merge was removed
    assert len(files.names(spark, f"{store.path}/data/sums")) == 6


def test_epoch_that_is_run_again_replaces_its_rows(spark):
    store = EpochStore(spark, work_dir(spark, "again"))
    put(spark, store, 0, [(1, 1)])
    put(spark, store, 1, [(1, 10)])
    put(spark, store, 1, [(1, 20)])
    assert add(store.read("sums", SUMS)).first()["n"] == 21
    assert add(store.read("sums", SUMS, before=1)).first()["n"] == 1
    assert EpochStore(spark, work_dir(spark, "none")).read("sums", SUMS).isEmpty()


@pytest.fixture(scope="module")
def faulty(spark, packets):
    """Packets of which some do not reach the parser, as four files."""
    path = work_dir(spark, "faulty")
    wrong = packets.withColumn("len", F.when(F.col("pkt_id") % 107 == 0, F.col("len") + 1).otherwise(F.col("len")))
    wrong.repartitionByRange(4, "timestamp_ns").write.parquet(path)
    return path


@pytest.mark.parametrize("broken", ["rejects", "log"])
def test_restart_between_tables_stores_each_row_once(spark, faulty, monkeypatch, broken):
    out, state = work_dir(spark, "all"), work_dir(spark, "all-state")
    start = lambda: stream.ingest_all(tables.stream_packets(spark, faulty, 1), out, state)
    plain, calls = EpochStore.commit, []

    def fails(self, epoch, parts):
        def lost(folder):
            raise OSError("lost")

        calls.append(epoch)
        if epoch == 2 and calls.count(2) == 1:
            if broken == "log":
                monkeypatch.setattr(EpochStore, "_publish", lambda self, entry: lost(None))
            else:
                parts = {**parts, broken: lost}
        plain(self, epoch, parts)

    monkeypatch.setattr(EpochStore, "commit", fails)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    monkeypatch.undo()
    # nothing of the epoch that broke off is seen, in no table
    assert stream.read_table(spark, out, "account").count() == 2
    start().awaitTermination()
    start().awaitTermination()
    whole = tables.read_packets(spark, faulty)
    capture = to_capture(whole)
    assert same(stream.read_table(spark, out, "capture").drop("date"), capture)
    assert same(stream.read_table(spark, out, "sdp"), to_sdp(whole))
    assert same(stream.read_table(spark, out, "rejects"), to_rejects(whole))
    account = stream.read_table(spark, out, "account").agg(*[F.sum(c) for c in ("packets", "bytes", "stored", "rejected", "malformed")]).first()
    stored = capture.count()
    rejects = whole.count() - stored
    assert rejects > 0
    assert tuple(account) == (whole.count(), whole.agg(F.sum("len")).first()[0], stored, rejects, capture.where("malformed = 1").count())


def test_streamed_files_have_the_layout_of_the_batch(spark, faulty):
    out = work_dir(spark, "layout")
    stream.ingest_all(tables.stream_packets(spark, faulty), out, work_dir(spark, "layout-state")).awaitTermination()
    found = glob.glob(f"{out}/data/capture/run=*/date=*/*.parquet")
    assert found
    import pyarrow.parquet as pq

    first = pq.read_table(found[0], columns=["callid", "datetime"], partitioning=None).to_pylist()
    keys = [(r["callid"] or "", r["datetime"]) for r in first]
    assert keys == sorted(keys)
    # a call that is nowhere is looked for in filters, not in rows
    raw = open(found[0], "rb").read()
    meta = pq.ParquetFile(found[0]).metadata.row_group(0)
    chunk = sum(meta.column(i).total_compressed_size for i in range(meta.num_columns))
    assert len(raw) - chunk > 3 * 32  # three filters stand between the columns and the footer


def test_deduplication_reads_the_days_of_the_batch_only(spark, packets):
    """Twenty days in twenty batches, with copies: a batch reads as much as the one before."""
    path, out, state = work_dir(spark, "days"), work_dir(spark, "days-out"), work_dir(spark, "days-state")
    some = packets.where("pkt_id < 1000000000").orderBy("timestamp_ns").limit(60).cache()
    day = 86_400 * 10**9
    base = int(datetime(2024, 3, 1).timestamp()) * 10**9
    for k in range(20):
        # each day has messages of its own, and copies of them 1 ms later
        shifted = some.withColumns({"timestamp_ns": F.lit(base + k * day) + F.col("pkt_id") * 1000, "src_port": F.lit(2000 + k)})
        copies = shifted.withColumns({"pkt_id": F.col("pkt_id") + 10**9, "timestamp_ns": F.col("timestamp_ns") + 10**6})
        shifted.unionByName(copies).coalesce(1).write.mode("append").parquet(path)
    reads = []
    plain = EpochStore.read

    def counted(self, table, schema, before=None):
        rows = plain(self, table, schema, before)
        if table == "checksums":
            reads.append(rows)
        return rows

    EpochStore.read = counted
    try:
        stream.ingest_deduplicated(tables.stream_packets(spark, path, 1), out, state).awaitTermination()
    finally:
        EpochStore.read = plain
    stored = stream.read_deduplicated(spark, out)
    distinct = to_capture(tables.read_packets(spark, path)).select(message_checksum().alias("c")).distinct()
    assert len(reads) == 20
    assert stored.count() == distinct.count() == stored.select("chsumm").distinct().count()
    # folders that a batch opens: bounded by the levels, not by the batches
    assert len(EpochStore(spark, out).folders("checksums")) <= 2 * 8
    # and of those only the days of the batch and next to it
    near = [datetime(2024, 3, 19).date() + timedelta(days=x) for x in range(3)]
    last = EpochStore(spark, out).read("checksums", stream.CHECKSUMS).where(F.col("date").isin(near))
    assert len({f.split("/date=")[1].split("/")[0] for f in last.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) <= 3


def test_copy_of_a_stored_row_a_day_late_is_dropped(spark, packets):
    path, out, state = work_dir(spark, "late"), work_dir(spark, "late-out"), work_dir(spark, "late-state")
    some = packets.limit(50).cache()
    hours = 3600 * 10**9
    for k, shift in enumerate((0, 20 * hours, -20 * hours)):
        some.withColumns({"pkt_id": F.col("pkt_id") + k * 10**10, "timestamp_ns": F.col("timestamp_ns") + shift}).coalesce(1).write.mode("append").parquet(path)
    stream.ingest_deduplicated(tables.stream_packets(spark, path, 1), out, state).awaitTermination()
    assert stream.read_deduplicated(spark, out).count() == to_capture(some).select(message_checksum().alias("c")).distinct().count()


def test_counters_of_many_epochs(spark, packets):
    path, out, state = work_dir(spark, "many"), work_dir(spark, "many-out"), work_dir(spark, "many-state")
    packets.repartitionByRange(12, "timestamp_ns").write.parquet(path)
    run = stream_metrics.write_partials(tables.stream_packets(spark, path, 1), stream_metrics.second_counters, out, state, fanout=3)
    run.awaitTermination()
    assert len(EpochStore(spark, out).folders("partial")) <= 8
    columns = ["ts", "sensor", "packets", "bytes"]
    assert same(stream_metrics.read_counters(spark, out).select(columns), counters.per_second(packets).select(columns))


@pytest.fixture
def table(spark):
    location = work_dir(spark, "expiring")
    name = "t_" + location.rsplit("-", 1)[1]
    rows = [(k, datetime(2024, 1, 10) + timedelta(hours=k)) for k in range(60)]
    df = spark.createDataFrame(rows, "id BIGINT, t TIMESTAMP").select("id", F.col("t").alias("datetime"), F.lit("c").alias("callid"), F.lit(None).cast("string").alias("callid_rc"))
    maintenance.create_capture_table(spark, name, df.withColumn("date", F.to_date("datetime")), location)
    yield name, location
    spark.sql(f"DROP TABLE {name}")


def test_no_expired_row_is_left_and_readers_see_one_or_the_other(spark, table):
    name, location = table
    old = spark.table(name).where("date = DATE '2024-01-11'").inputFiles()
    dropped = maintenance.delete_expired(spark, name, "2024-01-12 06:00:00")
    assert dropped == ["2024-01-10"]
    assert sorted(r["id"] for r in spark.table(name).select("id").collect()) == list(range(31, 60))
    # a reader that has listed the old files still has them
    assert spark.read.parquet(*old).count() == 24
    maintenance.delete_expired(spark, name, "2024-01-12 10:00:00")
    assert sorted(r["id"] for r in spark.table(name).select("id").collect()) == list(range(35, 60))
    assert not glob.glob(f"{location}/date=2024-01-11/*.parquet")
    # nothing to do: nothing is written, and what the last call had left for readers goes
    maintenance.delete_expired(spark, name, "2024-01-12 10:00:00")
    assert len([x for x in files.names(spark, f"{location}-rewritten") if x.startswith("2024-01-11")]) == 1
    assert sorted(r["id"] for r in spark.table(name).select("id").collect()) == list(range(35, 60))


def test_rewrite_that_breaks_off_changes_nothing(spark, table, monkeypatch):
    name, _ = table
    plain = tables.day_writer

    def broken(rows):
        raise OSError("lost")

    monkeypatch.setattr(tables, "day_writer", broken)
    with pytest.raises(OSError):
        maintenance.delete_expired(spark, name, "2024-01-12 06:00:00")
    monkeypatch.setattr(tables, "day_writer", plain)
    assert spark.table(name).where("date = DATE '2024-01-11'").count() == 24
    maintenance.delete_expired(spark, name, "2024-01-12 06:00:00")
    assert spark.table(name).count() == 29


def test_wait_quantiles_are_close_to_exact(spark, packets):
    from dialtrace.functions.net import symmetric_flow

    key = symmetric_flow(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    exact = counters.waits(packets, key)
    found = counters.wait_quantiles(counters.wait_sketches(packets))
    for r in found.collect():
        rank = int(r["metric"].rsplit("p", 1)[1]) / 100
        mine = exact.where(F.col("sensor") == r["sensor"])
        below = mine.where(F.col("wait") <= r["value"]).count() / mine.count()
        strictly = mine.where(F.col("wait") < r["value"]).count() / mine.count()
        assert strictly - 0.02 <= rank <= below + 0.02
