"""Continuous ingest: the batch plan of packets to capture rows on a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialtrace import schemas
from dialtrace.functions.hashing import message_checksum
from dialtrace.operators.ranking import first_per
from dialtrace.operators.validate import reject_reason
from dialtrace.plans.ingest import capture_rows, checked_with_codecs, codec_rows, to_capture, to_rejects
from dialtrace.sources import tables
from dialtrace.streaming.epochs import EpochStore


def _start(writer, path: str, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def ingest(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the capture rows of a packet stream to a Parquet table by day, exactly once."""
    rows = to_capture(packets).withColumn("date", F.to_date("datetime"))
    return _start(rows.writeStream.format("parquet").outputMode("append").partitionBy("date"), path, checkpoint)


def publish(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publishes one text record per row; a Kafka sink takes the same ``value`` column."""
    return _start(messages.select("value").writeStream.format("text").outputMode("append"), path, checkpoint)


def _per_batch(rows: DataFrame, store, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_all(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores capture rows, codecs, rejected packets and an account of them, all of an epoch at once.

    Each micro-batch is parsed once and kept until its tables are written. The tables
    have the layout of the batch plan and are read by :func:`read_table`. A batch that
    is run again, wherever it was broken off, replaces its rows in all tables. The
    account has packets, bytes, stored, rejected and malformed packets of each epoch.
    """
    spark = packets.sparkSession
    tables_of = EpochStore(spark, path)

    def store(batch: DataFrame, epoch: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("bytes"),
                                F.count(reject_reason()).alias("rejected"))
        checked = checked_with_codecs(counted).persist(StorageLevel.DISK_ONLY)
        try:
            malformed = checked.where("malformed = 1").count()

            def account(folder: str) -> None:
                got = seen.get
                row = (epoch, got["packets"], got["bytes"], got["packets"] - got["rejected"], got["rejected"], malformed)
                batch.sparkSession.createDataFrame([row], ACCOUNT).coalesce(1).write.parquet(folder)

            tables_of.commit(
                epoch,
                {
                    "capture": lambda folder: tables.append_capture(capture_rows(checked), folder),
                    "sdp": lambda folder: tables.append_by_day(codec_rows(checked), folder),
                    "rejects": lambda folder: tables.append_by_day(to_rejects(batch), folder),
                    "account": account,
                },
            )
        finally:
            checked.unpersist()
        tables_of.compact(epoch, {"account": (ACCOUNT, lambda rows: rows.coalesce(1), [])})

    return _per_batch(packets, store, checkpoint)


#: Per epoch: what came in, and what became of it.
ACCOUNT = "epoch BIGINT, packets BIGINT, bytes BIGINT, stored BIGINT, rejected BIGINT, malformed BIGINT"
TABLES = {"capture": f"{schemas.CAPTURE}, date DATE", "sdp": f"{schemas.SDP}, date DATE", "rejects": schemas.REJECT, "account": ACCOUNT}


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of :func:`ingest_all`: capture, sdp, rejects or account."""
    return EpochStore(spark, path).read(table, TABLES[table])


CHECKSUMS = "chsumm STRING, date DATE"
DEDUPLICATED = f"{schemas.CAPTURE}, chsumm STRING, date DATE"


def ingest_deduplicated(packets: DataFrame, path: str, checkpoint: str, days: int = 1) -> StreamingQuery:
    """Stores one capture row per checksum, whatever the order and lateness of its copies.

    A micro-batch is reduced to the first row of each checksum and held against the
    checksums stored so far: copies are at most ``days`` apart in their own times, so
    only the days of the batch and those next to them are read, of a table that has
    nothing but checksums by day and whose epochs are merged in levels. What a batch
    reads so depends on its days and not on the age of the stream or its table.
    Rows and checksums of an epoch appear at once; a batch that is run again replaces
    its own and is not held against them. ``read_deduplicated`` gives the rows; any
    reader of the path finds them too, as the checksums are hidden from it.
    """
    store_of = EpochStore(packets.sparkSession, path, hidden=("checksums",))

    def store(batch: DataFrame, epoch: int) -> None:
        rows = first_per(batch.withColumn("chsumm", message_checksum()), ["chsumm"], [F.col("datetime"), F.col("id")])
        dated = rows.withColumn("date", F.to_date("datetime")).persist(StorageLevel.DISK_ONLY)
        try:
            # days of one batch are few; they become a filter on folders
            near = {r["date"] + timedelta(days=k) for r in dated.select("date").distinct().collect() if r["date"] for k in range(-days, days + 1)}
            stored = store_of.read("checksums", CHECKSUMS, before=epoch)
            close = stored.where(F.col("date").isin(sorted(near)) | F.col("date").isNull()) if near else stored.where("date IS NULL")
            fresh = dated.join(close.select("chsumm").distinct(), "chsumm", "left_anti").persist(StorageLevel.DISK_ONLY)
            store_of.commit(
                epoch,
                {
                    "capture": lambda folder: tables.append_by_day(fresh, folder),
                    "checksums": lambda folder: tables.append_by_day(fresh.select("chsumm", "date"), folder),
                },
            )
            fresh.unpersist()
        finally:
            dated.unpersist()
        store_of.compact(epoch, {"checksums": (CHECKSUMS, lambda rows: rows.hint("rebalance", "date"), ["date"])})

    return _per_batch(to_capture(packets), store, checkpoint)


def read_deduplicated(spark: SparkSession, path: str) -> DataFrame:
    return EpochStore(spark, path).read("capture", DEDUPLICATED)
