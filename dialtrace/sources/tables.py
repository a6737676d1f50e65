"""Stored tables: packets, capture rows and codecs, partitioned by UTC day."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialtrace import schemas


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PACKET).parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The packet folder as a stream; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schemas.PACKET)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# lookups by these columns go to few row groups: Parquet keeps a Bloom filter for each
LOOKUP_COLUMNS = ["id", "callid", "callid_rc"]


def day_layout(rows: DataFrame, gather: bool = True) -> DataFrame:
    """Adds the day and puts the rows of a call together inside each file.

    With ``gather`` the rows of a day move to common files. The rebalance step evens
    out the files and splits a day that is much larger than the others, along the
    order of arrival, so the time ranges of the files stay narrow. Input that comes
    in order of time has few days per task anyway and needs no such step.
    """
    dated = rows.withColumn("date", F.to_date("datetime"))
    if gather:
        dated = dated.hint("rebalance", "date")
    return dated.sortWithinPartitions("date", "callid", "datetime")


def _with_filters(writer):
    for column in LOOKUP_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def append_capture(rows: DataFrame, path: str, gather: bool = True) -> None:
    _with_filters(day_layout(rows, gather).write.mode("append").partitionBy("date")).parquet(path)


def day_writer(rows: DataFrame):
    """Writer of the rows of one day, in the layout of the others."""
    return _with_filters(rows.hint("rebalance").sortWithinPartitions("callid", "datetime").write)


def append_by_day(rows: DataFrame, path: str) -> None:
    """Appends rows that have a day, each day's rows gathered and large days split."""
    rows.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


append_sdp = append_by_day


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.CAPTURE}, date DATE").parquet(path)


def read_sdp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.SDP}, date DATE").parquet(path)


def write_packets(packets: DataFrame, path: str) -> None:
    packets.write.mode("append").parquet(path)


