"""Stored tables that the registered queries read, one set per session and folder.

The first query of a session writes them from ``events`` to the shared working
folder; later ones scan them as they would scan the tables of a running system.
"""

from pyspark.sql import DataFrame, SparkSession

from dialtrace.plans.ingest import to_capture, to_sdp
from dialtrace.session import use_utc, work_dir
from dialtrace.sources import tables
from dialtrace.registry.wire import wire

_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = work_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def packet_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        rows = wire(spark, sf_dir)
        slots = spark.sparkContext.defaultParallelism
        # a small input arrives in one split; spread it over the task slots
        if rows.rdd.getNumPartitions() < slots:
            rows = rows.repartition(slots, "pkt_id")
        tables.write_packets(rows, path)

    return stored(spark, sf_dir, "packets", write)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_packets(spark, packet_path(spark, sf_dir))


def capture_path(spark: SparkSession, sf_dir: str) -> str:
    return stored(
        spark, sf_dir, "capture", lambda path: tables.append_capture(to_capture(packets(spark, sf_dir)), path)
    )


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_capture(spark, capture_path(spark, sf_dir))


def sdp_path(spark: SparkSession, sf_dir: str) -> str:
    return stored(spark, sf_dir, "sdp", lambda path: tables.append_sdp(to_sdp(packets(spark, sf_dir)), path))


def sdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_sdp(spark, sdp_path(spark, sf_dir))
