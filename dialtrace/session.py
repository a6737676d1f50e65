"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from dialtrace.sources import files


def local_session(cores: str = "*", app: str = "dialtrace", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All stored times are UTC, so every reader works in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder: on a cluster the executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="dialtrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run; the session's own setting comes back after it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Writes an intermediate result to the shared folder and goes on from there.

    For results that several later steps read: they are computed once, survive the
    loss of executors, and the planner knows their size. What was shuffled to make them
    goes at once.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(parts: list[DataFrame], purpose: str, key: str) -> DataFrame:
    """``keep`` of all parts together in buckets of a key: a join on the key shuffles its other side alone, however often it is made.

    The parts are written one after the other, so the shuffle files of one are all there
    are at once. Rows that were just grouped by the key are in their buckets already.
    """
    spark = parts[0].sparkSession
    path = work_dir(spark, purpose)
    name, buckets = table_name(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_freed(spark):
        for part in parts:
            part.write.mode("append").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def table_name(path: str) -> str:
    """The catalog's name of a folder that ``keep_by`` wrote."""
    return path.rsplit("/", 1)[1].replace("-", "_")


def free(*kept: DataFrame) -> None:
    """Deletes results of ``keep`` that nothing reads any more, nor what is made of them."""
    for df in kept:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS `{table_name(folder)}`")
            files.remove(df.sparkSession, folder)
