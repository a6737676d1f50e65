"""Small files next to stored tables, on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = _at(spark, folder)
    return sorted(status.getPath().getName() for status in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in one step: readers see the old content, the new one, or no file before there was any."""
    fs, where = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{where.getName()}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, where, overwrite)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
