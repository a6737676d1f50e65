"""Upkeep of the stored capture table."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialtrace.plans.dashboards import latest
from dialtrace.sources import files, tables


def unexpired(capture: DataFrame, days: int = 1, now: str | None = None) -> DataFrame:
    """Rows younger than ``days``, counted back from ``now`` or else from the newest row."""
    end = F.lit(now).cast("timestamp") if now else latest(capture).scalar()
    start = end - F.make_dt_interval(days=F.lit(days))
    return capture.where((F.col("datetime") > start) & (F.col("date") >= F.to_date(start)))


def create_capture_table(spark: SparkSession, table: str, rows: DataFrame, location: str | None = None) -> None:
    """Stores rows (with ``date``) as a catalog table partitioned by day."""
    writer = rows.write.mode("overwrite").format("parquet").partitionBy("date")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)


def drop_expired_days(spark: SparkSession, table: str, now: str, days: int = 1) -> list[str]:
    """Drops the partitions that hold expired rows only; returns their days.

    Partition metadata only: no row is read or rewritten. The rows of the one day
    that is partly expired are left to :func:`unexpired`.
    """
    limit = (datetime.fromisoformat(now) - timedelta(days=days)).date().isoformat()
    present = [row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    expired = sorted(day for day in present if day < limit)
    for day in expired:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (date = DATE '{day}')")
    return expired


def _location(spark: SparkSession, table: str, day: str | None = None) -> str:
    of = f"PARTITION (date = DATE '{day}')" if day else ""
    rows = spark.sql(f"DESCRIBE FORMATTED {table} {of}").collect()
    return next(r[1] for r in rows if r[0].strip() == "Location")


def delete_expired(spark: SparkSession, table: str, now: str, days: int = 1) -> list[str]:
    """Deletes all rows that are ``days`` old at ``now``; returns the days that were dropped whole.

    Whole days go by partition metadata. The one day that is partly expired is written
    anew, without its expired rows, to a folder beside the table, and the partition is
    then pointed to that folder: one step of the catalog, so a reader sees the old day
    or the new one, and a rewrite that breaks off changes nothing. The old folder stays
    for readers that are under way and is removed by the next call. Only the rows of
    that one day are read. Rows without a time never expire.
    """
    aside = f"{_location(spark, table).rstrip('/')}-rewritten"
    notes = f"{aside}/superseded.json"
    if "superseded.json" in files.names(spark, aside):
        for folder in json.loads(files.read_text(spark, notes)):
            files.remove(spark, folder)
        files.put_text(spark, notes, "[]")
    dropped = drop_expired_days(spark, table, now, days)
    limit = datetime.fromisoformat(now) - timedelta(days=days)
    day = limit.date().isoformat()
    if f"date={day}" not in [row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]:
        return dropped
    rows = spark.table(table).where(F.col("date") == F.lit(day).cast("date"))
    expired = F.col("datetime") <= F.lit(limit.isoformat(" ")).cast("timestamp")
    if rows.where(expired).isEmpty():
        return dropped
    folder = f"{aside}/{day}-{uuid.uuid4().hex}"
    tables.day_writer(rows.where(F.coalesce(~expired, F.lit(True))).drop("date")).parquet(folder)
    old = _location(spark, table, day)
    spark.sql(f"ALTER TABLE {table} PARTITION (date = DATE '{day}') SET LOCATION '{folder}'")
    spark.catalog.refreshTable(table)
    files.put_text(spark, notes, json.dumps([old]))
    return dropped


def refresh_statistics(spark: SparkSession, table: str) -> None:
    """Row count, and statistics for the planner of all columns but the wide ``msg``, which nothing joins or filters on."""
    columns = ", ".join(f"`{c}`" for c in spark.table(table).columns if c != "msg")
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {columns}")


def column_statistics(spark: SparkSession, table: str, column: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE EXTENDED {table} `{column}`").collect()
    return {row[0]: row[1] for row in rows}
