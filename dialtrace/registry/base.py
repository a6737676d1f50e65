"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialtrace.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def naive_times(df: DataFrame) -> DataFrame:
    """UTC times without zone, as the checking engine returns them."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        columns.append(column.cast("timestamp_ntz").alias(field.name) if isinstance(field.dataType, T.TimestampType) else column)
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Registers a query, and its oracle where plain SQL can express it."""

    def add(build):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_times(build(use_utc(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add
