"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Kept = TypeVar("Kept")

#: The ASCII white space that separates words, as a class body of a pattern.
SPACE = r"\x20\x09-\x0D"

#: Rows and bytes of texts that a Python worker gets at once; one longer text comes alone.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same documents, in a session that hands texts to Python in small batches.

    A worker holds a batch, what it makes of it and both of them as Arrow buffers, and
    the executor's JVM holds those buffers once more.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small batches for what is written inside; the session's own settings come back after it."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in sizes}
    try:
        for key, value in sizes.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_kept: dict[str, object] = {}


def kept_by_worker(name: str, make: Callable[[], Kept]) -> Kept:
    """What ``make`` gives, kept by this Python worker for its next tasks.

    A worker outlives a stage. It keeps one thing, so what an earlier stage needed goes.
    """
    if name not in _kept:
        keep_nothing()
        _kept[name] = make()
    return _kept[name]


def keep_nothing() -> None:
    """Frees what this Python worker kept for the tasks of other stages."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def free_name(docs: DataFrame, wish: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def whole_text(column: str = "text") -> Column:
    """The whole text; a missing one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def with_text(docs: DataFrame, row: str, text: Column, *more: Column) -> DataFrame:
    """All columns of the struct column ``row`` with its text replaced, and what else is named.

    ``n_chars`` follows the text where the documents have it.
    """
    fields = []
    for name in docs.schema[row].dataType.fieldNames():
        kept = F.col(f"{row}.`{name}`")
        if name == "text":
            kept = text
        elif name == "n_chars":
            kept = F.when(F.col(f"{row}.`text`").eqNullSafe(text), kept).otherwise(F.length(text).cast(docs.schema[row].dataType[name].dataType))
        fields.append(kept.alias(name))
    return docs.select(*fields, *more)


def long_sum(column: Column) -> Column:
    return F.sum(column).cast("bigint")
