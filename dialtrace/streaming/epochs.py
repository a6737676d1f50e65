"""Tables that a stream advances together, one epoch at a time.

Rows of an epoch are written to folders of their own, and one small log entry names the
folders of all tables. Only what an entry names exists for readers, so the tables of an
epoch appear at once, and an epoch that is run again, after a failure at any place,
replaces all of them.

Entries are merged in levels: of every ``fanout`` entries of a level one of the next
is made, whose rows a table may put together on the way. Readers so open a number of
folders that grows with the logarithm of the epochs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dialtrace.sources import files

FANOUT = 8

#: A table's schema, what puts its rows together, and the columns that name its folders.
Merge = tuple[str, Callable[[DataFrame], DataFrame], list[str]]


@dataclass(frozen=True)
class Entry:
    """Epochs ``first`` to ``last``, and the folders of each table that hold their rows."""

    level: int
    first: int
    last: int
    folders: dict[str, list[str]]

    @property
    def name(self) -> str:
        return f"{self.first:012d}-{self.last:012d}.json"

    def covers(self, other: Entry) -> bool:
        return self.first <= other.first and other.last <= self.last and self.level > other.level


class EpochStore:
    """The tables below one folder; one writer at a time, any number of readers.

    The log and the folders of ``hidden`` tables have names that Spark's readers pass over.
    A store with one other table so reads as that table by its path alone; what an attempt
    that broke off has left is then seen until the next compaction.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, hidden: tuple[str, ...] = ()):
        self.spark, self.path, self.fanout, self.hidden = spark, path.rstrip("/"), fanout, hidden

    # ------------------------------------------------------------ reading

    def every_entry(self) -> list[Entry]:
        log = f"{self.path}/_log"
        found = [name for name in files.names(self.spark, log) if name.endswith(".json") and not name.startswith("_")]
        return [Entry(**json.loads(files.read_text(self.spark, f"{log}/{name}"))) for name in found]

    def entries(self) -> list[Entry]:
        """The entries that count: those that no merged one covers."""
        found = self.every_entry()
        return [e for e in found if not any(other.covers(e) for other in found)]

    def folders(self, table: str, before: int | None = None) -> list[str]:
        live = [e for e in self.entries() if before is None or e.last < before]
        return [f"{self.path}/data/{folder}" for e in sorted(live, key=lambda e: e.first) for folder in e.folders.get(table, [])]

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows of a table, of epochs ``before`` a number only if it is given."""
        found = self.folders(table, before)
        return self._load(schema, found) if found else self.spark.createDataFrame([], schema)

    def _load(self, schema: str, folders: list[str]) -> DataFrame:
        whole = self.spark.read.schema(f"{schema}, run STRING").option("basePath", folders[0].rsplit("/", 1)[0]).parquet(*folders)
        return whole.drop("run")

    # ------------------------------------------------------------ writing

    def _publish(self, entry: Entry) -> None:
        files.put_text(self.spark, f"{self.path}/_log/{entry.name}", json.dumps(entry.__dict__))

    def _folder(self, table: str, first: int, last: int) -> str:
        # an attempt writes below a name of its own, so what a failed one has left is never read
        name = f"_{table}" if table in self.hidden else table
        return f"{name}/run={first:012d}-{last:012d}-{uuid.uuid4().hex}"

    def commit(self, epoch: int, tables: dict[str, Callable[[str], None]]) -> None:
        """Calls each table's function with the folder to write, then makes all of them visible."""
        folders = {table: self._folder(table, epoch, epoch) for table in tables}
        for table, write in tables.items():
            write(f"{self.path}/data/{folders[table]}")
        self._publish(Entry(0, epoch, epoch, {table: [folder] for table, folder in folders.items()}))

    def compact(self, before: int, merges: dict[str, Merge] | None = None) -> None:
        """Merges entries of epochs ``before`` a number, level by level.

        ``merges`` says how the rows of a table are put together; the folders of other
        tables are only listed in the new entry. An epoch that can
        still be run again must not be merged: a stream passes the one it works on.
        A crash leaves either the old entries or the new one. What an entry covers is
        taken from the log one compaction later, and its rows after another one, so
        that readers have the time of two to finish.
        """
        merges = merges or {}
        live = self._sweep()
        level = 0
        while level <= max((e.level for e in live), default=-1):
            some = sorted((e for e in live if e.level == level and e.last < before), key=lambda e: e.first)[: self.fanout]
            if len(some) < self.fanout:
                level += 1
                continue
            first, last = some[0].first, some[-1].last
            folders: dict[str, list[str]] = {}
            for table in sorted({t for e in some for t in e.folders}):
                old = [folder for e in some for folder in e.folders.get(table, [])]
                if table in merges:
                    schema, merge, by = merges[table]
                    target = self._folder(table, first, last)
                    rows = merge(self._load(schema, [f"{self.path}/data/{x}" for x in old]))
                    rows.write.partitionBy(*by).parquet(f"{self.path}/data/{target}")
                    old = [target]
                folders[table] = old
            merged = Entry(level + 1, first, last, folders)
            self._publish(merged)
            live = [e for e in live if e not in some] + [merged]

    def _sweep(self) -> list[Entry]:
        """Removes what nothing names any more; returns the entries that count."""
        every = self.every_entry()
        named = {folder for e in every for folders in e.folders.values() for folder in folders}
        for table in files.names(self.spark, f"{self.path}/data"):
            for folder in files.names(self.spark, f"{self.path}/data/{table}"):
                if f"{table}/{folder}" not in named:
                    files.remove(self.spark, f"{self.path}/data/{table}/{folder}")
        old = [e for e in every if any(other.covers(e) for other in every)]
        for e in old:
            files.remove(self.spark, f"{self.path}/_log/{e.name}")
        return [e for e in every if e not in old]
