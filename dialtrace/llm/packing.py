"""Packing of token sequences: first-fit decreasing in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import small_batches, whole_text
from dialtrace.llm.tokens import encoder
from dialtrace.session import keep

#: Tokens of a sequence, the id that ends a document, and pieces per group.
CAPACITY = 1024
END = 0
GROUP = 8192

PIECES = (
    "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, salt BIGINT, own_sequence BIGINT"
)


class Bins:
    """Bins that hold so much each, with a tournament tree over their free room.

    A node has the largest room below it, so the first bin with room enough is found by
    going down, left before right, and a placement plays only the matches above its bin.
    """

    def __init__(self, most: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts an item into the first bin with room for it: bin, and the room before."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_no, before = at - self.leaves, room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_no, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item, placed in order of falling size, equal sizes as they come."""
    bins, out = Bins(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_no, before = bins.place(sizes[i])
        out[i] = (bin_no, capacity - before)
    return out


def cut(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """The pieces of all documents, without their ids: full ones, and one rest each.

    A full piece is a sequence of its own, numbered by task and place. ``salt`` deals the
    rests to random groups, also if all rows repeat one document.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, part = encoder(tokenizer).encode_all, TaskContext.get().partitionId()
        closing, row, full = np.asarray([end], dtype="<u4").tobytes(), 0, 0
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"].tolist()), strict=True):
                ids += closing
                n, row = len(ids) // 4, row + 1
                salt = xxhash.xxh64_intdigest(f"{doc_id} {part} {row}") >> 1
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    own = None
                    if length == capacity:
                        own, full = part << 32 | full, full + 1
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, salt, own))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "own_sequence"]).astype(
                {"doc_id": "Int64", "own_sequence": "Int64"}
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, closed by ``end``, are cut into full pieces, which are sequences
    as they are, and a rest. The rests are dealt at random to groups of about ``group``
    and packed in each group by first-fit decreasing, so a group is one bounded task and
    more data means more groups; only the numbers of a rest move between tasks, never its
    ids. A missing or empty text is the one id ``end``. A missing doc_id stays missing;
    repeated rows are documents of their own. An empty table gives no rows. Further
    columns are not read.
    """
    with small_batches(docs.sparkSession):
        pieces = keep(cut(docs, tokenizer, capacity, end), "pieces")
    rests = pieces.where(F.col("own_sequence").isNull()).drop("own_sequence")
    groups = max(1, -(-rests.count() // group))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["salt", "doc_id", "start"], kind="stable")
        where = first_fit_decreasing(rows["length"].tolist(), capacity)
        first = int(rows["group_no"].iloc[0]) << 32
        rows["sequence_id"] = [2 * (first + b) + 1 for b, _ in where]
        rows["offset"] = [o for _, o in where]
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    schema = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"
    dealt = rests.withColumn("group_no", F.pmod("salt", F.lit(groups))).groupBy("group_no").applyInPandas(packed, schema)
    full = pieces.where(F.col("own_sequence").isNotNull()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own_sequence") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return full.unionByName(dealt)
