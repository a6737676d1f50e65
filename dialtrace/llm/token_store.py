"""Token files: ids in document order, each shard compressed by a Re-Pair grammar."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialtrace.llm.common import small_batches, whole_text
from dialtrace.llm.tokens import encoder

#: The id that ends a document, tokens from which a shard is closed, and how often a pair
#: occurs that becomes a rule.
END = 0
SHARD_TOKENS = 1 << 19
LEAST = 8

#: One row of a file is one shard: the ids of consecutive documents. ``rules`` holds the two
#: sides of each rule and ``lengths`` how many ids it stands for; symbols from ``first_rule``
#: on are rules, in that order. ``symbols`` is the compressed row, ``doc_starts`` the place
#: of each document's first id in the shard. All are little-endian unsigned 32-bit integers.
FILES = (
    "part INT, shard INT, n_tokens BIGINT, first_rule BIGINT, rules BINARY, lengths BINARY, symbols BINARY, "
    "doc_ids ARRAY<BIGINT>, doc_starts BINARY"
)


def u4(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype="<u4").tobytes()


#: Bits of the hash by which pairs are counted first, and of the table of the frequent ones.
SHORT = 18
#: Places of so few pairs are sorted at once.
FEW = 4096
#: Changed places are gone through by themselves if the row is so many times as long as they are.
FEW_CHANGES = 8


def frequent_pairs(row: np.ndarray, maybe: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``maybe`` (all without), those of frequent pairs, and each one's number; 0 is the most frequent."""
    left, right = (row[:-1], row[1:]) if maybe is None else (row[maybe], row[maybe + 1])
    if len(left) < FEW:
        pair = left.astype(np.uint64) << np.uint64(32) | right
        found, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")[: int((count >= least).sum())]
        number = np.full(len(found), -1, dtype=np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        number = number[which]
        frequent = np.flatnonzero(number >= 0)
        return frequent if maybe is None else maybe[frequent], number[frequent]
    # counting by a short hash first leaves few pairs to sort
    short = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - SHORT)).astype(np.intp)
    often = np.flatnonzero((np.bincount(short, minlength=1 << SHORT) >= least).take(short))
    left, right, short = left.take(often), right.take(often), short.take(often)
    at = often if maybe is None else maybe.take(often)
    pair = left.astype(np.uint64) << np.uint64(32) | right
    line = np.sort(pair)
    edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, dtype=np.int64)
    count = np.diff(np.append(edge, len(line)))
    found, count = line[edge][count >= least], count[count >= least]
    found = found[np.argsort(-count, kind="stable")]
    # each pair's number from a table by the short hash; of those that share a place there, all but one are looked up in order
    a, b = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
    place = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - SHORT)
    table = np.full(1 << SHORT, -1, dtype=np.int32)
    table[place] = np.arange(len(found), dtype=np.int32)
    number = table.take(short)
    if len(found):
        other = np.flatnonzero(found.take(number, mode="wrap") != pair)
        number[other] = -1
        hidden = np.flatnonzero(table[place] != np.arange(len(found)))
        if len(hidden):
            hidden = hidden[np.argsort(found[hidden])]
            crowded = np.zeros(1 << SHORT, dtype=bool)
            crowded[place[hidden]] = True
            open_ = other[crowded.take(short.take(other))]
            k = np.minimum(np.searchsorted(found[hidden], pair[open_]), len(hidden) - 1)
            number[open_] = np.where(found[hidden[k]] == pair[open_], hidden[k], -1)
    frequent = np.flatnonzero(number >= 0)
    return at[frequent], number[frequent]


def closed_up(row: np.ndarray, gone: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The row without the places ``gone``, and where those of ``places`` that stay and have one behind them are in it, in order."""
    if FEW_CHANGES * sum(map(len, places)) > len(row):
        stays, marked = np.ones(len(row), dtype=bool), np.zeros(len(row), dtype=bool)
        stays[gone] = False
        for x in places:
            marked[x] = True
        stays = np.flatnonzero(stays)
        return row[stays], np.flatnonzero(marked[stays[:-1]])
    # the work on a few places does not grow with the row, which is copied once
    some = np.unique(np.concatenate(places))
    before = np.searchsorted(gone, some)
    stay = gone.take(before, mode="clip") != some if len(gone) else np.ones(len(some), dtype=bool)
    some = (some - before)[stay]
    row = np.delete(row, gone)
    return row, some[some < len(row) - 1]


def compress(row: np.ndarray, first_rule: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), their expansion lengths, and the remaining symbols.

    A round replaces all pairs that occur ``least`` times or more, the more frequent one
    where two overlap and the left one where a pair overlaps itself, and the next round
    counts anew; this is the pair-by-pair replacement taken a whole layer at a time. It
    ends when no pair occurs so often. A later round only counts pairs that have a symbol
    of the round before and those that were frequent in it: all others were rare and stay so.
    """
    rules, lengths = [np.empty((0, 2), dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    known, maybe = 0, None
    row = row.astype(np.uint32)
    while True:
        at, rank = frequent_pairs(row, maybe, least)
        if not len(at):
            break
        # a pair beside a more frequent one that shares a symbol with it waits for the next round
        wins, beside = np.ones(len(at), dtype=bool), np.diff(at) == 1
        wins[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        wins[1:] &= ~beside | (rank[1:] <= rank[:-1])
        wins = np.flatnonzero(wins)
        won, rank_won = at[wins], rank[wins]
        # neighbours among the winners are runs of one pair with itself: every second one stays
        behind = np.flatnonzero(np.diff(won) == 1) + 1
        if len(behind):
            opens = np.diff(behind, prepend=-1) != 1
            drop = behind[(behind - behind[opens][np.cumsum(opens) - 1]) % 2 == 0]
            won, rank_won = np.delete(won, drop), np.delete(rank_won, drop)
        place = np.full(int(rank.max()) + 1, -1)
        place[rank_won] = won
        used = np.flatnonzero(place >= 0)
        where = place[used]
        number = np.zeros(len(place), dtype=np.int64)
        number[used] = np.arange(len(used))
        rule = number[rank_won]
        sides = np.stack([row[where], row[where + 1]], axis=1).astype(np.int64)
        all_lengths = np.concatenate(lengths)
        size = np.ones(sides.shape, dtype=np.int64)
        high = sides >= first_rule
        size[high] = all_lengths[sides[high] - first_rule]
        rules.append(sides)
        lengths.append(size.sum(axis=1))
        row[won] = first_rule + known + rule
        # before a new symbol stands the one before the pair, or the symbol of a pair that ended there
        maybe = [at, won, won[won > 0] - 1, won[won > 1] - 2]
        row, maybe = closed_up(row, won + 1, maybe)
        known += len(used)
    return np.concatenate(rules), np.concatenate(lengths), row


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for."""
    if len(symbols) > len(rules):
        # each rule is expanded once and copied to where it stands
        ids, size = expanded(rules.reshape(-1), rules, first_rule, np.repeat(np.arange(len(rules)), 2))
        start = np.cumsum(size) - size
        high = symbols >= first_rule
        rule = symbols[high] - first_rule
        lengths = np.ones(len(symbols), dtype=np.int64)
        lengths[high] = size[rule]
        out = np.repeat(symbols, lengths)
        stop = np.cumsum(lengths)[high]
        shift = np.repeat(start[rule] - (stop - size[rule]), size[rule])
        place = np.flatnonzero(out >= first_rule)
        out[place] = ids[place + shift]
        return out
    return expanded(symbols, rules, first_rule, np.zeros(len(symbols), dtype=np.int64))[0]


def expanded(symbols: np.ndarray, rules: np.ndarray, first_rule: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that symbols stand for, one layer of rules after the other, and how many there are of each owner."""
    owners = int(owner[-1]) + 1 if len(owner) else 0
    while (high := symbols >= first_rule).any():
        out, owner = np.repeat(symbols, 1 + high), np.repeat(owner, 1 + high)
        place = np.flatnonzero(high) + np.arange(int(high.sum()))
        sides = rules[symbols[high] - first_rule]
        out[place], out[place + 1] = sides[:, 0], sides[:, 1]
        symbols = out
    return symbols, np.bincount(owner, minlength=owners)


class Shard:
    """A shard as read from a file, with random access to its ids."""

    def __init__(self, row) -> None:
        read = lambda b: np.frombuffer(b, dtype="<u4")
        self.first_rule = int(row.first_rule)
        self.rules, self.symbols, self.lengths = read(row.rules).reshape(-1, 2), read(row.symbols), read(row.lengths)
        self.doc_ids = list(row.doc_ids)
        self.starts = np.append(read(row.doc_starts).astype(np.int64), int(row.n_tokens))

    @cached_property
    def ends(self) -> np.ndarray:
        """The place behind the ids of each symbol."""
        size = np.ones(len(self.symbols), dtype=np.int64)
        high = self.symbols >= self.first_rule
        size[high] = self.lengths[self.symbols[high] - self.first_rule]
        return np.cumsum(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``; only the symbols that reach into it are expanded."""
        a, b = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, stop, side="left") + 1
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.first_rule)[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all documents in ascending doc_id order, a closing id behind each.

    The documents are dealt by ranges of doc_id, and each task writes its shards in
    order; a missing doc_id comes first, a missing text is empty. A shard ends with the
    document that fills it, so memory is bounded by ``shard_tokens`` and one document.
    Repeated rows are documents of their own, in any order among themselves; an empty
    table gives no files' rows. Further columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        first_rule = max(tool.tokenizer.get_vocab_size(), end + 1)
        closing = np.asarray([end], dtype="<u4").tobytes()
        held: list[bytes] = []
        doc_ids: list = []
        n = 0

        def shard() -> pd.DataFrame:
            row = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64)
            rules, lengths, symbols = compress(row, first_rule)
            starts = np.cumsum([0, *(len(x) // 4 for x in held[:-1])])
            out = (part, number, n, first_rule, u4(rules), u4(lengths), u4(symbols), doc_ids, u4(starts))
            return pd.DataFrame([out], columns=[x.split()[0] for x in FILES.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], tool.encode_all(batch["text"].tolist()), strict=True):
                held.append(ids + closing)
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                n += len(held[-1]) // 4
                if n >= shard_tokens:
                    yield shard()
                    held, doc_ids, n, number = [], [], 0, number + 1
        if held:
            yield shard()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    with small_batches(spark):
        ordered.mapInPandas(shards, FILES).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    ``start`` counts the ids of all documents before it: of earlier parts, of earlier
    shards of its part, and in its shard. One row per part is summed in one task, one
    per shard in its part's.
    """
    files = spark.read.schema(FILES).parquet(path)
    by_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = by_part.select("part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("part_start"))
    shards = files.select("part", "shard", F.expr(
        "coalesce(sum(n_tokens) OVER (PARTITION BY part ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("shard_start"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard = Shard(row)
                ids = np.ascontiguousarray(expand(shard.symbols, shard.rules, shard.first_rule), dtype="<u4")
                at = shard.starts
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids, dtype="Int64"), "part": row.part, "shard": row.shard, "place": at[:-1], "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                })

    rows = files.mapInPandas(documents, "doc_id BIGINT, part INT, shard INT, place BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
