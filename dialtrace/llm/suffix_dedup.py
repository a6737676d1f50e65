"""Removal of long repeated passages by a distributed sort of suffixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import whole_text
from dialtrace.session import keep

#: Bytes of a passage, and of the piece by whose hash its place of sampling is chosen.
LENGTH = 400
PIECE = 32
#: Bytes before a sampled place that a passage around it can reach.
BEFORE = LENGTH - PIECE
#: Suffixes merged in one task, about, and bytes of a task's suffixes that are sorted at once.
MERGED = 20_000
RUN_BYTES = 32_000_000
#: Groups up to this size are compared pair by pair, larger ones by hashes of their windows.
FEW = 12
#: Kinds of surroundings of a piece up to which they meet in one task; the windows of more are counted by shuffle.
LARGE = 50_000
#: Parts of the rows that have the same window, and of the kinds of a piece.
SALTS = 16

_rng = np.random.default_rng(20240918)
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
PLACE_BITS = 28

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX2
    return h ^ (h >> np.uint64(32))


def sums_of(row: np.ndarray) -> np.ndarray:
    power, _ = powers(len(row) + 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUE[row] * power[: len(row)], dtype=np.uint64)])


def hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to stop, from sums up to each place."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(np.uint64))


def sampled(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a text, and the hash of the piece there: of each LENGTH bytes the piece of least hash, the left one of equals.

    The choice depends on those bytes alone, so equal passages are sampled at the same
    place within. About one place in 185 is chosen.
    """
    n = len(sums) - 1
    if n < LENGTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    at = np.arange(n - PIECE + 1)
    piece = hashes(sums, at, at + PIECE)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    value = (piece & ~mask) | (at.astype(np.uint64) & mask)
    # least value of each window, from least values up to and from the edges of blocks
    w = BEFORE + 1
    padded = np.full(-(-len(value) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, w)
    up_to = np.minimum.accumulate(blocks, axis=1).ravel()
    on_from = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(on_from[:windows], up_to[w - 1 : w - 1 + windows])
    low = (least & mask).astype(np.int64)
    # places are known up to their lowest bits; the window gives the rest
    start = np.arange(windows)
    place = start + ((low - start) & ((1 << PLACE_BITS) - 1))
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    return place, piece[place]


def samples(texts: DataFrame) -> DataFrame:
    """k1, k2, n and the sampled places of each text, with the hash of the piece and of all bytes a passage there can reach."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                row = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                if len(row) < LENGTH:
                    continue
                sums = sums_of(row)
                place, piece = sampled(sums)
                start, stop = np.maximum(place - BEFORE, 0), np.minimum(place + LENGTH, len(row))
                around = hashes(sums, start, stop) ^ mix((place - start).astype(np.uint64))
                out.append((k1, k2, len(row), place, piece.view(np.int64), around.view(np.int64)))
            yield pd.DataFrame(out, columns=["k1", "k2", "n", "place", "piece", "around"])

    schema = "k1 BIGINT, k2 BIGINT, n BIGINT, place ARRAY<BIGINT>, piece ARRAY<BIGINT>, around ARRAY<BIGINT>"
    return texts.select("k1", "k2", "text").mapInPandas(work, schema)


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common start of two texts that agree up to ``at``."""
    most = min(len(a), len(b))
    while at < most and a[at : at + 32] == b[at : at + 32]:
        at += 32
    while at < most and a[at] == b[at]:
        at += 1
    return min(at, most)


HEAD = struct.Struct("<HHHHqqq")


def front_coded(records: list[tuple]) -> bytes:
    """A sorted run of (after, before, k1, k2, place): of each text only what differs from the one before it."""
    out, after, before = [], b"", b""
    for r in records:
        a, b = common(after, r[0]), common(before, r[1])
        after, before = r[0], r[1]
        out += [HEAD.pack(a, len(after) - a, b, len(before) - b, *r[2:]), after[a:], before[b:]]
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, tuple]]:
    """The records of a run, each with how much its text shares with the one before it."""
    at, after, before = 0, b"", b""
    while at < len(run):
        a, more, b, more_before, k1, k2, place = HEAD.unpack_from(run, at)
        at += HEAD.size
        after, at = after[:a] + run[at : at + more], at + more
        before, at = before[:b] + run[at : at + more_before], at + more_before
        yield a, (after, before, k1, k2, place)


def merge(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """Merges sorted runs by a loser tree that knows common starts.

    Every loser keeps how much it shares with the text that beat it. A contender knows
    the same about the last winner, so the longer common start wins unseen; only equal
    ones are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    none = (-1, None)
    heads = [next(run, none) for run in runs] + [none] * (size - len(runs))
    shared = [a for a, _ in heads]
    losers = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's common start becomes the one with the winner."""
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        if shared[x] < 0:
            return x, y
        a, b = heads[x][1][0], heads[y][1][0]
        at = common(a, b, shared[x])
        x_first = a[at : at + 1] <= b[at : at + 1]
        win, lose = (x, y) if x_first else (y, x)
        shared[lose] = at
        return win, lose

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    winner = build(1) if size > 1 else 0
    while heads[winner][1] is not None:
        yield shared[winner], heads[winner][1]
        heads[winner] = next(runs[winner], none)
        shared[winner] = heads[winner][0]
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def window_hashes(some: list[tuple], offsets: np.ndarray) -> np.ndarray:
    """Hashes of the windows of records (after, before, ...), by how many bytes lie before the place; 0 where the text ends within."""
    rows = np.zeros((len(some), BEFORE + LENGTH), dtype=np.uint8)
    have = np.zeros((len(some), 2), dtype=np.int64)
    for k, r in enumerate(some):
        have[k] = len(r[1]), len(r[0])
        rows[k, BEFORE - len(r[1]) : BEFORE] = np.frombuffer(r[1], dtype=np.uint8)[::-1]
        rows[k, BEFORE : BEFORE + len(r[0])] = np.frombuffer(r[0], dtype=np.uint8)
    a, b = BEFORE - offsets[-1], BEFORE - offsets[0] + LENGTH
    power, back = powers(BEFORE + LENGTH + 1)
    sums = np.zeros((len(some), b - a + 1), dtype=np.uint64)
    np.cumsum(BYTE_VALUE[rows[:, a:b]] * power[: b - a], axis=1, out=sums[:, 1:])
    start = BEFORE - offsets - a
    h = mix((sums[:, start + LENGTH] - sums[:, start]) * back[start])
    inside = (offsets <= have[:, :1]) & (LENGTH - offsets <= have[:, 1:])
    return np.where(inside, h | np.uint64(1), np.uint64(0))


def reaches(group: list[tuple], shared: list[int]) -> Iterator[tuple[int, int]]:
    """How far before and after its place each record's repeated bytes reach; (0, 0) if none are.

    ``shared[i]`` is the common start of records i - 1 and i. A record is repeated with
    another one where what they share before and after the place makes LENGTH bytes; all
    such stretches hold the place, so they join to one.
    """
    m = len(group)
    before, after = [0] * m, [0] * m
    if m <= FEW:
        for i in range(m):
            right = LENGTH
            for j in range(i + 1, m):
                right = min(right, shared[j])
                left = common(group[i][1], group[j][1])
                if left + right >= LENGTH:
                    for k in (i, j):
                        before[k], after[k] = max(before[k], left), max(after[k], right)
        yield from zip(before, after, strict=True)
        return
    # the windows around the place, by how many bytes lie before it; equal ones have equal hashes
    low, high = np.full(m, BEFORE + 1), np.full(m, -1)
    step = 46
    for first in range(0, BEFORE + 1, step):
        offsets = np.arange(first, min(first + step, BEFORE + 1))
        found = np.zeros((m, len(offsets)), dtype=np.uint64)
        for at in range(0, m, 4096):
            found[at : at + 4096] = window_hashes(group[at : at + 4096], offsets)
        for k, o in enumerate(offsets):
            column = found[:, k]
            order = np.argsort(column, kind="stable")
            line = column[order]
            same = np.zeros(m, dtype=bool)
            same[1:] = (line[1:] == line[:-1]) & (line[1:] != 0)
            same[:-1] |= same[1:]
            twice = order[same]
            low[twice], high[twice] = np.minimum(low[twice], o), np.maximum(high[twice], o)
    for a, b in zip(low, high, strict=True):
        yield (int(b), LENGTH - int(a)) if b >= 0 else (0, 0)


def edge_spans(texts: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """k1, k2, start, stop: repeated bytes around the wanted places, found by sorting the suffixes there.

    Each task sorts its suffixes into front-coded runs, one per bucket; the runs of a
    bucket, which has all suffixes that begin with the same piece, are merged in one task.
    """
    places = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "piece")).alias("places"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def close() -> pd.DataFrame:
            rows = [(bucket, front_coded(sorted(records, key=lambda r: r[:2]))) for bucket, records in held.items()]
            return pd.DataFrame(rows, columns=["bucket", "run"])

        for batch in batches:
            for k1, k2, text, found in zip(batch["k1"], batch["k2"], batch["text"], batch["places"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in found:
                    place = int(x["place"])
                    record = (data[place : place + LENGTH], data[max(0, place - BEFORE) : place][::-1], int(k1), int(k2), place)
                    held.setdefault(int(x["piece"]) % buckets, []).append(record)
                    size += len(record[0]) + len(record[1])
                if size > RUN_BYTES:
                    yield close()
                    held, size = {}, 0
        if held:
            yield close()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []

        def close(group: list[tuple], shared: list[int]) -> None:
            if len(group) > 1:
                for r, (before, after) in zip(group, reaches(group, shared), strict=True):
                    if before + after:
                        out.append((r[2], r[3], r[4] - before, r[4] + after))

        group: list[tuple] = []
        shared: list[int] = []
        for a, r in merge([decoded(run) for run in rows["run"]]):
            if a < PIECE:
                close(group, shared)
                group, shared = [], []
            # a text that occurs in several documents comes once from each
            if group and a == len(r[0]) == len(group[-1][0]) and r[1] == group[-1][1]:
                continue
            group.append(r)
            shared.append(a)
        close(group, shared)
        return pd.DataFrame(out, columns=["k1", "k2", "start", "stop"])

    sorted_runs = texts.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInPandas(runs, "bucket INT, run BINARY")
    return sorted_runs.groupBy("bucket").applyInPandas(merged, "k1 BIGINT, k2 BIGINT, start BIGINT, stop BIGINT")


def window_spans(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, k2, start, stop: as edge_spans, for pieces whose kinds are too many for one task.

    Every window around a place is a row with its hash, and Spark counts equal ones:
    partly in each task, then by a shuffle on the window, so that a passage of very many
    texts is one row a task. The windows that occur twice go back to their rows in
    ``SALTS`` parts.
    """
    places = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "piece")).alias("places"))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k1, k2, text, found in zip(batch["k1"], batch["k2"], batch["text"], batch["places"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in found:
                    place = int(x["place"])
                    out.append((k1, k2, place, int(x["piece"]), data[place : place + LENGTH], data[max(0, place - BEFORE) : place][::-1]))
            yield pd.DataFrame(out, columns=["k1", "k2", "place", "piece", "after", "before"])

    schema = "k1 BIGINT, k2 BIGINT, place BIGINT, piece BIGINT, after BINARY, before BINARY"
    records = keep(texts.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInPandas(around, schema), "around")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = np.arange(BEFORE + 1)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                h = window_hashes(list(zip(some["after"], some["before"], strict=True)), offsets)
                row, offset = np.nonzero(h)
                piece = some["piece"].to_numpy(np.int64).view(np.uint64)[row]
                key = h[row, offset] ^ mix(piece + offset.astype(np.uint64))
                frame = some[["k1", "k2", "place"]].iloc[row]
                yield frame.assign(offset=offset, same=key.view(np.int64))

    rows = records.mapInPandas(windows, "k1 BIGINT, k2 BIGINT, place BIGINT, offset BIGINT, same BIGINT")
    rows = rows.withColumn("own", F.xxhash64("k1", "k2", "place"))
    twice = keep(rows.groupBy("same").agg(F.min("own").alias("one"), F.max("own").alias("other")).where("one <> other").select("same"), "twice")
    dealt = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = rows.withColumn("salt", F.pmod("own", F.lit(SALTS))).join(dealt, ["same", "salt"])
    return hit.groupBy("k1", "k2", "place").agg(F.max("offset").alias("most"), F.min("offset").alias("least")).select(
        "k1", "k2", (F.col("place") - F.col("most")).alias("start"), (F.col("place") + LENGTH - F.col("least")).alias("stop")
    )


def suffix_dedup(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_bytes of every document.

    Every byte is removed that is part of 400 bytes which also start elsewhere, in any
    document or the same one; overlaps count. Texts are UTF-8; a missing one is empty. A
    cut can split a character, so what is left is given as bytes.

    1. Of every 400 bytes one place is sampled by content. A place whose surroundings, as
       far as a passage around it can reach, occur twice is settled: they are repeated.
    2. Places that share a piece but differ in their surroundings are at the edges of
       repeated passages. One of each kind goes into the sort of suffixes, where
       neighbours show how far the repetition reaches. Pieces of more than ``large``
       kinds do not go into one task; their windows are counted instead.
    3. The stretches of a text are joined and cut out.

    Equal texts have equal stretches and share one key, a 128-bit hash. Surroundings and
    pieces are matched by 64-bit hashes, edges by their bytes, windows of large groups
    by 64-bit hashes again. Repeated rows have a row each, rows without an id too; an
    empty table gives no rows. Further columns are not read.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    rows = keep(samples(keyed), "samples").select("k1", "k2", "n", F.explode(F.arrays_zip("place", "piece", "around")).alias("s"))
    rows = rows.select("k1", "k2", "n", "s.place", "s.piece", "s.around", F.xxhash64("k1", "k2", "s.place").alias("own"))
    kinds = rows.groupBy("piece", "around").agg(F.count(F.lit(1)).alias("c"), F.min("own").alias("first"))
    kinds = keep(kinds, "kinds")
    # a piece can have very many kinds, so they meet its count in parts
    mixed = kinds.groupBy("piece").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    dealt = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = kinds.withColumn("salt", F.pmod("around", F.lit(SALTS))).join(dealt, ["piece", "salt"], "left").drop("salt")
    open_kinds = counted.withColumn("kinds", F.coalesce("kinds", F.lit(1))).where("c > 1 OR kinds > 1")
    found = keep(rows.join(open_kinds, ["piece", "around"]).select("k1", "k2", "n", "place", "piece", "c", "kinds", (F.col("own") == F.col("first")).alias("one")), "found")
    settled = found.where("c > 1").select(
        "k1", "k2", F.greatest(F.col("place") - BEFORE, F.lit(0)).alias("start"), F.least(F.col("place") + LENGTH, F.col("n")).alias("stop")
    )
    edges = found.where("kinds > 1 AND one")
    wanted, many = (edges.where(x).select("k1", "k2", "place", "piece") for x in (F.col("kinds") <= large, F.col("kinds") > large))
    buckets = max(1, -(-wanted.count() // MERGED))
    repeated = settled.unionByName(edge_spans(keyed, wanted, buckets))
    if not many.isEmpty():
        repeated = repeated.unionByName(window_spans(keyed, many))
    spans = repeated.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data, at, runs, left = text.encode("utf-8", "surrogatepass"), 0, 0, []
                stop = -1
                for x in found if found is not None else ():
                    if x["start"] > stop:
                        left.append(data[at : x["start"]])
                        runs += 1
                    stop = at = max(stop, x["stop"])
                left.append(data[at:])
                kept = b"".join(left)
                out.append((doc_id, len(data), len(data) - len(kept), runs, kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"]).assign(doc_id=pd.array(batch["doc_id"].astype("Int64")))

    joined = keyed.join(keep(spans, "spans"), ["k1", "k2"], "left").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "spans")
    return joined.mapInPandas(cut, "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_bytes BINARY")
