"""The word model of the quality classifier in packed rows: as many rows meet by shuffle as there are buckets, not one for each pair of words.

Words and pairs of words lie in buckets by the word (of a pair: the one before), as many as
the session's shuffle has partitions. A task puts what it has for one bucket into one row of
bytes. The values are those of ``perplexity.train_words`` and ``perplexity.score_words``,
which say the same by joins of single rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import keep_nothing
from dialtrace.llm.perplexity import BLOCK, FILTER_CELLS, HEAD_ROWS, in_chunks, lang_key, mixed, numbered
from dialtrace.session import free, keep, keep_by

#: Words or keys that a task gathers before it packs them.
ROWS = 1 << 20
#: Parts of the documents that meet the model one after the other; each reads the documents again.
PARTS = 4
#: What a packed key asks for: the value of a pair, of a word where it stands, or where another follows.
PAIR, STANDS, FOLLOWS = 0, 1, 2
LETTER = float(np.log(256))


def small(x: np.ndarray) -> bytes:
    """Numbers that are not negative, in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def from_small(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def keys_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def together(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word's key; it rises with the key."""
    return ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ranges(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket with the range of its rows."""
    starts = np.flatnonzero(np.diff(sorted_buckets, prepend=-1))
    ends = np.append(starts, len(sorted_buckets))[1:]
    yield from zip(sorted_buckets[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)


def distinct_pairs(before: np.ndarray, word: np.ndarray, length: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs by the word before and the word, each once, with their counts."""
    order = np.lexsort((word, before))
    before, word, length, n = before[order], word[order], length[order], n[order]
    new = np.ones(len(before), dtype=bool)
    new[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return before[first], word[first], length[first], np.add.reduceat(n, first) if len(first) else n


def runs_of(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a sorted row once, and how often it is there."""
    first = np.flatnonzero(np.append(True, before[1:] != before[:-1])[: len(before)])
    return before[first], np.diff(np.append(first, len(before)))


def count_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, before, runs, word, n, length: the pairs of words of each bucket, those of a task in one row for every ROWS words."""

    def packed(lang: str, parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        before, word, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        before, word, length, n = distinct_pairs(before, word, length, np.ones(len(word), dtype=np.int64))
        out = []
        for k, a, b in ranges(bucket_of(before, buckets)):
            one, runs = runs_of(before[a:b])
            out.append((lang_key(lang).view(np.int64)[0], k, one.tobytes(), small(runs), word[a:b].tobytes(), small(n[a:b]), small(length[a:b])))
        return pd.DataFrame(out, columns=["lang", "bucket", "before", "runs", "word", "n", "length"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        held, size = {}, 0
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts = group["text"].tolist()
                for at, stop in in_chunks(texts):
                    n, row, own, length = numbered(texts[at:stop], lang)
                    before = np.append(own, mixed(lang_key(lang), np.zeros(1, dtype=np.uint64)))[previous(row, n, len(own))]
                    held.setdefault(lang, []).append((before, own[row], length[row]))
                    size += len(row)
                    if size >= ROWS:
                        for x, parts in held.items():
                            yield packed(x, parts)
                        held, size = {}, 0
        for x, parts in held.items():
            yield packed(x, parts)

    return docs.select("lang", "text").mapInPandas(count, "lang BIGINT, bucket INT, before BINARY, runs BINARY, word BINARY, n BINARY, length BINARY")


def previous(row: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    """The number of the word before each; ``begin`` begins a text."""
    before = np.roll(row, 1)
    before[(np.cumsum(n) - n)[n > 0]] = begin
    return before


def merged(counted: DataFrame, buckets: int) -> DataFrame:
    """The pairs of each language and bucket in one row (peer -1), and for each bucket that their words are of a row of these, each once."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        before = np.concatenate([np.repeat(keys_of(b), from_small(r)) for b, r in zip(group["before"], group["runs"], strict=True)])
        word = np.concatenate([keys_of(x) for x in group["word"]])
        n, length = (np.concatenate([from_small(x) for x in group[c]]) for c in ("n", "length"))
        before, word, length, n = distinct_pairs(before, word, length, n)
        lang, bucket = group["lang"].iloc[0], group["bucket"].iloc[0]
        one, runs = runs_of(before)
        out = [(lang, bucket, -1, one.tobytes(), small(runs), word.tobytes(), small(n), None, int((n == 1).sum()), int((n == 2).sum()))]
        # in how many pairs of this bucket each word comes second
        words, first, kinds = np.unique(word, return_index=True, return_counts=True)
        for k, a, b in ranges(bucket_of(words, buckets)):
            out.append((lang, bucket, k, None, None, words[a:b].tobytes(), small(kinds[a:b]), small(length[first[a:b]]), 0, 0))
        return pd.DataFrame(out, columns=["lang", "bucket", "peer", "before", "runs", "word", "n", "length", "once", "twice"])

    return counted.groupBy("lang", "bucket").applyInPandas(
        merge, "lang BIGINT, bucket INT, peer INT, before BINARY, runs BINARY, word BINARY, n BINARY, length BINARY, once BIGINT, twice BIGINT"
    )


def add_kinds(group: pd.DataFrame) -> pd.DataFrame:
    """The words of a language and bucket, each once, with their kinds: the number of words before them."""
    word, at = np.unique(np.concatenate([keys_of(x) for x in group["word"]]), return_inverse=True)
    kinds = np.zeros(len(word), dtype=np.int64)
    np.add.at(kinds, at, np.concatenate([from_small(x) for x in group["n"]]))
    length = np.zeros(len(word), dtype=np.int64)
    length[at] = np.concatenate([from_small(x) for x in group["length"]])
    row = (group["lang"].iloc[0], group["peer"].iloc[0], word.tobytes(), small(kinds), small(length), int((kinds == 1).sum()), int((kinds == 2).sum()), int(kinds.sum()), len(word))
    return pd.DataFrame([row], columns=["lang", "peer", "word", "kinds", "length", "once", "twice", "all_kinds", "n_words"])


def price_words(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The log-probability of each word, for every bucket that has pairs with it, and (peer -1) for its own."""
    r = words.iloc[0]
    known, kinds, length = keys_of(r["word"]), from_small(r["kinds"]), from_small(r["length"])
    spelled = r["unknown"] - LETTER * (length + 1)
    p1 = np.log((kinds - r["d1"]) / r["all_kinds"] + np.exp(spelled))
    out = [(r["lang"], r["peer"], -1, r["word"], r["kinds"], p1.tobytes(), (p1 - spelled).tobytes(), r["d2"])]
    for bucket, word in zip(asked["bucket"], asked["word"], strict=True):
        out.append((r["lang"], bucket, r["peer"], None, None, p1[np.searchsorted(known, keys_of(word))].tobytes(), None, r["d2"]))
    return pd.DataFrame(out, columns=["lang", "bucket", "peer", "word", "kinds", "p1", "a", "d2"])


def price_pairs(pairs: pd.DataFrame, priced: pd.DataFrame) -> pd.DataFrame:
    """The model of a language and bucket: its words and pairs by their keys, what each adds to a log-probability, and its count."""
    key, a, b, count = [], [], [], []
    before, total, rest = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0)
    d2 = priced["d2"].iloc[0]
    if len(pairs):
        r = pairs.iloc[0]
        before, follow, word, n = keys_of(r["before"]), from_small(r["runs"]), keys_of(r["word"]), from_small(r["n"])
        total = np.add.reduceat(n, np.cumsum(follow) - follow)
        rest = np.log(d2 * follow / total)
        # the answers are in the order of the buckets, as the words are that were asked for
        answers = priced[priced["peer"] >= 0].sort_values("peer")["p1"]
        _, at = np.unique(word, return_inverse=True)
        less = np.repeat(rest, follow) + np.concatenate([np.frombuffer(x) for x in answers])[at]
        key.append(mixed(np.repeat(before, follow), word))
        a.append(np.log((n - d2) / np.repeat(total, follow) + np.exp(less)) - less)
        b.append(np.zeros(len(n)))
        count.append(n)
    own = priced[priced["peer"] < 0]
    word = together([keys_of(x) for x in own["word"]], np.uint64)
    every = np.union1d(before, word)
    for_word, for_before = np.searchsorted(every, word), np.searchsorted(every, before)
    stands, follows, n = np.zeros(len(every)), np.zeros(len(every)), np.zeros(len(every), dtype=np.int64)
    stands[for_word] = together([np.frombuffer(x) for x in own["a"]], np.float64)
    n[for_word] = together([from_small(x) for x in own["kinds"]])
    follows[for_before] = rest
    n[for_before] = np.maximum(n[for_before], total)
    key, a, b, n = (np.concatenate(x) for x in ([*key, every], [*a, stands], [*b, follows], [*count, n]))
    order = np.argsort(key)
    return pd.DataFrame({"lang": [priced["lang"].iloc[0]], "bucket": [priced["bucket"].iloc[0]], "key": [key[order].tobytes()], "a": [a[order].tobytes()], "b": [b[order].tobytes()], "n": [small(n[order])]})


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The word model of ``perplexity.train_words`` with one row for each language and bucket, and per language what an unknown word costs."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keep(merged(count_pairs(docs, buckets), buckets), "pairs")
    asked = pairs.where("peer >= 0").select("lang", "bucket", "peer", "word", "n", "length")
    words = keep(
        asked.groupBy("lang", "peer").applyInPandas(
            add_kinds, "lang BIGINT, peer INT, word BINARY, kinds BINARY, length BINARY, once BIGINT, twice BIGINT, all_kinds BIGINT, n_words BIGINT"
        ),
        "words",
    )

    def sums(rows: DataFrame, name: str, *more: str) -> DataFrame:
        """The discount of a language, from how many of its counts are 1 and 2."""
        found = rows.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("once", "twice", *more)])
        return found.select("lang", *more, discount("once", "twice").alias(name))

    rates = sums(words, "d1", "all_kinds", "n_words").join(sums(pairs.where("peer = -1"), "d2"), "lang")
    rates = keep(rates.withColumn("unknown", F.log(F.col("d1") * F.col("n_words") / F.col("all_kinds"))), "rates")
    known = words.drop("all_kinds").join(F.broadcast(rates.select("lang", "d1", "d2", "all_kinds", "unknown")), "lang")
    priced = keep(
        known.groupBy("lang", "peer").cogroup(asked.groupBy("lang", "peer")).applyInPandas(
            price_words, "lang BIGINT, bucket INT, peer INT, word BINARY, kinds BINARY, p1 BINARY, a BINARY, d2 DOUBLE"
        ),
        "known_words",
    )
    model = pairs.where("peer = -1").select("lang", "bucket", "before", "runs", "word", "n").groupBy("lang", "bucket")
    model = model.cogroup(priced.groupBy("lang", "bucket")).applyInPandas(price_pairs, "lang BIGINT, bucket INT, key BINARY, a BINARY, b BINARY, n BINARY")
    # in buckets, so that no part of the documents shuffles the model again
    model = keep_by([model], "word_model", "bucket")
    free(pairs, words, priced)
    return model, rates.select("lang", "unknown")


def discount(once: str, twice: str) -> Column:
    """``perplexity.discount_of`` from how many counts are 1 and 2."""
    some = F.col(once) / (F.col(once) + 2 * F.col(twice))
    return F.when(F.col(once) > 0, F.least(F.greatest(some, F.lit(0.05)), F.lit(0.95))).otherwise(0.5)


def level_of(n: np.ndarray) -> np.ndarray:
    """A step of a count on a scale of powers of 2, four steps each."""
    return np.floor(4 * np.log2(np.maximum(n, 1))).astype(np.int64)


def frequent(model: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and values of the most frequent words and pairs, at most so many: all whose count reaches a step."""

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch["n"]:
                level, found = np.unique(level_of(from_small(n)), return_counts=True)
                yield pd.DataFrame({"level": level, "found": found})

    counts = model.select("n").mapInPandas(steps, "level INT, found BIGINT").groupBy("level").agg(F.sum("found").alias("found")).toPandas().sort_values("level", ascending=False)
    fits = counts["level"][counts["found"].cumsum() <= rows]
    least = int(fits.min()) if len(fits) else 1 << 20

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, a, b, n in zip(batch["key"], batch["a"], batch["b"], batch["n"], strict=True):
                at = np.flatnonzero(level_of(from_small(n)) >= least)
                yield pd.DataFrame({"key": keys_of(key)[at].view(np.int64), "a": np.frombuffer(a)[at], "b": np.frombuffer(b)[at]})

    head = model.select("key", "a", "b", "n").mapInPandas(top, "key BIGINT, a DOUBLE, b DOUBLE").toArrow().to_pandas()
    return head["key"].to_numpy(np.int64).view(np.uint64), head["a"].to_numpy(), head["b"].to_numpy()


def key_filter(model: DataFrame, buckets: int, cells: int) -> np.ndarray:
    """A filter of the model's keys: each bucket has its part of the cells of 64 bits, a cell at least."""
    bits = max(1, cells // buckets) * 64

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(bits, dtype=np.uint8)
        for key in group["key"]:
            found[(keys_of(key) % np.uint64(bits)).astype(np.int64)] = 1
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "bits": [np.packbits(found, bitorder="little").tobytes()]})

    out = np.zeros((buckets, bits // 8), dtype=np.uint8)
    for r in model.select("bucket", "key").groupBy("bucket").applyInPandas(mark, "bucket INT, bits BINARY").collect():
        out[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def fresh_pairs(n: np.ndarray, row: np.ndarray, before: np.ndarray, kinds: int) -> np.ndarray:
    """How many pairs of each text its block of BLOCK words did not have before."""
    blocks = -(-n // BLOCK)
    number = np.repeat(np.cumsum(blocks) - blocks, n) + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) // BLOCK
    pair, size = before * kinds + row, (kinds + 1) * kinds
    if int(blocks.sum()) * size >= 1 << 63:
        _, pair = np.unique(pair, return_inverse=True)
        size = len(row)
    found = np.sort(number * size + pair)
    new = found[np.append(True, found[1:] != found[:-1])[: len(found)]]
    return np.bincount(np.repeat(np.arange(len(n)), blocks)[new // max(size, 1)], minlength=len(n))


def score(docs: DataFrame, model: DataFrame, rates: DataFrame, head_rows: int = HEAD_ROWS, cells: int = FILTER_CELLS, slices: int = PARTS) -> DataFrame:
    """tid, word_nll (nats a symbol) and stale (share of pairs that their block had before), as ``perplexity.score_words``.

    Keys of words and pairs go to the model's bucket and sums come back, both packed. The
    most frequent keys are looked up in the task, and keys that a filter of fixed size
    does not know are not sent; results are the same without. The documents go in
    ``slices`` parts by their tid, so that the shuffle files of one are all there are.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((*frequent(model, head_rows), key_filter(model, buckets, cells)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        keys, a, b, marks = shared.value
        # one key in a slot; those that lose theirs are sent
        slot = np.zeros(1 << max(4, 4 * len(keys)).bit_length(), dtype=np.int64)
        mask = np.uint64(len(slot) - 1)
        slot[(keys & mask).astype(np.int64)] = np.arange(len(keys))
        # the last row answers for keys that are not here
        keys, a, b = np.append(keys, np.uint64(0)), np.append(a, 0.0), np.append(b, 0.0)
        bits, flat = np.uint64(marks.shape[1] * 8), marks.reshape(-1)

        def held(key: np.ndarray) -> np.ndarray:
            at = slot[(key & mask).astype(np.int64)]
            return np.where(keys[at] == key, at, len(keys) - 1)

        def marked(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
            at = bucket * int(bits) + (key % bits).astype(np.int64)
            return (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        def packed(number: int, base: list[tuple[np.ndarray, ...]], sent: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            tid, lang, figures = (np.concatenate(x) for x in zip(*base, strict=True))
            bucket, key, code = (np.concatenate(x) for x in zip(*sent, strict=True))
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            key, code = key[order], code[order]
            chunk = (TaskContext.get().partitionId() << 32) + number
            out = [(chunk, chunk % buckets, None, None, tid.tobytes(), lang.tobytes(), figures.tobytes())]
            out += [(chunk, k, key[x:y].tobytes(), small(code[x:y]), None, None, None) for k, x, y in ranges(bucket[order])]
            return pd.DataFrame(out, columns=["chunk", "bucket", "key", "code", "tid", "lang", "figures"])

        base, sent, size, docs_so_far, number = [], [], 0, 0, 0
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts, ids = group["text"].tolist(), group["tid"].to_numpy(np.int64)
                for at, stop in in_chunks(texts):
                    n, row, own, length = numbered(texts[at:stop], lang)
                    before = previous(row, n, len(own))
                    doc = np.repeat(np.arange(stop - at), n)
                    # words: each once
                    every = np.append(own, mixed(lang_key(lang), np.zeros(1, dtype=np.uint64)))
                    bucket, place = bucket_of(every, buckets), held(every)
                    ask = (place == len(keys) - 1) & marked(bucket, every)
                    pair = mixed(every[before], every[row])
                    here = held(pair)
                    value = a[place][row] + b[place][before] + a[here]
                    asked = np.flatnonzero(here == len(keys) - 1)
                    asked = asked[marked(bucket[before[asked]], pair[asked])]
                    stands, follows = np.flatnonzero(ask[row]), np.flatnonzero(ask[before])
                    code = 3 * (doc + docs_so_far)
                    sent.append((
                        np.concatenate([bucket[before[asked]], bucket[row[stands]], bucket[before[follows]]]),
                        np.concatenate([pair[asked], every[row[stands]], every[before[follows]]]),
                        np.concatenate([code[asked] + PAIR, code[stands] + STANDS, code[follows] + FOLLOWS]),
                    ))
                    sizes = np.fromiter(map(len, texts[at:stop]), dtype=np.int64, count=stop - at)
                    sums = [np.bincount(doc, x, minlength=stop - at) for x in (value, length[row] + 1)]
                    figures = np.stack([sums[0], n, sums[1], fresh_pairs(n, row, before, len(own)), sizes], axis=1).astype(np.float64)
                    base.append((ids[at:stop], np.full(stop - at, lang_key(lang).view(np.int64)[0]), figures))
                    size, docs_so_far = size + len(sent[-1][0]) + stop - at, docs_so_far + stop - at
                    if size >= ROWS:
                        yield packed(number, base, sent)
                        base, sent, size, docs_so_far, number = [], [], 0, 0, number + 1
        if base:
            yield packed(number, base, sent)

    def look_up(known: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """For each packed row of keys the sums of their values by document; rows of documents as they are."""
        out = []
        asked = rows[rows["key"].notna()]
        if len(asked) and len(known):
            key = np.concatenate([keys_of(x) for x in known["key"]])
            order = np.argsort(key)
            a, b = (np.concatenate([np.frombuffer(x) for x in known[c]])[order] for c in ("a", "b"))
            key = key[order]
            for chunk, wanted, code in zip(asked["chunk"], asked["key"], asked["code"], strict=True):
                wanted, code = keys_of(wanted), from_small(code)
                place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                value = np.where(key[place] == wanted, np.where(code % 3 == FOLLOWS, b[place], a[place]), 0.0)
                total = np.bincount(code // 3, value)
                doc = np.flatnonzero(total)
                out.append((chunk, small(doc), total[doc].tobytes(), None, None, None))
        found = pd.DataFrame(out, columns=["chunk", "doc", "total", "tid", "lang", "figures"])
        plain = rows.loc[rows["key"].isna(), ["chunk", "tid", "lang", "figures"]].assign(doc=None, total=None)[found.columns]
        return plain if not len(found) else pd.concat([found, plain]) if len(plain) else found

    def add(group: pd.DataFrame) -> pd.DataFrame:
        """The documents of one chunk with their sums."""
        base = group[group["tid"].notna()].iloc[0]
        figures = np.frombuffer(base["figures"]).reshape(-1, 5)
        sums = figures[:, 0].copy()
        for doc, total in zip(group["doc"], group["total"], strict=True):
            if doc is not None:
                sums[from_small(doc)] += np.frombuffer(total)
        out = {"tid": np.frombuffer(base["tid"], dtype=np.int64), "lang": np.frombuffer(base["lang"], dtype=np.int64), "held": sums}
        return pd.DataFrame(out | {x: figures[:, k] for k, x in enumerate(("n", "letters", "fresh", "n_symbols"), 1)})

    total = F.col("held") + F.col("n") * F.col("unknown") - F.lit(LETTER) * F.col("letters")
    known = model.select("bucket", "key", "a", "b").groupBy("bucket")
    parts = []
    for k in range(slices):
        some = docs.where(F.pmod("tid", F.lit(slices)) == k).select("tid", "lang", "text")
        sent = some.mapInPandas(work, "chunk BIGINT, bucket INT, key BINARY, code BINARY, tid BINARY, lang BINARY, figures BINARY")
        found = known.cogroup(sent.groupBy("bucket")).applyInPandas(look_up, "chunk BIGINT, doc BINARY, total BINARY, tid BINARY, lang BINARY, figures BINARY")
        scored = found.groupBy("chunk").applyInPandas(add, "tid BIGINT, lang BIGINT, held DOUBLE, n DOUBLE, letters DOUBLE, fresh DOUBLE, n_symbols DOUBLE")
        scored = scored.join(F.broadcast(rates), "lang").select(
            "tid", (-total / F.col("n_symbols")).alias("word_nll"), F.when(F.col("n") > 0, 1 - F.col("fresh") / F.col("n")).otherwise(0.0).alias("stale")
        )
        parts.append(keep(scored, f"by_words_{k}"))
    shared.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
