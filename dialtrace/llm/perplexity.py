"""Quality classifier: perplexity under Kneser-Ney models of trusted text, of symbols and of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import in_small_batches, keep_nothing
from dialtrace.session import free, keep, keep_by

#: A trusted document calibrates the thresholds if its hash falls on 0 of so many, else it trains.
CALIBRATE = 5
#: Share of trusted documents of a language that lies within each of its limits, and the
#: slack in standard deviations, which falls as more calibrating documents lie beyond the quantile.
#: Measured on sf0.1: with slack 0, 1, 2, 3 it keeps 16, 20, 23, 39 of 571 documents labelled bad and
#: 368, 371, 373, 374 of 382 labelled good that neither train nor calibrate (as they are toxic).
QUANTILE = 0.995
SLACK = 3.0
#: Ids of trusted documents that are broadcast at most; more are joined by shuffle. All count either way.
TRUSTED_ROWS = 1_000_000
#: Frequent rows of the word model that every task holds, and 64-bit cells of the filter of
#: all its keys. Both only spare rows in the shuffle; results are the same without.
HEAD_ROWS = 1 << 16
FILTER_CELLS = 1 << 19
#: Words of the model that are broadcast at most to price their pairs; more are joined by shuffle.
WORD_ROWS = 1 << 19
#: Parts of the documents that meet the word model one after the other, and of the pairs that do
#: when it is made. A document's words and pairs take more bytes than its text: the shuffle of a
#: part goes before the next begins.
SLICES = 8
#: Words among which a pair of words counts as new once.
BLOCK = 256
#: Rows of the model in one shard; a shard is all that is broadcast at once.
SHARD_ROWS = 1 << 15
#: Symbols that are counted or scored at once, unless one text alone is longer.
CHUNK = 500_000

#: The symbols of the model. 0 begins a text; all capitals are one symbol, all
#: digits another, and so are letters and signs that are not listed.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñíóáúù"
BEGIN, CAPITAL, DIGIT, OTHER_LETTER, BLANK, LINE, DOT, COMMA, SIGN = 0, 1, 2, 3, 4, 5, 6, 7, 8
SYMBOLS = 9 + len(LETTERS)
ORDER = 4


def symbol_table() -> np.ndarray:
    """Symbol of each code point of the first planes' start; later ones are letters."""
    table = np.full(0x2000, OTHER_LETTER, dtype=np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c in LETTERS:
            table[code] = 9 + LETTERS.index(c)
        elif c.isupper():
            table[code] = CAPITAL
        elif c.isdigit():
            table[code] = DIGIT
        elif c == "\n":
            table[code] = LINE
        elif c.isspace():
            table[code] = BLANK
        elif c in ".,":
            table[code] = DOT if c == "." else COMMA
        elif not c.isalpha():
            table[code] = SIGN
    return table


TABLE = symbol_table()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, each behind three beginnings; places of the texts' symbols and where each text starts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths) - lengths
    row = np.zeros(len(codes) + (ORDER - 1) * len(texts), dtype=np.int32)
    place = np.arange(len(codes)) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), lengths)
    row[place] = TABLE[np.minimum(codes, len(TABLE) - 1)]
    return row, place, starts


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Context number and symbol of every symbol of the texts."""
    row, place, _ = symbols(texts)
    context = (row[place - 3] * SYMBOLS + row[place - 2]) * SYMBOLS + row[place - 1]
    return context, row[place]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, context, symbol, n: counts of all n-grams of the texts, summed in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts, at = group["text"].tolist(), 0
                while at < len(texts):
                    stop, size = at, 0
                    while stop < len(texts) and size < CHUNK:
                        size, stop = size + len(texts[stop]), stop + 1
                    context, symbol = ngrams(texts[at:stop])
                    gram, n = np.unique(context * SYMBOLS + symbol, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "context": gram // SYMBOLS, "symbol": gram % SYMBOLS, "n": n})
                    at = stop

    found = docs.select("lang", "text").mapInPandas(count, "lang STRING, context INT, symbol INT, n BIGINT")
    return found.groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from how many n-grams occur 1 to 4 times."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0] + [min(max(d, 0.05), k) for k, d in enumerate(out, 1)])


def interpolate(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of each row's symbols: discounted counts, and the rest by the lower order."""
    d = discounts(counts)
    taken = d[np.minimum(counts, 3).astype(np.int64)]
    total = counts.sum(axis=1, keepdims=True)
    seen = total > 0
    share = np.where(seen, taken.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
    return np.maximum(counts - taken, 0) / np.maximum(total, 1) + share * lower


def kneser_ney(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and log-probabilities of one language, interpolated over four orders.

    Orders below the highest count in how many contexts an n-gram occurs. The rows are
    the contexts that occur, and behind them, under negative numbers, those of the next
    order, which answer for contexts that do not.
    """
    k = SYMBOLS
    tri = np.bincount((context % (k * k)) * k + symbol, minlength=k**3).reshape(k * k, k)
    bi = (tri.reshape(k, k, k) > 0).sum(axis=0)
    uni = (bi > 0).sum(axis=0)
    p1 = interpolate(uni[None, :], np.full((1, k), 1 / k))
    p2 = interpolate(bi, np.broadcast_to(p1, bi.shape))
    p3 = interpolate(tri, np.tile(p2, (k, 1)))
    contexts, row = np.unique(context, return_inverse=True)
    four = np.zeros((len(contexts), k), dtype=np.int64)
    four[row, symbol] = n
    p4 = interpolate(four, p3[contexts % (k * k)])
    return np.concatenate([contexts, -1 - np.arange(k * k)]), np.log(np.concatenate([p4, p3])).astype(np.float32)


def train(counts: DataFrame) -> DataFrame:
    """lang, context, logps: the model rows. A language has at most SYMBOLS ** 4 counts, which is one task's work."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        contexts, logps = kneser_ney(rows["context"].to_numpy(np.int64), rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "context": contexts, "logps": list(logps)})

    return counts.groupBy("lang").applyInPandas(fit, "lang STRING, context BIGINT, logps ARRAY<FLOAT>")


#: Scripts that are written without blanks, where each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W\d_{UNSPACED}]+|\d+|[^\w\s]|_|[{UNSPACED}]")
#: The same words of a text in ASCII.
ASCII_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\w\s]|_")


class Numbered(dict):
    """Word -> its number, in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of each pair of 64-bit keys."""
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> np.uint64(31))) + b) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def unmixed(a: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The ``b`` of ``mixed(a, b)``."""
    inverse = np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(29)) ^ (key >> np.uint64(58))) * inverse - (x ^ (x >> np.uint64(31)))


def lang_key(lang: str) -> np.ndarray:
    """The number of a language, as an array of one."""
    return pd.util.hash_array(np.array([lang], dtype=object))


def numbered(texts: list[str], lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many words each text has, the number of each word in a row, and of each number the key and the length."""
    found = [(ASCII_TOKEN if t.isascii() else TOKEN).findall(t) for t in texts]
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    numbers = Numbered()
    row = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(n.sum()))
    # each word is hashed once
    every = np.array([*numbers, None], dtype=object)[:-1]
    own = mixed(np.broadcast_to(lang_key(lang), len(every)), pd.util.hash_array(every)) if len(every) else np.zeros(0, dtype=np.uint64)
    return n, row, own, np.fromiter(map(len, every), dtype=np.int64, count=len(every))


def words(texts: list[str], lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words in a row: the text of each, the keys of the word before and of itself, and its length. 0 begins a text."""
    n, row, every, length = numbered(texts, lang)
    own = every[row]
    before = np.roll(own, 1)
    before[(np.cumsum(n) - n)[n > 0]] = mixed(lang_key(lang), np.zeros(1, dtype=np.uint64))[0]
    return np.repeat(np.arange(len(texts)), n), before, own, length[row]


def in_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK symbols."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and size < CHUNK:
            size, stop = size + len(texts[stop]), stop + 1
        yield at, stop
        at = stop


def count_words(docs: DataFrame) -> DataFrame:
    """lang (its number), key, before, word, length, n: counts of all pairs of words, summed in each task first and grouped by key."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts, number = group["text"].tolist(), lang_key(lang).view(np.int64)[0]
                for at, stop in in_chunks(texts):
                    _, before, own, length = words(texts[at:stop], lang)
                    key, first, n = np.unique(mixed(before, own), return_index=True, return_counts=True)
                    # rows with one word before them are together, which the shuffle packs well
                    order = np.argsort(before[first], kind="stable")
                    key, first, n = key[order], first[order], n[order]
                    yield pd.DataFrame({"lang": number, "key": key.view(np.int64), "before": before[first].view(np.int64), "length": length[first], "n": n})

    found = docs.select("lang", "text").mapInPandas(count, "lang BIGINT, key BIGINT, before BIGINT, length BIGINT, n BIGINT")
    # a key stands for its pair; the word is not shuffled, as the key and the word before tell it
    summed = found.groupBy("key").agg(*[F.max(c).alias(c) for c in ("lang", "before", "length")], F.sum("n").alias("n"))
    return summed.select("lang", "key", "before", word_of("before", "key").alias("word"), "length", "n")


def word_of(before: str, key: str) -> Column:
    """``unmixed`` of two columns."""

    @F.pandas_udf("bigint")
    def word(a: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(unmixed(a.to_numpy(np.int64).view(np.uint64), k.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return word(before, key)


def discount_of(n: str) -> Column:
    """The discount of Kneser-Ney from how many rows have the counts 1 and 2."""
    once, twice = (F.count(F.when(F.col(n) == k, 1)) for k in (1, 2))
    return F.when(once > 0, F.least(F.greatest(once / (once + 2 * twice), F.lit(0.05)), F.lit(0.95))).otherwise(0.5)


def train_words(pairs: DataFrame, word_rows: int = WORD_ROWS) -> tuple[DataFrame, DataFrame]:
    """The word model, as key, a, b and n in buckets of the key, and per language what an unknown word and each of its letters cost.

    The plain form by joins of single rows; ``classify`` takes the packed one of
    ``word_model``, which tests hold to this.

    The log-probability of a text is that of as many unknown words, and for each known
    word ``a`` where it stands and ``b`` where another follows, and for each known pair
    its ``a``: interpolated Kneser-Ney of order 2 over the words of any alphabet, in
    which the mass of unknown words is spelled in the symbols of a code of 256.
    Counts of words and pairs grow with the trusted text and stay in tables. Up to
    ``word_rows`` words are broadcast to their pairs, which so stay in their buckets; with
    more, pairs are joined by shuffle, in parts.
    """
    places = pairs.select("lang", F.col("word").alias("key"), "length", F.lit(1).alias("kinds"), F.lit(0).alias("total"), F.lit(0).alias("follow")).unionByName(
        pairs.select("lang", F.col("before").alias("key"), F.lit(0).alias("length"), F.lit(0).alias("kinds"), F.col("n").alias("total"), F.lit(1).alias("follow"))
    )
    # a key stands for its word and language
    kinds = places.groupBy("key").agg(*[F.max(c).alias(c) for c in ("lang", "length")], *[F.sum(c).alias(c) for c in ("kinds", "total", "follow")])
    kinds = keep_by([kinds], "words", "key")
    seen = kinds.where("kinds > 0").groupBy("lang").agg(discount_of("kinds").alias("d1"), F.sum("kinds").alias("all_kinds"), F.count(F.lit(1)).alias("n_words"))
    rates = keep(seen.join(pairs.groupBy("lang").agg(discount_of("n").alias("d2")), "lang").withColumn("unknown", F.log(F.col("d1") * F.col("n_words") / F.col("all_kinds"))), "rates")
    letter = F.lit(float(np.log(256)))
    spelled = F.col("unknown") - letter * (F.col("length") + 1)
    known = kinds.join(F.broadcast(rates), "lang").select(
        "key", "total", "kinds",
        F.when(F.col("kinds") > 0, F.log((F.col("kinds") - F.col("d1")) / F.col("all_kinds") + F.exp(spelled))).alias("p1"),
        F.when(F.col("total") > 0, F.log(F.col("d2") * F.col("follow") / F.col("total"))).alias("rest"), spelled.alias("spelled"), "d2",
    )
    # in buckets, so that no part of the pairs shuffles all words again
    known = keep_by([known], "known_words", "key")
    free(kinds)
    buckets = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [known.select("key", F.coalesce(F.col("p1") - F.col("spelled"), F.lit(0.0)).alias("a"), F.coalesce("rest", F.lit(0.0)).alias("b"), F.greatest("total", "kinds").alias("n"))]
    if known.count() <= word_rows:
        parts.append(priced(pairs, F.broadcast(known)))
    else:
        parts += [priced(pairs.where(F.pmod("key", F.lit(SLICES)) == k), known).repartition(buckets, "key") for k in range(SLICES)]
    model = keep_by(parts, "word_model", "key")
    free(known)
    return model, rates.select("lang", "unknown")


def priced(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of pairs in the word model: what each adds to the log-probability of its words."""
    before = known.select(F.col("key").alias("before"), "total", "rest", "d2")
    return (
        pairs.join(before, "before")
        .join(known.select(F.col("key").alias("word"), "p1"), "word")
        .select("key", "n", ((F.col("n") - F.col("d2")) / F.col("total")).alias("own"), (F.col("rest") + F.col("p1")).alias("less"))
        .select("key", (F.log(F.col("own") + F.exp("less")) - F.col("less")).alias("a"), F.lit(0.0).alias("b"), "n")
    )


def score_words(docs: DataFrame, model: DataFrame, rates: DataFrame, head_rows: int = HEAD_ROWS, cells: int = FILTER_CELLS, slices: int = SLICES) -> DataFrame:
    """tid, word_nll (nats a symbol) and stale (share of pairs that their block had before).

    The distinct words and pairs of each document meet the model by shuffle and their
    log-probabilities are added up by document. The most frequent keys are looked up
    in the task, and keys that a filter of fixed size does not know are not sent. The
    documents go in ``slices`` parts by their tid, each written before the next, so
    that the shuffle files of one part are all there are at once.
    """
    context = docs.sparkSession.sparkContext
    head = model.orderBy(F.desc("n"), "key").limit(head_rows).select("key", "a", "b").toArrow().to_pandas().sort_values("key")
    marks = model.select(F.expr(f"pmod(key >> 6, {cells})").alias("cell"), F.expr("1L << CAST(key & 63 AS INT)").alias("bit"))
    marks = marks.groupBy("cell").agg(F.expr("bit_or(bit)").alias("bits")).toArrow().to_pandas()
    bits = np.zeros(cells, dtype=np.int64)
    bits[marks["cell"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    shared = context.broadcast((head["key"].to_numpy(np.int64), head["a"].to_numpy(), head["b"].to_numpy(), bits))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        keys, a, b, bits = shared.value
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts, ids = group["text"].tolist(), group["tid"].to_numpy(np.int64)
                for at, stop in in_chunks(texts):
                    doc, before, own, length = words(texts[at:stop], lang)
                    n = np.bincount(doc, minlength=stop - at)
                    block = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) // BLOCK
                    pairs = mixed(before, own)
                    _, new = np.unique(mixed(pairs, ((doc << 32) + block).astype(np.uint64)), return_index=True)
                    fresh = np.bincount(doc[new], minlength=stop - at)
                    # each document's distinct keys, and how often they stand and are followed; all but its last word are
                    ends = np.zeros(len(doc), dtype=bool)
                    ends[(np.cumsum(n) - 1)[n > 0]] = True
                    begins = np.flatnonzero(n > 0)
                    every = np.concatenate([own, pairs, np.broadcast_to(mixed(lang_key(lang), np.zeros(1, dtype=np.uint64)), len(begins))])
                    docs_of = np.concatenate([doc, doc, begins])
                    _, first, group_of = np.unique(mixed(every, docs_of.astype(np.uint64)), return_index=True, return_inverse=True)
                    w = len(doc)
                    stands = np.bincount(group_of[: 2 * w], minlength=len(first))
                    follows = np.bincount(group_of[:w][~ends], minlength=len(first)) + np.bincount(group_of[2 * w :], minlength=len(first))
                    # in order of the documents, so that a row looks like the one before
                    order = np.argsort(docs_of[first], kind="stable")
                    first, stands, follows = first[order], stands[order], follows[order]
                    key, d = every[first].view(np.int64), docs_of[first]
                    place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                    here = keys[place] == key if len(keys) else np.zeros(len(key), dtype=bool)
                    held = np.zeros(stop - at)
                    if here.any():
                        held = np.bincount(d[here], stands[here] * a[place[here]] + follows[here] * b[place[here]], minlength=stop - at)
                    sent = ~here & ((bits[(key >> 6) % cells] >> (key & 63)) & 1 == 1)
                    letters = np.bincount(doc, length + 1, minlength=stop - at)
                    sizes = np.fromiter(map(len, texts[at:stop]), dtype=np.int64, count=stop - at)
                    figures = np.stack([held, n, letters, fresh, sizes], axis=1).astype(np.float64)
                    none, number = np.zeros(stop - at, dtype=np.int64), lang_key(lang).view(np.int64)[0]
                    yield pd.DataFrame({"tid": ids[at:stop], "key": ids[at:stop], "own": none, "next": none, "lang": pd.array(np.full(stop - at, number), dtype="Int64"), "figures": list(figures)})
                    yield pd.DataFrame({"tid": ids[at:stop][d[sent]], "key": key[sent], "own": stands[sent], "next": follows[sent], "lang": pd.NA, "figures": None}).astype({"lang": "Int64"})

    figures = ("held", "n", "letters", "fresh", "n_symbols")
    known = F.sum(F.coalesce(F.col("own") * F.col("a") + F.col("next") * F.col("b"), F.lit(0.0)))
    sums = [F.max("lang").alias("lang"), known.alias("sent"), *[F.sum(F.col("figures")[k]).alias(x) for k, x in enumerate(figures)]]
    total = F.col("held") + F.col("sent") + F.col("n") * F.col("unknown") - F.lit(float(np.log(256))) * F.col("letters")
    parts = []
    for k in range(slices):
        some = docs.where(F.pmod("tid", F.lit(slices)) == k).select("tid", "lang", "text")
        sent = some.mapInPandas(work, "tid BIGINT, key BIGINT, own INT, next INT, lang BIGINT, figures ARRAY<DOUBLE>")
        scored = sent.join(model.select("key", "a", "b"), "key", "left").groupBy("tid").agg(*sums).join(F.broadcast(rates), "lang")
        scored = scored.select(
            "tid", (-total / F.col("n_symbols")).alias("word_nll"), F.when(F.col("n") > 0, 1 - F.col("fresh") / F.col("n")).otherwise(0.0).alias("stale")
        )
        parts.append(keep(scored, f"by_words_{k}"))
    shared.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score(docs: DataFrame, model: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """tid, doc_id, lang, n_symbols and nll (nats a symbol, of a language with a model).

    The model is split into shards of ``shard_rows`` rows by language and context. Each
    shard is joined to the n-grams of all documents where they are, and gives a part of
    their log-probability; the parts of a document are added up. A broadcast so is
    bounded whatever the number of languages.
    """
    spark = docs.sparkSession
    langs = [r["lang"] for r in model.select("lang").distinct().orderBy("lang").toLocalIterator()]
    sizes = {r["lang"]: r["n"] for r in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    # languages are put together as long as they fit; the contexts of one language stay together,
    # as they are at most SYMBOLS ** 3 + SYMBOLS ** 2
    shards: list[list[str]] = []
    filled = shard_rows
    for lang in langs:
        if filled + sizes[lang] > shard_rows:
            shards.append([])
            filled = 0
        shards[-1].append(lang)
        filled += sizes[lang]
    parts = []
    for shard in shards:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in shard:
            # as Arrow columns: rows of Python numbers take ten times the driver's memory
            rows = model.where(F.col("lang") == lang).select("context", "logps").toArrow()
            contexts = rows["context"].to_numpy()
            logps = rows["logps"].combine_chunks().flatten().to_numpy().reshape(-1, SYMBOLS)
            del rows
            # row of each context; a context that does not occur has the row of the next order
            k = SYMBOLS
            row_of = np.empty(k**3, dtype=np.int32)
            low = contexts < 0
            lower = np.empty(k * k, dtype=np.int32)
            lower[-1 - contexts[low]] = np.flatnonzero(low)
            row_of[:] = np.tile(lower, k)
            row_of[contexts[~low]] = np.flatnonzero(~low)
            held[lang] = (row_of, logps)
        shared = spark.sparkContext.broadcast(held)

        def work(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keep_nothing()
            for batch in batches:
                for lang, group in batch.groupby("lang"):
                    if lang not in shared.value:
                        continue
                    row_of, logps = shared.value[lang]
                    texts, ids = group["text"].tolist(), group["doc_id"].to_numpy()
                    sums, at = np.zeros(len(texts)), 0
                    while at < len(texts):
                        stop, size = at, 0
                        while stop < len(texts) and size < CHUNK:
                            size, stop = size + len(texts[stop]), stop + 1
                        context, symbol = ngrams(texts[at:stop])
                        lengths = np.fromiter(map(len, texts[at:stop]), dtype=np.int64, count=stop - at)
                        lp = np.append(np.cumsum(logps[row_of[context], symbol], dtype=np.float64), 0.0)
                        ends = np.cumsum(lengths)
                        sums[at:stop] = lp[ends - 1] - np.where(ends > lengths, lp[ends - lengths - 1], 0.0)
                        at = stop
                    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                    yield pd.DataFrame({"doc_id": ids, "lang": lang, "tid": group["tid"].to_numpy(), "n_symbols": n, "nll": -sums / n})

        parts.append(docs.where(F.col("lang").isin(shard)).mapInPandas(work, "doc_id BIGINT, lang STRING, tid BIGINT, n_symbols BIGINT, nll DOUBLE"))
    if not parts:
        return spark.createDataFrame([], "doc_id BIGINT, lang STRING, tid BIGINT, n_symbols BIGINT, nll DOUBLE")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def thresholds(scored: DataFrame, column: str = "nll", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """lang and the column's limit: the quantile of the calibrating documents, in steps of 0.001, and the slack."""
    some = scored.where("trust = 1")
    spread = some.groupBy("lang").agg(F.coalesce(F.stddev(column), F.lit(0.0)).alias("sd"))
    bins = some.groupBy("lang", F.floor(F.col(column) * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sums = bins.select(
        "lang", "bin", F.expr("sum(n) OVER (PARTITION BY lang ORDER BY bin)").alias("up_to"), F.expr("sum(n) OVER (PARTITION BY lang)").alias("total")
    )
    found = sums.where(F.col("up_to") >= F.lit(quantile) * F.col("total")).groupBy("lang").agg(((F.min("bin") + 1) / 1000).alias("at"), F.max("total").alias("total"))
    more = F.lit(slack) * F.col("sd") * (1 / (1 + (1 - quantile) * F.col("total")) + 1 / F.sqrt("total"))
    return found.join(spread, "lang").select("lang", (F.col("at") + more).alias("limit" if column == "nll" else f"{column}_limit"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    slack: float = SLACK,
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, limit and kept of every document, and the word measures with their limits.

    Documents labelled good and not toxic are trusted. Four in five train the models of
    each language, the rest set its limits: a document is rejected if its mean surprise
    by symbols, its mean surprise by words, or the share of its word pairs that the same
    block of words had before exceeds the quantile of those. Where few documents lie
    beyond the quantile it is not known well, so a slack is added that falls with their
    number. All trusted documents count; up to ``trusted_rows`` ids are broadcast, so
    that the texts stay where they are, and more are joined by shuffle.

    An empty or missing text has no perplexity and is rejected. A document in a language
    without trusted text has none either and is kept, as there is nothing to hold
    against it; so it is without calibrating documents. A missing language is a language
    of its own. Repeated labels count once; rows without a label or an id are not
    trusted. Repeated rows have a row each; further columns are not read.
    """
    from dialtrace.llm import word_model

    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = good.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    trusted = keep(good.select("doc_id", F.when(fold, 1).otherwise(2).alias("trust")), "trusted")
    texts = in_small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    some = texts.where("text <> ''").withColumn("tid", F.xxhash64("doc_id", "lang", "text"))
    training = trusted.where("trust = 2").select("doc_id")
    train_texts = some.join(F.broadcast(training) if trusted.count() <= trusted_rows else training, "doc_id", "left_semi")
    grams = keep(count_ngrams(train_texts), "ngrams")
    model = keep(train(grams), "model")
    free(grams)
    words_of, rates = word_model.train(train_texts)
    by_words = word_model.score(some, words_of, rates)
    free(words_of)
    scored = score(some, model).join(by_words, "tid", "left").join(trusted, "doc_id", "left")
    scored = keep(scored, "scored")
    free(by_words)
    judged = scored
    for column in ("nll", "word_nll", "stale"):
        judged = judged.join(thresholds(scored, column, quantile, slack), "lang", "left")
    within = F.lit(True)
    for column, limit in (("nll", "limit"), ("word_nll", "word_nll_limit"), ("stale", "stale_limit")):
        within = within & F.coalesce(F.col(column) <= F.col(limit), F.lit(True))
    judged = judged.select(
        "doc_id", "lang", "n_symbols", F.exp("nll").alias("perplexity"), "limit", within.alias("kept"), "word_nll", "word_nll_limit", "stale", "stale_limit"
    )
    no_value = F.lit(None).cast("double")
    rest = texts.join(model.select("lang").distinct(), "lang", "left_anti").where("text <> ''").unionByName(texts.where("text = ''"))
    unscored = rest.select(
        "doc_id", "lang", F.length("text").cast("bigint").alias("n_symbols"), no_value.alias("perplexity"), no_value.alias("limit"), (F.col("text") != "").alias("kept"),
        *[no_value.alias(c) for c in ("word_nll", "word_nll_limit", "stale", "stale_limit")],
    )
    return judged.unionByName(unscored)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns.

    Rows that share an id are kept or rejected together; a row without an id has no
    verdict and stays if it has a text. Rows with a missing or empty text go; repeated
    rows all stay or go. Columns may have any names. An empty table gives no rows.
    """
    bad = keep(classify(docs, labels).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "rejected")
    return docs.where("text <> ''").join(bad, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
