"""Near-duplicate documents: an exact Jaccard join of their word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import free_name, in_small_batches, keep_nothing, whole_text
from dialtrace.llm.components import components
from dialtrace.session import free, keep

#: Words of a shingle, and the similarity from which documents link, in hundredths.
WORDS = 5
SIMILAR = 80
#: Cells of the frequency sketch, bits of a filter: what is broadcast, whatever the input.
SKETCH = 1 << 20
FILTER = 1 << 25
#: Parts of the shingles whose sizes the suffix filter compares, as words of 64 bits.
PARTS = 16 * 64
#: Rounds of links to hubs before the pairs of what is still apart are made.
HUB_ROUNDS = 3
#: Bytes of text that are hashed at once, unless one text alone is longer.
CHUNK = 500_000

_rng = np.random.default_rng(20240917)
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
PLACE_VALUE = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
MIX, MIX2, BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: The white space between words.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return (h ^ (h >> np.uint64(29))) * MIX2


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and a 64-bit hash of it: a power sum of its bytes, mixed."""
    row = np.frombuffer(data, dtype=np.uint8)
    word = ~IS_SPACE[row]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # sums over words from sums up to each place; powers are taken relative to the word's start
    power = np.multiply.accumulate(np.full(len(row) + 1, BASE, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUE[row] * power[:-1], dtype=np.uint64)])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    back = np.multiply.accumulate(np.full(len(row) + 1, inverse, dtype=np.uint64))
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str], width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of ``width`` words, at most WORDS."""
    at = 0
    while at < len(texts):
        stop, size, held = at, 0, []
        while stop < len(texts) and size < CHUNK:
            held.append(texts[stop].encode("utf-8", "surrogatepass").lower())
            size, stop = size + len(held[-1]) + 1, stop + 1
        starts, words = word_hashes(b"\n".join(held))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))
        # a chunk of fewer words than a shingle, as a short text that is left over, has none
        whole = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            whole += words[k : k + len(whole)] * PLACE_VALUE[k]
        whole = mix(whole)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * PLACE_VALUE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)
        at = stop


def frequency_sketch(texts: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each cell: a bound above each shingle's frequency.

    Tasks add up their documents, the parts of the sketch are added up by the shuffle,
    and only the sketch, of a fixed size, comes to the driver.
    """
    rows = 64

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            held, n = [], 0
            for one in shingle_sets(batch["text"].tolist()):
                held.append((one & np.uint64(SKETCH - 1)).astype(np.int64))
                n += len(one)
                if n > SKETCH:
                    total += np.bincount(np.concatenate(held), minlength=SKETCH)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=SKETCH)
        yield pd.DataFrame({"part": range(rows), "counts": [x.astype("<i4").tobytes() for x in np.split(np.minimum(total, 2**31 - 1), rows)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // rows, dtype=np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, dtype="<i4")
        return pd.DataFrame({"part": [group["part"].iloc[0]], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    parts = texts.select("text").mapInPandas(count, "part INT, counts BINARY")
    # two steps, so that no task adds up the parts of all others
    some = parts.withColumn("some", F.spark_partition_id() % 32).groupBy("part", "some").applyInPandas(add, "part INT, counts BINARY")
    found = {r["part"]: r["counts"] for r in some.groupBy("part").applyInPandas(add, "part INT, counts BINARY").collect()}
    if not found:
        return np.zeros(SKETCH, dtype=np.int32)
    return np.concatenate([np.frombuffer(found[k], dtype="<i4") for k in range(rows)])


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER bits with the bit of every value of ``key`` set, for a test that may pass too many.

    Tasks put the words of the filter together; 64 rows of bytes come to the driver, not a row for each word.
    """
    rows = 64
    size = FILTER // 64 // rows
    bit = F.pmod(F.col("key"), F.lit(FILTER))
    words = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {FILTER}), 64) as int))")).alias("bits"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        part, out = int(group["at"].iloc[0]) // size, np.zeros(size, dtype="<i8")
        out[group["at"].to_numpy(np.int64) - part * size] = group["bits"].to_numpy(np.int64)
        return pd.DataFrame({"part": [part], "bits": [out.tobytes()]})

    out = np.zeros(FILTER // 64, dtype=np.int64)
    for r in words.groupBy(F.floor(F.col("at") / size).alias("part")).applyInPandas(fill, "part INT, bits BINARY").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], dtype="<i8")
    return out.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) & (FILTER - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def odd_parts(one: np.ndarray) -> np.ndarray:
    """A bit for each part of the shingles, by their first bits, that holds an odd number of them."""
    odd = np.bincount((one >> np.uint64(54)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefixes(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """doc_id, row_key, n, node, prefix, odd of every document.

    ``node`` is a hash of the shingle set, so documents of equal sets are one node;
    ``prefix`` has its rarest shingles by the sketch, as many as a partner must share one
    of; ``odd`` is ``odd_parts``.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        for batch in batches:
            out = []
            for doc_id, row_key, one in zip(batch["doc_id"], batch["row_key"], shingle_sets(batch["text"].tolist()), strict=True):
                n = len(one)
                if n:
                    order = np.lexsort((one, shared.value[one & np.uint64(SKETCH - 1)]))[: n - (SIMILAR * n + 99) // 100 + 1]
                    out.append((doc_id, row_key, n, np.uint64(xxhash.xxh3_64_intdigest(one.tobytes())).astype(np.int64), one[order].view(np.int64), odd_parts(one)))
                else:
                    out.append((doc_id, row_key, 0, None, [], []))
            frame = pd.DataFrame(out, columns=["doc_id", "row_key", "n", "node", "prefix", "odd"])
            yield frame.assign(doc_id=pd.array(batch["doc_id"].astype("Int64")), node=pd.array([None if x[3] is None else int(x[3]) for x in out], dtype="Int64"))

    return texts.mapInPandas(work, "doc_id BIGINT, row_key BINARY, n INT, node BIGINT, prefix ARRAY<BIGINT>, odd ARRAY<BIGINT>")


def shared_rows(docs: DataFrame) -> DataFrame:
    """shingle, node, n, place: the prefix shingles that several nodes have.

    Most prefix shingles are of one node. A filter of those of several, whose size is
    fixed, spares their rows the shuffle; what passes too much goes in the join.
    """
    spark = docs.sparkSession
    rows = docs.where("n > 0").select("node", F.explode("prefix").alias("shingle"))
    several = keep(
        rows.groupBy("shingle").agg(F.min("node").alias("one"), F.max("node").alias("other")).where("one <> other").select("shingle"), "several"
    )
    bits = spark.sparkContext.broadcast(bit_filter(several.select(F.col("shingle").alias("key"))))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            size = batch["prefix"].map(len).to_numpy()
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in batch["prefix"]])
            row = np.repeat(np.arange(len(batch)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(passes(bits.value, flat))
            yield pd.DataFrame({"shingle": flat[at], "node": batch["node"].to_numpy(np.int64)[row[at]], "n": batch["n"].to_numpy()[row[at]], "place": place[at]})

    some = docs.where("n > 0").select("node", "n", "prefix").mapInPandas(work, "shingle BIGINT, node BIGINT, n INT, place INT")
    # documents of equal sets have equal rows; one is enough
    shared = keep(some.join(several, "shingle").distinct(), "shared")
    bits.destroy()
    return shared


def may_link(na: str, nb: str, odd_a: str, odd_b: str) -> Column:
    """Length and suffix filter of two sets.

    Length: the smaller one has the needed share of the larger one. Suffix: a part whose
    size is odd in one set and even in the other holds a shingle of one of them alone,
    so such parts bound the difference from below and what the sets share from above.
    """
    differ = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col(na) + F.col(nb)
    return (100 * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)) & ((100 + SIMILAR) * (both - differ) >= 2 * SIMILAR * both)


def links_of(pairs: DataFrame, texts: DataFrame, width: int = WORDS) -> DataFrame:
    """Those of the pairs (a, b) that link by the whole sets of their texts, which tasks make anew: a set is longer than its text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        for batch in batches:
            # a hub comes with many partners in a row: its set is made once
            new = (batch["b"] != batch["b"].shift()).to_numpy()
            hubs = list(shingle_sets(batch["tb"][new].tolist(), width))
            found = []
            for one, k in zip(shingle_sets(batch["ta"].tolist(), width), np.cumsum(new) - 1, strict=True):
                common = len(np.intersect1d(one, hubs[k], assume_unique=True))
                found.append(100 * common >= SIMILAR * (len(one) + len(hubs[k]) - common))
            yield batch.loc[np.array(found, dtype=bool), ["a", "b"]]

    def side(x: str) -> DataFrame:
        """The texts that pairs have on this side; only these are shuffled where the pairs are few."""
        some = texts.join(pairs.select(F.col(x).alias("node")).distinct(), "node", "left_semi")
        return some.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(work, "a BIGINT, b BIGINT")


def untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """The pairs that were not compared yet, in either direction."""
    if tested is None:
        return pairs
    both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def star_round(rows: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each node and one hub of another component, each once.

    Every shingle names a few of its nodes as hubs. Of the hubs that a node's shingles
    name and that pass the filters, it is compared to the one that most of them name.
    """
    dealt = F.xxhash64(F.lit(turn), "node")
    hubs = rows.groupBy("shingle").agg(F.min_by("node", "component"), F.max_by("node", "component"), F.min_by("node", dealt), F.max_by("node", dealt))
    named = hubs.select("shingle", F.explode(F.array_distinct(F.array(*hubs.columns[1:]))).alias("hub"))
    of_hub = rows.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")).distinct()
    met = rows.join(named, "shingle").groupBy("node", "component", "hub").agg(F.count(F.lit(1)).alias("c"))
    info = nodes.select("node", "n", "odd")
    sized = met.join(of_hub, "hub").where("component <> hub_component").join(info.select("node", F.col("n").alias("na"), F.col("odd").alias("oa")), "node")
    sized = sized.join(info.select(F.col("node").alias("hub"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "hub").where(may_link("na", "nb", "oa", "ob"))
    best = sized.groupBy("node").agg(F.max_by("hub", "c").alias("b")).withColumnRenamed("node", "a")
    # two nodes that chose each other are one pair
    return best.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).dropDuplicates(["low", "high"]).select("a", "b")


def with_component(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The shared rows with their node's component, of shingles that several components have."""
    named = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ones = named.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("shingle")
    return named.join(open_ones, "shingle")


def cross_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle and pass all filters.

    a is the smaller set, so it shares one of even fewer of its rarest shingles. Place:
    both prefixes are in one order, so what two sets share lies at or behind their first
    common shingle, and what is left there must be enough. The filters are part of the
    join's condition: pairs that fail one are not made.
    """
    rows = keep(rows.join(nodes.select("node", "odd"), "node").select("shingle", "node", "n", "place", "component", "odd"), "cross")
    left = rows.select("shingle", *[F.col(c).alias(x) for c, x in (("node", "a"), ("n", "na"), ("place", "pa"), ("component", "ca"), ("odd", "oa"))])
    right = rows.select("shingle", *[F.col(c).alias(x) for c, x in (("node", "b"), ("n", "nb"), ("place", "pb"), ("component", "cb"), ("odd", "ob"))])
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    enough = (100 + SIMILAR) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= SIMILAR * (F.col("na") + F.col("nb"))
    first = left.where((100 + SIMILAR) * (F.col("na") - F.col("pa")) >= 2 * SIMILAR * F.col("na")).withColumnRenamed("shingle", "same")
    test = (F.col("same") == F.col("shingle")) & (F.col("ca") != F.col("cb")) & ordered & enough & may_link("na", "nb", "oa", "ob")
    return first.join(right, test).select("a", "b").distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node and component_id of every document.

    Documents link if their sets of distinct 5-word shingles have a Jaccard similarity of
    0.8 or more; with fewer words the whole sequence is one shingle. component_id is the
    smallest doc_id that links reach. Sets are held as 64-bit hashes of shingles.

    Documents of equal sets are one node. Links to hubs come first and join the bulk of a
    large group in as many pairs as it has nodes; after that only pairs of different
    components are looked at, so a group is never expanded into all its pairs, while
    any link between components is found.

    A missing or empty text, or one of white space, has no shingles and links with
    nothing. A missing doc_id counts for no component's smallest; rows with the same id
    and different texts are different nodes; repeated rows have a row each. An empty
    table gives no rows. Further columns are not read.
    """
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")
    texts = in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).withColumn("row_key", F.unhex(F.md5(row)))
    whole = keep(prefixes(texts, frequency_sketch(texts)), "prefixes")
    nodes = whole.where("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("odd").alias("odd"), F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key")
    )
    unique = keep(nodes, "nodes")
    shared = shared_rows(whole)
    found = keep(whole.select("doc_id", "n", "node"), "found")
    free(whole)
    rows = unique.join(shared.select("node").distinct(), "node").select("node", "row_key")
    # a row may be repeated in the documents; its repeats are in one place after the join
    chosen = keep(texts.join(rows, "row_key").dropDuplicates(["row_key"]).select("node", "text"), "texts")
    open_rows, links, tested = shared.withColumn("component", F.col("node")), None, None
    for turn in range(HUB_ROUNDS + 1):
        last = turn == HUB_ROUNDS
        pairs = cross_pairs(open_rows, unique) if last else star_round(open_rows, unique, turn)
        likely = keep(untested(pairs, tested), "likely")
        new = keep(links_of(likely, chosen), "links")
        links = new if links is None else links.unionByName(new)
        tested = likely if tested is None else tested.unionByName(likely)
        if turn:
            free(open_rows)
        if not last:
            open_rows = keep(with_component(shared, components(links)), "open")
    free(chosen, shared)
    labels = components(links)
    named = keep(unique.join(labels, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    return (
        found.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "node")
        .join(of_node, "node", "left")
        .select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without all but one row of each component, all columns kept.

    The row with the smallest doc_id stays, whatever number of rows has that id: rows
    are told apart by numbers of their own, so a row goes for its own text and never
    for that of another row of its id. Of repeated rows one stays; a row without an id
    stays if its component has no row with one. Rows without shingles, as those with a
    missing or empty text, all stay. Columns may have any names. An empty table gives
    no rows.
    """
    row, number = free_name(docs, "row"), F.col("doc_id")
    # written, so that each row has the same number wherever it is read
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_components(numbered.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0").select(number.alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    members = keep(found.join(ids, "row"), "members")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("component_id", F.col("first.row").alias("stays"))
    gone = keep(members.join(stays, "component_id").where("row <> stays").select(F.col("row").alias(row)), "copies")
    return numbered.join(gone, row, "left_anti").drop(row).select(*[f"`{c}`" for c in docs.columns])
