"""Near-duplicate documents by HyperMinHash sketches, with every link confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.llm import ngram_join
from dialtrace.llm.common import keep_nothing, small_batches, whole_text
from dialtrace.llm.components import components
from dialtrace.llm.ngram_join import mix, shingle_sets, untested
from dialtrace.session import keep

#: Words of a shingle, and the similarity from which documents link, in hundredths.
WORDS = 4
SIMILAR = 80
#: Registers of a sketch and of a band. Two sets of similarity 0.8 agree in no whole band
#: with a probability of (1 - 0.8 ** 4) ** 32, which is 5 in 100,000,000.
BUCKETS = 128
ROWS = 4
BANDS = BUCKETS // ROWS
#: Bits of the bucket's number, and of the mantissa behind the leading zeros.
BUCKET_BITS = 7
MANTISSA = 10
#: Two different smallest values give one register about this often, times 2 ** -MANTISSA, in
#: sets of equal size (fixed value: the constant of the published estimator).
COLLIDES = 0.169919487159739
#: Sets of fewer shingles link only if they are equal.
LEAST = 4
#: Standard deviations that an estimate may fall short and its pair still be compared, and
#: what it may fall short besides.
MARGIN = 4.0
TOLERANCE = 0.01
#: Values of the four bits of a register that a first estimate looks at; 0 is an empty bucket.
NIBBLE = 15
#: What a copied register is moved by for each empty bucket that it has jumped.
JUMP = 40503
#: Rounds of links to hubs at most, before the pairs of what is still apart are made.
HUB_ROUNDS = 6


def registers(one: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of 64-bit hashes: bucket and register of each bucket in use.

    The first bits of a hash are its bucket. Of a bucket's smallest hash the register
    holds the number of leading zeros behind those bits, counted from 1, and the
    MANTISSA bits behind the first one.
    """
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    first = np.searchsorted(one, edges)
    used = np.flatnonzero(first < np.append(first[1:], len(one)))
    value = (one[first[used]] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, which a float holds
    part, exponent = np.frexp(value.astype(np.float64))
    mantissa = np.where(value > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return (used << 16 | (54 - exponent) << MANTISSA | mantissa).astype(np.int32)


def marks(sketch: np.ndarray) -> np.ndarray:
    """Ten words of 64 bits: four bits of each register, and which buckets are in use."""
    held = np.zeros(BUCKETS, dtype=np.uint8)
    held[sketch >> 16] = (sketch & 0xFFFF) % NIBBLE + 1
    used = np.packbits(held > 0, bitorder="little")
    return np.concatenate([held[::2] | held[1::2] << 4, used]).view("<i8")


def dense(sketches: list[np.ndarray]) -> np.ndarray:
    """All registers of each sketch; an empty bucket takes the next one in use, moved by the distance.

    So bands of small sets agree as often as the sets do.
    """
    size = list(map(len, sketches))
    flat = np.concatenate(sketches).astype(np.int64)
    held = np.zeros((len(sketches), BUCKETS), dtype=np.int64)
    held[np.repeat(np.arange(len(sketches)), size), flat >> 16] = flat & 0xFFFF
    bucket = np.arange(2 * BUCKETS)
    twice = np.where(np.tile(held, 2) > 0, bucket, 2 * BUCKETS)
    source = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS]
    moved = np.take_along_axis(held, source % BUCKETS, axis=1) + JUMP * (source - bucket[:BUCKETS])
    return (moved & 0xFFFF).astype("<u2")


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id, row_key, n, set_key, sketch, its marks and the odd parts of every document; an empty set has an empty sketch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        for batch in batches:
            n, key, sketch, mark, odd = [], [], [], [], []
            for one in shingle_sets(batch["text"].tolist(), WORDS):
                n.append(len(one))
                key.append(xxhash.xxh3_128_digest(one.tobytes()) if len(one) else None)
                sketch.append(registers(one))
                mark.append(marks(sketch[-1]))
                odd.append(ngram_join.odd_parts(one))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "row_key": batch["row_key"], "n": n, "set_key": key, "sketch": sketch, "marks": mark, "odd": odd,
            })

    return texts.mapInPandas(work, "doc_id BIGINT, row_key BINARY, n INT, set_key BINARY, sketch ARRAY<INT>, marks ARRAY<BIGINT>, odd ARRAY<BIGINT>")


def bands(nodes: DataFrame) -> DataFrame:
    """key, node, n: a row for each band of each node's sketch."""
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                key = mix(dense(batch["sketch"].tolist()).view("<u8") ^ band).reshape(-1).view(np.int64)
                yield pd.DataFrame({"key": key, "node": np.repeat(batch["node"].to_numpy(), BANDS), "n": np.repeat(batch["n"].to_numpy(), BANDS)})

    return nodes.where(F.col("n") >= LEAST).select("node", "n", "sketch").mapInPandas(work, "key BIGINT, node BIGINT, n INT")


def lengths_agree(a: str, b: str) -> Column:
    """Length filter: the smaller set has the needed share of the larger one."""
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def allows(differ: Column, used: Column) -> Column:
    """Whether a link is likely enough if ``differ`` of the ``used`` buckets of na and nb shingles differ.

    The deviation of the estimate follows from how many of the shingles of both the
    buckets show: all of them, in small sets.
    """
    share = SIMILAR / 100
    every = (F.col("na") + F.col("nb")) / (1 + share)  # shingles of both, if they are as similar as a link needs
    deviation = F.sqrt(share * (1 - share) / used * F.greatest(F.lit(0.0), 1 - used / every))
    return differ / used <= 1 - share + MARGIN * deviation + TOLERANCE


def may_link() -> Column:
    """The estimate from all registers, corrected by those that different values share by chance."""
    na, nb = F.col("na"), F.col("nb")
    equal = F.size(F.array_intersect("sa", "sb"))
    bucket = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    used = F.size(F.array_union(bucket("sa"), bucket("sb")))
    by_chance = COLLIDES * 2.0**-MANTISSA * 4 * na * nb / ((na + nb) * (na + nb))
    return allows(used - equal + by_chance * used, used)


def marks_agree() -> Column:
    """A first estimate by the words ma0 .. mb9, in a few operations on whole words.

    Four bits of two different registers may agree, so no more differ than do, and
    the later estimate from whole registers is the one that is corrected.
    """
    differ = used = None
    for k in range(8):
        x = F.col(f"ma{k}").bitwiseXOR(F.col(f"mb{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        count = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
        differ = count if differ is None else differ + count
    for k in (8, 9):
        count = F.bit_count(F.col(f"ma{k}").bitwiseOR(F.col(f"mb{k}")))
        used = count if used is None else used + count
    return allows(differ, used)


def side(rows: DataFrame, x: str, *more: Column | str) -> DataFrame:
    """The node as ``x``, and what ``first_estimate`` reads of it."""
    named = [F.col(c).alias(f"{y}{x}") for c, y in (("node", ""), ("n", "n"), ("odd", "o"))]
    return rows.select(*named, *[F.col("marks")[k].alias(f"m{x}{k}") for k in range(10)], *more)


def first_estimate() -> Column:
    """Whether a and b agree in length, marks and odd parts."""
    return lengths_agree("na", "nb") & marks_agree() & ngram_join.may_link("na", "nb", "oa", "ob")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that agree in length and odd parts and may link."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in ("n", "sketch", "odd")])
    may = lengths_agree("na", "nb") & ngram_join.may_link("na", "nb", "oa", "ob") & may_link()
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b")


def links_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link by the whole sets of their texts."""
    return ngram_join.links_of(pairs, texts, WORDS)


def still_open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The band rows with their node's component and its size, of bands in which several components meet."""
    labels = components(links)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = shared.join(labels.join(sizes, "component"), "node", "left").withColumns({"component": F.coalesce("component", "node"), "size": F.coalesce("size", F.lit(1))})
    several = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    return keep(named.join(several, "key"), "open")


def finer(rows: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """The band rows, each under its band and the marks of four more registers, others in each turn.

    Many texts that are not alike may share a frequent passage and its bands. Of those
    that share more registers, most are alike, so the hubs among them are the right ones.
    """
    more = F.shiftright(F.get("marks", F.pmod("key", F.lit(8)).cast("int")), 16 * (turn % 4)).bitwiseAND(F.lit(0xFFFF))
    marked = rows.join(nodes.select("node", "marks"), "node").select(F.xxhash64("key", more).alias("key"), "node", "n", "component", "size")
    return keep(marked, "finer")


def to_hubs(rows: DataFrame, nodes: DataFrame, turn: int, tested: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of each node and the hub of another component that most of its bands name, of hubs that may link.

    A band names a node of its largest component and one of any, others in each turn:
    one pair for each node, however many nodes a band has. So what links to a large group
    is compared with it, and not with the many that only share a band.
    """
    dealt = F.xxhash64(F.lit(turn), "node")
    largest = F.struct("size", "component", dealt.alias("dealt"), "node", "n")
    of_any = F.struct("size", "component", dealt.alias("dealt"), "node", "n")
    # at first every node is a component of its own, and one hub is enough
    hubs = rows.groupBy("key").agg(F.array(F.max(largest), F.min_by(of_any, dealt)) if turn else F.array(F.min(largest)))
    named = hubs.select("key", F.explode(hubs.columns[1]).alias("hub"))
    met = rows.join(named, "key").where((F.col("component") != F.col("hub.component")) & lengths_agree("n", "hub.n"))
    counted = met.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("bands"))
    if turn:
        # a band of a frequent passage names hubs that are not alike, so these go before the choice
        counted = untested(counted, tested).join(side(nodes, "a"), "a").join(side(nodes, "b"), "b").where(first_estimate())
    return counted.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def cross_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs (a, b) that share a band, are of different components and may link.

    The filters are the join's condition: of texts that share a frequent passage, and so
    many bands, but are not alike, no pairs are made. The sketches leave those that fall
    a little short; of a group of such texts they would leave all pairs, so the odd
    parts, which bound the sets themselves, come with the first estimate.
    """
    rows = keep(rows.select("key", "node", "component").join(nodes.select("node", "n", "odd", "marks"), "node"), "cross")
    left, right = side(rows, "a", "key", F.col("component").alias("ca")), side(rows, "b", F.col("key").alias("same"), F.col("component").alias("cb"))
    test = (F.col("key") == F.col("same")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    return left.join(right, test & first_estimate()).select("a", "b").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents link if their sets of distinct 4-word shingles have a Jaccard similarity of
    0.8 or more; with fewer words the whole sequence is one shingle. component_id is the
    smallest doc_id that links reach, and the document of that id is kept.

    Documents of equal sets are one node. A node's sketch has 128 registers of 16 bits;
    nodes that agree in a band of 4 registers are candidates, and go on if the estimate
    from all registers allows a link; then their whole texts are compared, each pair
    once. Each node is first compared with the hub that most of its bands name, which
    joins a large group in as many pairs as it has nodes; from the second round on, hubs
    are named by finer bands and must pass the first estimate. After a few such rounds all
    pairs that share a band and are still apart are compared. Pairs whose sets differ in
    too many odd parts to link (see ``ngram_join.may_link``) are not compared. A link can
    only be missed if no band of the two sketches agrees (see ROWS) or the estimate is
    off by MARGIN standard deviations, and then only if no other links join the two.

    A missing or empty text, or one of white space, has no shingles, links with nothing
    and is kept. Rows without an id take the smallest id of their component, or none,
    and are kept if there is none. Rows of one id and different texts are nodes of their
    own; repeated rows have a row each. An empty table gives no rows. Further columns are
    not read.
    """
    with small_batches(docs.sparkSession):
        row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).withColumn("row_key", F.unhex(F.md5(row)))
        found = keep(sketches(texts), "sketches")
        sets = found.where("n > 0").groupBy("set_key").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"), F.first("odd").alias("odd"),
            F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"),
        )
        nodes = keep(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
        several = bands(nodes).groupBy("key").agg(F.min("node").alias("one"), F.max("node").alias("other")).where("one <> other").select("key")
        shared = keep(bands(nodes).join(several, "key"), "shared")
        rows = nodes.join(shared.select("node").distinct(), "node").select("node", "row_key")
        # a row may be repeated in the documents; its repeats are in one place after the join
        chosen = keep(texts.join(rows, "row_key").dropDuplicates(["row_key"]).select("node", "text"), "texts")

        open_rows, links, tested = shared.withColumns({"component": F.col("node"), "size": F.lit(1).cast("bigint")}), None, None
        for turn in range(HUB_ROUNDS + 1):
            # after a round without a new link come all pairs
            last = turn == HUB_ROUNDS or (turn > 1 and new.isEmpty())
            if last:
                pairs = estimated(cross_pairs(open_rows, nodes), nodes)
            else:
                # two nodes that chose each other are one pair
                named = to_hubs(finer(open_rows, nodes, turn) if turn else open_rows, nodes, turn, tested).withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
                pairs = estimated(named.dropDuplicates(["low", "high"]), nodes)
            likely = keep(untested(pairs, tested), "likely")
            new = keep(links_of(likely, chosen), "links")
            links = new if links is None else links.unionByName(new)
            tested = likely if tested is None else tested.unionByName(likely)
            if last:
                break
            open_rows = still_open(shared, links)
        labels = components(links)
    named = nodes.join(labels, "node", "left").select("set_key", "least_id", F.coalesce("component", "node").alias("component"))
    named = keep(named, "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(least, "component").select("set_key", "component_id")
    # a set that has most of all documents is split by the planner, as the other side has one row for it
    every = found.select("doc_id", "n", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return every.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
