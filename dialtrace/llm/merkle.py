"""Merkle manifest of a dataset: hashes that tie every document to one root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialtrace.session import keep

#: Levels that are built over one block of rows; a block has 2 ** LEVELS rows at most.
LEVELS = 11
#: The columns that make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A leaf is tampered with if this divides the checksum of its id.
TAMPER = 7

#: Forms of a step of a path, before the sibling's digest: where the sibling stands.
LEFT, RIGHT, ALONE = "L", "R", "-"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, put together."""
    return F.sha2(F.concat(*parts), 256)


def part(value: Column) -> Column:
    """A value with its length in bytes ahead, so that no two rows give the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    return digest(*[part((changed or {}).get(c, F.col(f"`{c}`"))) for c in FIELDS])


def with_places(nodes: DataFrame, order: list[Column], purpose: str) -> DataFrame:
    """The nodes with ``at``, their place in their tree from 0 on, and ``n``, the tree's nodes.

    Rows are dealt by ranges of the order and written; a place is the number of rows of
    the tree in the ranges before, and the row's number in its own range. So a tree with
    most of all rows is numbered by as many tasks as it has ranges.
    """
    dealt = keep(nodes.repartitionByRange(F.col("tree").asc_nulls_first(), *order).withColumn("range", F.spark_partition_id()), purpose)
    sizes = dealt.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("in_range"))
    # a row per tree and range; a range holds many rows, so these are few
    ahead = W.partitionBy("tree").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("tree").alias("_tree"), F.col("range").alias("_range"), F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("before"), F.sum("in_range").over(W.partitionBy("tree")).alias("n")
    )
    numbered = dealt.withColumn("number", F.row_number().over(W.partitionBy("tree", "range").orderBy(*order)))
    found = numbered.join(starts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("range") == F.col("_range")))
    return found.withColumn("at", F.col("before") + F.col("number") - 1).drop("_tree", "_range", "range", "number", "before")


def block_levels(nodes: DataFrame, levels: int, carried: tuple[str, ...]) -> DataFrame:
    """One row per node, with the carried columns, the path to its block's top, and the top itself in ``node_<levels>`` of the first row.

    On level k the first row of every 2 ** k rows holds a node. Its sibling is 2 ** k
    rows on, or back: lead and lag columns of these fixed offsets, masked by the node's
    slot in its run and by the run's length. The first child's row hashes the parent. On
    the way down each node adds its sibling to the path of its parent, which is on its
    own row or 2 ** k rows back. All windows have one partitioning and order, so
    they share one sort.
    """
    block = W.partitionBy("tree", "block").orderBy("at")
    rows = nodes.withColumn("block", F.shiftright("at", levels)).withColumnRenamed("hash", "node_0")
    for k in range(levels):
        step = 1 << k
        index = F.shiftright("at", k)
        size = F.shiftright(F.col("n") + F.lit(step - 1), k)  # nodes of the tree on this level
        here = F.col("at").bitwiseAND(step - 1) == 0
        first = index.bitwiseAND(1) == 0
        pair = index.bitwiseOR(1) < size
        rows = rows.withColumns({"_next": F.lead(f"node_{k}", step).over(block), "_last": F.lag(f"node_{k}", step).over(block)})
        sibling = F.when(pair, F.when(first, F.concat(F.lit(RIGHT), "_next")).otherwise(F.concat(F.lit(LEFT), "_last"))).otherwise(F.lit(ALONE))
        parent = F.when(size == 1, F.col(f"node_{k}")).when(pair, digest(F.col(f"node_{k}"), F.col("_next"))).otherwise(digest(F.col(f"node_{k}")))
        rows = rows.withColumns({f"step_{k}": F.when(here, F.when(size > 1, F.array(sibling)).otherwise(F.array().cast("array<string>"))), f"node_{k + 1}": F.when(here & first, parent)})
        rows = rows.drop("_next", "_last")
    path = F.col(f"step_{levels - 1}")
    rows = rows.withColumn("path", path)
    for k in reversed(range(levels - 1)):
        step = 1 << k
        rows = rows.withColumn("_up", F.lag("path", step).over(block))
        first = F.shiftright("at", k).bitwiseAND(1) == 0
        rows = rows.withColumn("path", F.when(F.col("at").bitwiseAND(step - 1) == 0, F.concat(f"step_{k}", F.when(first, F.col("path")).otherwise(F.col("_up"))))).drop("_up")
    return rows.select("tree", "block", "at", "n", F.col("node_0").alias("hash"), "path", F.col(f"node_{levels}").alias("top"), *carried)


def paths(nodes: DataFrame, levels: int = LEVELS, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(tree, hash, path) and the carried columns of every node, and (tree, root) of every tree.

    Blocks of 2 ** ``levels`` rows are built on their own; their tops are the nodes of
    the next round, until each tree is one block. A task holds blocks, never a tree.
    """
    done = keep(block_levels(nodes, levels, carried), "blocks")
    tops = done.where(F.col("top").isNotNull())
    if tops.where("block > 0").isEmpty():
        return done.select("tree", "hash", "path", *carried), tops.select("tree", F.col("top").alias("root"))
    heads = tops.select("tree", F.col("block").alias("at"), F.col("block").alias("of"), F.shiftright(F.col("n") + F.lit((1 << levels) - 1), levels).alias("n"), F.col("top").alias("hash"))
    upper, roots = paths(heads, levels, ("of",))
    above = upper.select(F.col("tree").alias("_tree"), F.col("of").alias("_block"), F.col("path").alias("_path"))
    whole = done.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return whole.select("tree", "hash", F.concat("path", "_path").alias("path"), *carried), roots


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""

    def up(node: Column, step: Column) -> Column:
        other = F.substr(step, F.lit(2))
        both = F.when(step.startswith(RIGHT), F.concat(node, other)).when(step.startswith(LEFT), F.concat(other, node)).otherwise(node)
        return F.sha2(both, 256)

    return F.aggregate(path, start, up)


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, put together from the leaf to the root."""
    siblings = F.transform(F.filter(path, lambda x: x != ALONE), lambda x: F.substr(x, F.lit(2)))
    return F.sha2(F.array_join(siblings, ""), 256)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    A leaf is the digest of a row's doc_id, source, lang, n_chars and text, each with its
    length ahead. The leaves of a language, by doc_id, are the lowest level of a tree in
    which every two nodes in a row, or a last one alone, make a node above. The tops of
    the languages, in order of language, make a tree in the same way, whose top is the
    root. proof_sha256 is the digest of the siblings from the leaf to the root.
    folded_root is worked out from the leaf and these siblings, where TAMPER divides
    the id's checksum from the leaf of the row with n_chars one higher; verified says
    whether it is the root.

    A missing doc_id stands before all others and is not tampered with, a missing n_chars
    stays missing; a missing language is a tree of its own, ahead of the empty one. Rows
    of one id and language stand in order of their leaves, so equal rows are leaves of
    their own. An empty text is not the same as a missing one. An empty table gives no
    rows. Further columns, whatever their names, are not read.
    """
    more = {"n_chars": F.col("n_chars") + 1}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("tree"), leaf().alias("hash"), F.when(hit, leaf(more)).alias("other"))
    # equal rows can stand in any order; the number only lets them fall into several ranges
    leaves = leaves.withColumn("row", F.monotonically_increasing_id())
    placed = with_places(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()], "leaves")
    lower, subroots = paths(placed, levels, ("doc_id", "other"))
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("hash"))
    upper, roots = paths(with_places(tops, [F.col("lang").asc_nulls_first()], "subroots"), levels, ("lang",))
    above = upper.join(roots, "tree").select("lang", F.col("path").alias("_path"), F.col("hash").alias("subroot"), "root")
    whole = lower.join(above, F.col("tree").eqNullSafe(F.col("lang")))
    path = F.concat("path", "_path")
    rows = whole.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", path.alias("path"), F.coalesce("other", "hash").alias("start"))
    found = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("start"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
