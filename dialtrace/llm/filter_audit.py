"""Audit of filters that act on the same documents: what each removes in every order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialtrace.llm.common import SPACE, long_sum, whole_text

#: The filters in their first order; a filter's bit is its place here.
FILTERS = "ABCDE"
#: The bit of the filter that looks at other documents.
COPY = 1 << FILTERS.index("E")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "#$%&*|"


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone."""
    n = F.size(words)
    signs = F.lit(False)
    for sign in SIGNS:
        signs = signs | text.contains(sign)
    tests = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("bigint") > 3 * F.length(text),
        "D": signs,
    }
    bits = F.lit(0)
    for name, test in tests.items():
        bits = bits.bitwiseOR(F.when(test, 1 << FILTERS.index(name)).otherwise(0))
    return bits


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, bits of the filters A to D, and n of equal rows.

    Equal rows are put together in each task ahead of the shuffle.
    """
    cut = F.btrim(whole_text(), F.lit(" \t\n\x0b\x0c\r"))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        whole_text().alias("text"),
        F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, f"[{SPACE}]+")).alias("words"),
    )
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text"), F.col("words")).alias("bits"))
    return rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: how many documents of a part fail exactly these filters.

    Copies of a text are not brought together: they are summed by text, part and label
    in each task, with the smallest id and how many rows have it, and only these sums
    meet by text. All but the rows of the smallest id of all fail the filter of copies.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = measured(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    known = F.col("doc_id").isNotNull()
    sums = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first")
    )
    # a text has a row for each part and label at most
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    copies = F.col("known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = sums.withColumn("least", least).withColumn("copies", F.coalesce(copies, F.lit(0)))
    both = F.array(
        F.struct(F.col("bits").alias("bits"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct(F.col("bits").bitwiseOR(COPY).alias("bits"), F.col("copies").alias("n")),
    )
    masks = split.select("part", "good", "toxic", F.explode(both).alias("m")).where("m.n > 0")
    return masks.groupBy("part", F.col("m.bits").alias("bits")).agg(
        long_sum(F.col("m.n")).alias("n"), long_sum(F.col("m.n") * F.col("good")).alias("good"), long_sum(F.col("m.n") * F.col("toxic")).alias("toxic")
    )


class Weight(NamedTuple):
    """Documents, and how many of them are labelled good and toxic."""

    n: int
    good: int
    toxic: int

    def __add__(self, other: Weight) -> Weight:
        return Weight(self.n + other.n, self.good + other.good, self.toxic + other.toxic)


class Diagram:
    """An ordered decision diagram of failure masks, with counts for weights.

    A node is a number; it tests the filter of its level and has an edge for passing
    and one for failing. Equal nodes are one, so two branches that go on alike share
    what follows. Every path has all levels, and a node weighs what its edges weigh.
    """

    def __init__(self, order: str, weights: dict[int, Weight]):
        self.order = list(order)
        self.number: dict[tuple, int] = {}
        self.node: list[tuple] = []
        self.weight: list[Weight] = []
        self.root = self._build(0, 0, weights)

    def _add(self, key: tuple, weight: Weight) -> int:
        if key not in self.number:
            self.number[key] = len(self.node)
            self.node.append(key)
            self.weight.append(weight)
        return self.number[key]

    def leaf(self, weight: Weight) -> int:
        return self._add(("leaf", weight), weight)

    def branch(self, name: str, passed: int, failed: int) -> int:
        return self._add((name, passed, failed), self.weight[passed] + self.weight[failed])

    def _build(self, level: int, bits: int, weights: dict[int, Weight]) -> int:
        if level == len(self.order):
            return self.leaf(weights.get(bits, Weight(0, 0, 0)))
        name = self.order[level]
        passed = self._build(level + 1, bits, weights)
        return self.branch(name, passed, self._build(level + 1, bits | 1 << FILTERS.index(name), weights))

    def swap(self, level: int) -> None:
        """Exchanges the filters of a level and the next; what lies below stays as it is."""
        upper, lower = self.order[level : level + 2]
        self.order[level : level + 2] = [lower, upper]
        self.root = self._swapped(self.root, level, {})

    def _swapped(self, node: int, depth: int, done: dict[int, int]) -> int:
        if node not in done:
            name, passed, failed = self.node[node]
            if depth:
                done[node] = self.branch(name, self._swapped(passed, depth - 1, done), self._swapped(failed, depth - 1, done))
            else:
                (below, pp, pf), (_, fp, ff) = self.node[passed], self.node[failed]
                done[node] = self.branch(below, self.branch(name, pp, fp), self.branch(name, pf, ff))
        return done[node]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Along the path on which all pass: each filter, what passes it and what fails there."""
        at = self.root
        while self.node[at][0] != "leaf":
            name, passed, failed = self.node[at]
            yield name, self.weight[passed], self.weight[failed]
            at = passed

    def all_pass(self, node: int) -> Weight:
        while self.node[node][0] != "leaf":
            node = self.node[node][1]
        return self.weight[node]


def swaps(n: int) -> Iterator[int]:
    """Levels to swap one after another so that every order of n filters comes up once.

    The last filter goes all the way to one end and back, with one step of the others'
    orders in between.
    """
    if n < 2:
        return
    down = True
    for other in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if other is not None:
            yield other + down  # the last filter stands ahead of the others now, or behind
        down = not down


def audit_part(masks: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its at most 2 ** 5 counts."""
    weights = {int(m.bits): Weight(int(m.n), int(m.good), int(m.toxic)) for m in masks.itertuples(index=False)}
    diagram = Diagram(FILTERS, weights)
    every: dict[str, int] = {}
    only: dict[str, int] = {}
    rows: list[tuple] = []
    total = dict.fromkeys(FILTERS, 0)

    def take() -> None:
        first = next(diagram.steps())[0]
        if first not in every:  # a filter that comes first removes all that fail it
            _, _, failed = diagram.node[diagram.root]
            every[first], only[first] = diagram.weight[failed].n, diagram.all_pass(failed).n
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            rows.append(("".join(diagram.order), step, name, kept.n, removed.n, removed.good, removed.toxic))
            total[name] += removed.n

    take()
    for level in swaps(len(FILTERS)):
        diagram.swap(level)
        take()
    out = pd.DataFrame(rows, columns=["filter_order", "step", "name", "kept", "removed", "good_lost", "toxic_lost"])
    out.insert(0, "part", masks["part"].iloc[0])
    out["redundant"] = out["name"].map(every) - out["removed"]
    out["unique_fails"] = out["name"].map(only)
    out["shapley"] = out["name"].map(total)
    return out[COLUMNS].astype({"step": "int32"})


RESULT = (
    "part STRING, filter_order STRING, step INT, kept BIGINT, removed BIGINT, redundant BIGINT, unique_fails BIGINT, good_lost BIGINT, toxic_lost BIGINT, shapley BIGINT"
)
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    kept is left after the step and removed goes there; redundant fails the step's
    filter but went earlier; unique_fails fails this filter only; good_lost and
    toxic_lost are the removed documents with these labels; shapley is what the filter
    removes, summed over all orders.

    Spark counts the documents of a part by which filters they fail, at most 32 counts
    a part. Each part's counts make a decision diagram, which goes through all orders
    by swaps of neighbouring levels; the path on which all filters pass gives the steps.

    A missing text is empty and a missing language is the part of the empty text. A row
    without an id has no label, fails no filter for its copies, and makes none fail;
    nor does a row of the same id. Repeated labels count as good, or toxic, if any of
    them is. Repeated rows count each. An empty table gives no rows. Further columns are
    not read.
    """
    return mask_counts(docs, labels).groupBy("part").applyInPandas(audit_part, RESULT)
