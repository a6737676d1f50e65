"""Exact deduplication with a split of the frequent digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import whole_text
from dialtrace.session import keep

#: Counters of a summary; also the bound of the rows that are broadcast.
COUNTERS = 512


def misra_gries(counters: int):
    """A function that sums up the digests of one task in at most ``counters`` counters.

    A digest's counter is at most its true count, and less by at most
    ``rows / (counters + 1)``.
    """

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in batch["digest"].value_counts().items():
                held[digest] = held.get(digest, 0) + int(n)
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pd.DataFrame({"digest": list(held), "n": list(held.values())})

    return summary


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """Digest, keep_id and group_size of the frequent digests, at most ``counters`` rows.

    The sum of a digest's counters over all tasks is a lower bound of its count, so at
    most ``counters`` digests have a sum above ``rows / (counters + 1)``, and every
    digest with more than twice that many rows is among them. One more pass over the
    digests verifies them with their exact counts.
    """
    least = digests.count() / (counters + 1)
    sums = digests.select("digest").mapInPandas(misra_gries(counters), "digest BINARY, n BIGINT")
    candidates = keep(sums.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(least)).select("digest"), "frequent")
    verified = digests.join(F.broadcast(candidates), "digest").groupBy("digest")
    winners = verified.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return keep(winners.where(F.col("group_size") > F.lit(least)), "winners")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A missing text counts as
    empty. A missing doc_id is smaller than any other; rows that repeat both id and
    text are one document and share ``kept``. An empty table gives no rows. Further
    columns are not read.
    """
    rows = docs.select(F.col("doc_id"), F.unhex(F.sha2(whole_text(), 256)).alias("digest"))
    digests = keep(rows, "digests")
    winners = F.broadcast(frequent(digests, counters))
    hot = digests.join(winners, "digest")
    rest = digests.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = hot.unionByName(rest.join(groups, "digest"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
