"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialtrace.session import free, keep


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that has a link.

    Each round takes the smallest label among a node and its neighbours, then the label
    of that label, so labels travel in growing steps. Labels are written after each
    round; links and labels stay distributed, and only the number of changes comes back.
    """
    edges = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        step = keep(lower, "step")
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("jumped"))
        new = keep(step.join(jump, F.col("low") == F.col("at"), "left").select("node", F.col("component").alias("old"), F.least("low", F.coalesce("jumped", "low")).alias("component")), "labels")
        free(step, labels)
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            free(edges)
            return labels
