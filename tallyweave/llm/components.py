"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): least node that can be reached over ``links`` (a, b), for linked nodes.

    Each round takes the least label among a node's neighbours and then that label's own label,
    so paths halve; labels only shrink, and the loop ends when none does, whatever the number of
    rounds. Every round is written.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node"))
                     .agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["node"])
                .groupBy("a").agg(F.min("label").alias("near")))
        lower = (labels.join(near, labels["node"] == near["a"])
                 .select("node", F.least("label", "near").alias("lower"), "label"))
        target = labels.select(F.col("node").alias("lower"), F.col("label").alias("next"))
        step = written(lower.join(target, "lower")
                       .select("node", F.least("lower", "next").alias("new"), "label"), "labels")
        moved = step.where("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
