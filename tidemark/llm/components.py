"""Connected components of a graph of bounded degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settled


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the component's smallest node.

    Each round takes the smallest label among a node and its neighbours and then that label's own label (pointer
    jumping), so the number of rounds grows with the logarithm of a path's length in the usual case. Labels are
    written each round; nothing but a count comes to the driver. Raises if ``rounds`` don't do.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        mine = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # what a root itself is labelled by now
        step = mine.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        jumped = settled(mine.join(step, mine.root == step.r).select("node", "old", F.least("root", "rr").alias("root")))
        changed = jumped.filter(F.col("old") != F.col("root")).limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"labels still changed after {rounds} rounds")
