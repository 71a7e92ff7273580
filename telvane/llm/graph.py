"""Connected components by contraction, with nothing gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telvane.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(node, label): label is the smallest node of its component. ``edges``: columns a and b, of long; no nulls.

    ``most``: rows that ``edges`` can have at most, if that is known.

    Each round hangs every node below its smallest neighbour, follows two such steps, and replaces the edges' ends by
    what they hang below; edges inside a tree vanish. Rounds grow with the logarithm of a component's diameter. All
    steps are grouped minima (pre-aggregated before the shuffle) and equi-joins, which adaptive execution splits where
    one node has many edges.
    """
    edges = scratch.settle(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", most=most)
    labels, nodes = None, 0
    while (n := edges.count()) > 0:
        nodes = nodes or 2 * n
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        below = scratch.settle(below, "below", most=2 * n)
        up = below.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tree = scratch.settle(below.join(up, "up").select("node", F.col("top").alias("label")), "tree", most=2 * n)
        scratch.drop(below)
        a = tree.select(F.col("node").alias("a"), F.col("label").alias("x"))
        b = tree.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = edges.join(a, "a").join(b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = scratch.settle(left, "edges", most=n)
        scratch.drop(edges)
        edges = after
        if labels is None:
            labels = tree
        else:
            step = tree.select(F.col("node").alias("label"), F.col("label").alias("to"))
            joined = scratch.settle(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", most=nodes)
            scratch.drop(labels, tree)
            labels = joined
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
