"""Connected components by contraction: every round hooks each node to its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of its component.

    ``edges``: two bigint columns a and b, any order, repeats and loops allowed. A round maps each
    node to the least of itself and its neighbours, shortens chains by jumping, and contracts the
    edges, so their number shrinks until none is left. Nothing is collected.
    """
    pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parent = parent.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        parent = stored(parent, "parents")
        to = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = stored(parent if labels is None else labels.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("y"))
        pairs = stored(pairs.join(left, "a").join(right, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
