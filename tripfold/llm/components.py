"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, label` for every node of `edges` (`a`, `b`, both long): one label per component.

    Each round every node joins the neighbour, or itself, that comes first in an order drawn anew
    for the round, and edges are rewritten between the joined nodes. A random order shrinks paths
    as well as stars by a constant factor, so rounds grow with the logarithm of the nodes. All
    grouping is by `min`, combined before the shuffle; joins read checkpointed rows on both sides,
    so that adaptive execution can split a hot node. No edges give no rows; self loops and
    repeated edges are harmless, edges with a NULL end are left out.
    """
    ends = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    open_edges = checkpoint(ends.distinct())
    labels: DataFrame | None = None
    turn = 0
    while labels is None or not open_edges.isEmpty():

        def ranked(node: Column, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), node.alias("node"))

        both = open_edges.unionByName(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(ranked(F.col("b")))
        joined = checkpoint(
            both.groupBy("a")
            .agg(first.alias("first"))
            .select(
                F.col("a").alias("node"),
                F.least(F.col("first"), ranked(F.col("a")))["node"].alias("to"),
            )
        )
        left = joined.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = joined.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = open_edges.join(left, "a").join(right, "b").where("to_a <> to_b")
        open_edges = checkpoint(
            moved.select(
                F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
            ).distinct()
        )
        step = joined.select(F.col("node").alias("label"), "to")
        labels = (
            joined.select("node", F.col("to").alias("label"))
            if labels is None
            else checkpoint(
                labels.join(step, "label", "left").select(
                    "node", F.coalesce("to", "label").alias("label")
                )
            )
        )
        turn += 1
    return labels
