"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import written


def large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of these; every edge has its larger end first."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node with an edge to another: the smallest node it is connected to.

    `edges` has the columns a and b of one ordered type. Null ends, loops and repeated edges count for nothing; an
    empty table gives an empty one. A node with a great many edges is pre-aggregated; joins on it are left to AQE.
    Every round is written to the shared folder, so no round depends on what an executor held. The number of rounds is
    at most logarithmic squared in the number of nodes.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept, before = written(kept, name), None
    while True:
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        kept = written(small_star(large_star(kept)), name)
