"""Connected components by alternating star contraction, with no group ever gathered.

Each round is two aggregations (least neighbour per node, partial before the
shuffle) and joins of edges with their least neighbour, whose hot keys adaptive
execution can split. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node of a neighbourhood: larger ones (large) or the others and the node (small)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        near = both.where("v > u").join(least, "u")
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    near = both.join(least, "u")
    return (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots; a root is its component's least node.

    Only the last round's table stays in the scratch folder.
    """
    now = scratch.keep(edges.where("u <> v").distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        step += 1
        after = scratch.keep(_star(_star(now, True), False), f"{name}-{step}")
        # stable once every node has one root above it and no root lies below another node
        got = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(f"{name}-{step - 1}")
        if mark == (got.n, got.s):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, now = (got.n, got.s), after
