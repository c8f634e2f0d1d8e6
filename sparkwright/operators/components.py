"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of ``edges(a, b)`` reaches; nodes without edges are not listed.

    Each round hangs every node's larger neighbours on its least neighbour, and its
    smaller ones likewise, until nothing changes: aggregations with map-side combine
    and equi-joins, written to the shared folder round by round.  The number of rounds
    grows with the logarithm of the longest chain.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    before = None
    for k in range(1, most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        smaller = now.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.keep(larger.unionByName(smaller).unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct(), str(k))
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(str(k - 1))
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(leaves.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return leaves.unionByName(roots)
