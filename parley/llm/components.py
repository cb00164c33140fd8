"""Connected components by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node of an edge (a, b); root is the smallest node reachable.

    Null nodes are no nodes, loops and repeated edges change nothing, no edges give no rows. A hub's
    neighbours are never gathered: a round takes minima, which combine before the shuffle, and joins
    them back, which Spark may split.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    nodes = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    now = stage(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["c"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        small = large.join(low, large["a"] == low["c"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("c", "m"))
        now = stage(small.where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
