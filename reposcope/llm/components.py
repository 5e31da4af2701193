"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each directed pair with the least of u's neighbours. A partial aggregate and a join, so a hub is no single task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable.

    ``edges`` has longs a and b. Alternating stars: every node sends its
    larger neighbours to the least of all its neighbours, then every node its
    smaller ones, until the edges are stars around the least nodes; that takes
    a number of rounds logarithmic in the longest path. Every round is written
    to shared storage. Nodes without an edge to another are not returned.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    last = None
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_least(both).withColumn("m", F.least("m", "u")).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _with_least(large)
        small = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        e = saved(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
