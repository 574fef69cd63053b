"""Connected components by alternating stars, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.plans.scratch import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's least neighbour (or itself)."""
    pairs = _both(edges)
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to its least neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    moved = met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of links (a, b): the least node reachable.

    Links to itself are dropped.  Rounds grow with the logarithm of the largest
    component; each is one staged table, so a lost executor costs a round at most.
    """
    now = stage(edges.filter("a != b").select("a", "b").distinct(), "links")
    before = None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        now = stage(_small(_large(now)), "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = mark
