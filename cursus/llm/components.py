"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node connected with it) for every node of the edges (a, b).

    Each round links every node's larger neighbours to its least neighbour,
    then every node and its smaller neighbours to the least of them, by a
    minimum and an equi join; no neighbourhood is gathered in a group. The
    number of rounds grows with the logarithm of the longest path. A table
    without edges gives none.
    """
    now = cut(_directed(edges))
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = cut(_small_star(_large_star(now)))
    # now a star: (node, component)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return (edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(moved.select("a", F.col("m").alias("b"))).where("a != b").distinct())
