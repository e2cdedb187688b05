"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node on an edge (a, b); comp is the least node reachable.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones, on the least
    neighbour. The number of edges never grows; rounds go with the logarithm of the longest path, and
    edges that are stars already, as most links to pivots are, take none. Groups are never gathered:
    the least neighbour is an aggregate that is joined back.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        now = store(small, "edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge, to a node that has no smaller one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()
