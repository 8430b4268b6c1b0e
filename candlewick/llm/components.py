"""Connected components of links by alternating large-star and small-star steps, all in DataFrames.

Each step is an aggregation of the neighbours' minimum and a join back to the links, so a hub with very many neighbours
is summed before it is shuffled and split where it is joined. Every step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm._shared import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _unfinished(links: DataFrame) -> bool:
    """Whether a node has several roots, or is a root and has one."""
    ends = links.selectExpr("a AS node", "1 AS links", "0 AS linked").unionByName(links.selectExpr("b AS node", "0 AS links", "1 AS linked"))
    return not ends.groupBy("node").agg(F.sum("links").alias("n"), F.max("linked").alias("r")).where("n > 1 OR n * r > 0").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """From links (a, b): node and root, the least node of its component, for every node but the roots."""
    current, k = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), 0
    while _unfinished(current):
        k += 1
        large = scratch.keep(_large_star(current), f"{name}-{k}-large")
        following = scratch.keep(_small_star(large), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large", f"{name}-{k - 1}")
        current = following
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
