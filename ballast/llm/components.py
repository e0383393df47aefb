"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m"), F.col("a"))
    return moved.union(least.select("m", "b")).toDF("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) of every node that a link (a, b) names; no links give no rows.

    Both steps keep components whole; once neither changes an edge, each component is a star around its least node. Only
    two numbers a round reach the driver.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        total = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(total) == mark or not total.n:
            break
        mark = tuple(total)
        edges = stored(small_star(large_star(edges)))
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
