"""Connected components of links between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of links a, b.

    Each pass joins links with the smallest neighbour of their end and is written, so nothing
    is gathered and a lost executor costs a re-read. Passes grow with the logarithm of the
    longest chain. No links give an empty table.
    """
    edges = written(
        links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        .distinct(), "links")
    mark = None
    while True:
        edges = written(small_star(large_star(edges)), "stars")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        edges.select("low", "low").distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbours and itself."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(
        edges.select("low", "high"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(
        F.col("m").alias("low"), F.col("v").alias("high")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    joined = edges.join(least, "high")
    return joined.select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high")) \
        .where("low <> high").distinct()
