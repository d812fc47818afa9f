"""Connected components of a distributed list of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are linked to the smallest of them. Links have v < u."""
    least = links.groupBy("u").agg(F.min("v").alias("_m"))
    joined = links.join(least, "u")
    moved = joined.filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(least.select("u", F.col("_m").alias("v"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component for every node with a link, where component is the smallest node that it reaches.

    Each round's links are written to the shared scratch folder; rounds grow
    with the logarithm of the nodes.
    """
    now = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _is_flat(now):
        now = stored(_small_star(_large_star(now)), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_flat(links: DataFrame) -> bool:
    """Whether every node is linked to one smaller node, which is linked to no smaller one."""
    again = links.groupBy("u").agg(F.count("*").alias("_n")).filter("_n > 1").select("u")
    return again.isEmpty() and links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
