"""Connected components of links, worked out as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybridge.llm.common import discard, stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node at most, and none of these points on."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where(
        "out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b); a component is named by its smallest node.

    Links are turned into stars around ever smaller nodes: first a node's larger neighbours are tied to its
    least neighbour, then the node and its smaller ones. Each turn is written to the shared folder. Only
    stars are left after a number of turns that grows with the logarithm of the longest chain; links that are stars need none.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every link now points from a node to a smaller one; a repeated one does no harm
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(small)
        discard(edges)
        edges = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
