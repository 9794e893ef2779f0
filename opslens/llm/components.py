"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node (a) has one centre (b), itself no node."""
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("nodes")).first()
    return n["n"] == n["nodes"] and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) for every node of ``edges``
    (a, b) that is not its component's smallest.

    Alternating large and small stars: every node's larger neighbours, then its
    smaller ones, are tied to the smallest node around it, until only stars
    are left, however many rounds that takes (about the logarithm of the longest
    way). Minima are aggregated before they are joined back, so a node
    with very many neighbours is not gathered in one place.
    """
    pair = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # b: the smaller
    edges = cut(edges.where("a != b").select(pair.alias("e")).select("e.*").distinct())
    while not _are_stars(edges):
        # large star: larger neighbours of a node go to the smallest node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: the node
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a")
        edges = cut(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
