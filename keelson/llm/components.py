"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _min_of(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("n")).agg(F.min(other).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _min_of(both, "a", "b").select("n", F.least("n", "m").alias("m"))
    least = materialize(least, "star")
    larger = both.where("b > a")
    return larger.join(least, larger.a == least.n).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have a < b."""
    least = materialize(_min_of(edges, "b", "a"), "star")
    joined = edges.join(least, edges.b == least.n)
    rest = joined.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return rest.union(least.select(F.col("m").alias("x"), F.col("n").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges(a < b, longs) the smallest node it reaches.

    Each round halves path lengths, so rounds grow with the logarithm of a component's diameter.
    State is a table in the shared folder after each step; joins are by node, and minima are
    aggregated before the shuffle, so that a node with very many links isn't gathered in one task.
    """
    edges = materialize(edges.select("a", "b").distinct(), "links")
    while True:
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not before[0]:
            break
        edges = materialize(_large_star(edges), "links")
        edges = materialize(_small_star(edges), "links")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == after:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
