"""Connected components of a link table by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, spread_join


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points at one node, and no node that is pointed at points on."""
    if not edges.groupBy("v").count().where("count > 1").isEmpty():
        return False
    return edges.select("v").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the smallest node that it reaches.

    Each round points larger neighbours (large star), then smaller ones (small star), at the
    smallest; rounds grow with the logarithm of the nodes and end when only stars are left. Links of a
    node to itself, repeats and nulls change nothing. A node with very many neighbours finds its
    smallest by broadcast, so that its links stay where they are.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "links")
    while not _is_stars(edges):
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low, "v", "n", 2 * edges.count(), F.col("u")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "v", "n", large.count(), F.col("u")).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        small = materialize(small.select(F.col("x.u").alias("v"), F.col("x.m").alias("u")).where("v <> u").distinct(), "small-star")
        drop_materialized(large)
        drop_materialized(edges)
        edges = small
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
