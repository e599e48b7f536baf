"""Connected components by alternating large-star and small-star rounds.

Each round is joins and grouped minima over narrow edges; no node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import cut_lineage, dispose


def least_neighbour(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node that has a smaller one."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))


def large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    return edges.join(least, F.col("v") == F.col("node"), "left").select("u", F.coalesce("least", "v").alias("v")).distinct()


def small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    moved = edges.join(least, F.col("u") == F.col("node")).where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select(F.col("node").alias("u"), F.col("least").alias("v"))).distinct()


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its smallest node.

    Null ends and links of a node to itself are left out. The result is a table in the shared folder.
    """
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut_lineage(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = digest(edges)
    while True:
        least = cut_lineage(least_neighbour(edges))
        large = cut_lineage(large_star(edges, least))
        dispose(edges, least)
        least = cut_lineage(least_neighbour(large))
        edges = cut_lineage(small_star(large, least))
        dispose(large, least)
        now = digest(edges)
        if now == seen:  # neither star moves an edge: every component is a star
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
