"""Connected parts of a graph of links, all of it in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node of its part.

    Alternating large-star and small-star steps: each step links a node's neighbours to the
    smallest one in sight. Minima are combined before the shuffle and joined back as a table with
    one row per node, so a node with very many links is split by adaptive execution like any other
    skewed join. Every step is a written table. Empty input gives no rows; loops are ignored.
    """
    now = ws.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), f"{name}_0")
    step = 0
    while not _stars(now):
        step += 1
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, F.col("a") == F.col("u")).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = ws.put(large, f"{name}_{step}_large")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(least, F.col("a") == F.col("u"))
        small = met.select("a", F.col("m").alias("b")).union(
            met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = ws.put(small, f"{name}_{step}")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(now.select("b", "b").distinct()))


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has exactly one link, to a root."""
    roots = edges.select(F.col("b").alias("r")).distinct()
    marked = edges.select("a", F.lit(1).alias("n")).union(
        edges.join(roots, F.col("a") == F.col("r"), "left_semi").select("a", F.lit(2)))
    return marked.groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty()
