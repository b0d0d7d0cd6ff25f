"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import cut


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of these neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    """Count and sums that tell two edge tables apart."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); root = smallest node reachable.

    A node's neighbours are never gathered: a round takes minima, with partial sums
    before the shuffle, and joins them back on the node, where Spark splits a frequent
    one.  Edges only ever move to smaller ends, so the rounds settle; each round's
    edges are written, and only a count and two sums come to the driver.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct())
    before = None
    while (now := _print(edges)) != before:
        before = now
        edges = cut(small_star(cut(large_star(edges))))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return cut(roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
