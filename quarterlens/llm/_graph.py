"""Connected components of an edge table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); root = smallest node reachable.

    Each round takes the smallest label around a node and then jumps to that
    label's own label, so a path of d edges needs about log d rounds.  Labels
    are written in every round; only a count comes to the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy("a").agg(F.min("root").alias("near")))
        stepped = (labels.join(near, F.col("node") == F.col("a"))
                   .select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        stepped = cut(stepped)
        jump = stepped.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = cut(stepped.join(jump, "root")
                     .select("node", F.col("further").alias("root"), (F.col("further") != F.col("old")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
