"""Final report.

Three left joins on the entity key onto the scored year's base rows.  Each
side is checked for key uniqueness first (a duplicate key would fan out the
report); all sides are keyed tables of one row per entity, so Spark
co-partitions them on the key and AQE picks broadcast for small sides.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

# fixed value: the report's base columns
BASE_COLUMNS = ["nos", "nos_su", "rate_nos", "rate_nsrd", "rate_sd", "variation_rate_nos",
                "variation_rate_volume"]


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"{what}: key {list(keys)} is not unique")


def final_report(base: DataFrame, scores: DataFrame, anomalies: DataFrame, clusters: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """Base + SCORE + anomaly flag/score + cluster, one row per entity."""
    keys = list(keys)
    sides = [(scores.select(*keys, "SCORE"), "score"),
             (anomalies.select(*keys, "anomaly", "anomaly_score"), "anomaly"),
             (clusters.select(*keys, "cluster"), "cluster")]
    out = base.select(*keys, *BASE_COLUMNS)
    for side, name in sides:
        assert_unique(side, keys, name)
        out = out.join(side, keys, "left")
    return out


def coverage(report: DataFrame) -> DataFrame:
    """Missing count / % per joined output, anomaly rate, cluster shares."""
    n = F.count(F.lit(1))
    agg = report.agg(
        n.alias("rows"),
        F.count(F.when(F.col("SCORE").isNull(), 1)).alias("missing_score"),
        F.count(F.when(F.col("anomaly").isNull(), 1)).alias("missing_anomaly"),
        F.count(F.when(F.col("cluster").isNull(), 1)).alias("missing_cluster"),
        F.count(F.when(F.col("anomaly"), 1)).alias("anomalies"),
        F.count("anomaly").alias("anomaly_known"))
    summary = agg.select(
        F.lit("summary").alias("kind"), F.lit(None).cast("long").alias("cluster"), "rows",
        "missing_score", X.ieee_div(F.col("missing_score") * F.lit(100.0), "rows").alias("missing_score_pct"),
        "missing_anomaly", X.ieee_div(F.col("missing_anomaly") * F.lit(100.0), "rows").alias("missing_anomaly_pct"),
        "missing_cluster", X.ieee_div(F.col("missing_cluster") * F.lit(100.0), "rows").alias("missing_cluster_pct"),
        X.ieee_div(F.col("anomalies") * F.lit(100.0), "anomaly_known").alias("anomaly_rate_pct"),
        F.lit(None).cast("double").alias("share_pct"))
    total = report.agg(n.alias("_n"))
    per = (report.groupBy("cluster").agg(n.alias("_c")).crossJoin(F.broadcast(total))
           .select(F.lit("cluster").alias("kind"), F.col("cluster").cast("long").alias("cluster"),
                   F.col("_c").alias("rows"),
                   *[F.lit(None).cast(t).alias(c) for c, t in (
                       ("missing_score", "long"), ("missing_score_pct", "double"), ("missing_anomaly", "long"),
                       ("missing_anomaly_pct", "double"), ("missing_cluster", "long"),
                       ("missing_cluster_pct", "double"), ("anomaly_rate_pct", "double"))],
                   X.ieee_div(F.col("_c") * F.lit(100.0), "_n").alias("share_pct")))
    return summary.unionByName(per)


def write_report(report: DataFrame, folder: str, run_date, fmt: str = "parquet") -> str:
    """The dated final report ('dd-mm-YYYY' in the folder name)."""
    path = f"{folder.rstrip('/')}/final_report_{run_date.strftime('%d-%m-%Y')}"
    w = report.write.mode("overwrite")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))
    return path
