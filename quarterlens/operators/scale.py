"""Robust scaling and IQR rules.

Quantiles are exact (linear interpolation, as the reference's library) and
computed by the distributed helper; the fitted parameters are a table with
one row per feature, small by construction (bounded by the feature count)
and broadcast back onto the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ranking import quantiles_long, stack_columns

# fixed value: a scale below ten machine epsilons counts as zero (-> 1.0)
ZERO_SCALE = 10 * 2.220446049250313e-16


def robust_fit(df: DataFrame, features: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Median and IQR per feature (and group) -> rows (groups..., feature, center, scale).

    Missing values are ignored per feature; callers pass complete-case rows
    when the reference drops incomplete rows first.
    """
    long = stack_columns(df, list(features), list(groups)).withColumnRenamed("column", "feature")
    long = long.where(F.col("value").isNotNull())
    q = quantiles_long(long, "value", [0.25, 0.5, 0.75], [*groups, "feature"])
    wide = q.groupBy(*groups, "feature").agg(
        *[F.max(F.when(F.col("p") == F.lit(p), F.col("q"))).alias(n)
          for p, n in ((0.25, "q1"), (0.5, "center"), (0.75, "q3"))])
    iqr = F.col("q3") - F.col("q1")
    return wide.select(*groups, "feature", "center",
                       F.when(F.abs(iqr) < F.lit(ZERO_SCALE), F.lit(1.0)).otherwise(iqr).alias("scale"))


def robust_transform(df: DataFrame, scales: DataFrame, features: Sequence[str],
                     prefix: str = "", groups: Sequence[str] = ()) -> DataFrame:
    """(x - center) / scale for every feature, using a fitted scale table."""
    wide = scales.groupBy(*groups).agg(
        *[F.max(F.when(F.col("feature") == F.lit(f), F.col("center"))).alias(f"_c_{f}") for f in features],
        *[F.max(F.when(F.col("feature") == F.lit(f), F.col("scale"))).alias(f"_s_{f}") for f in features])
    j = df.join(F.broadcast(wide), list(groups)) if groups else df.crossJoin(F.broadcast(wide))
    out = j.withColumns({f"{prefix}{f}": (F.col(f) - F.col(f"_c_{f}")) / F.col(f"_s_{f}") for f in features})
    return out.drop(*[f"_c_{f}" for f in features], *[f"_s_{f}" for f in features])


def iqr_fences(df: DataFrame, features: Sequence[str], k: float = 1.5) -> DataFrame:
    """Per feature Q1, Q3, IQR and the fences Q1 - k IQR, Q3 + k IQR."""
    long = stack_columns(df, list(features)).withColumnRenamed("column", "feature")
    long = long.where(F.col("value").isNotNull())
    q = quantiles_long(long, "value", [0.25, 0.75], ["feature"])
    wide = q.groupBy("feature").agg(
        F.max(F.when(F.col("p") == F.lit(0.25), F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == F.lit(0.75), F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return wide.select("feature", "q1", "q3", iqr.alias("iqr"),
                       (F.col("q1") - F.lit(float(k)) * iqr).alias("lower"),
                       (F.col("q3") + F.lit(float(k)) * iqr).alias("upper"))


def fence_columns(fences: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: ``_lo_{f}`` and ``_hi_{f}`` of every feature."""
    return fences.agg(
        *[F.max(F.when(F.col("feature") == F.lit(f), F.col("lower"))).alias(f"_lo_{f}") for f in features],
        *[F.max(F.when(F.col("feature") == F.lit(f), F.col("upper"))).alias(f"_hi_{f}") for f in features])


def outlier_flags(df: DataFrame, features: Sequence[str], k: float = 1.5,
                  fences: DataFrame | None = None) -> DataFrame:
    """Adds ``_out_{f}`` (value outside the fences) and ``outlier_count``."""
    fences = fence_columns(fences if fences is not None else iqr_fences(df, features, k), features)
    j = df.crossJoin(F.broadcast(fences))
    flags = {f"_out_{f}": F.coalesce((F.col(f) < F.col(f"_lo_{f}")) | (F.col(f) > F.col(f"_hi_{f}")),
                                     F.lit(False)) for f in features}
    j = j.withColumns(flags)
    j = j.withColumn("outlier_count", X.count_true([F.col(c) for c in flags]))
    return j.drop(*[f"_lo_{f}" for f in features], *[f"_hi_{f}" for f in features])


@dataclass
class IqrFilterResult:
    kept: DataFrame
    removed: DataFrame
    report: DataFrame      # one row: original, kept, removed, removed_pct
    details: DataFrame     # per feature with >= 1 outlier: count, lower, upper


def iqr_filter(df: DataFrame, columns: Sequence[str], k: float = 1.5, threshold: int = 1,
               exclude: Sequence[str] = ()) -> IqrFilterResult:
    """Drop rows with ``threshold`` or more features outside the IQR fences."""
    feats = [c for c in columns if c not in set(exclude)]
    fences = iqr_fences(df, feats, k)
    flagged = outlier_flags(df, feats, k, fences)
    kept = flagged.where(F.col("outlier_count") < threshold).select(*df.columns)
    removed = flagged.where(F.col("outlier_count") >= threshold).select(*df.columns, "outlier_count")
    report = flagged.agg(
        F.count(F.lit(1)).alias("original_size"),
        F.count(F.when(F.col("outlier_count") < threshold, 1)).alias("filtered_size"),
        F.count(F.when(F.col("outlier_count") >= threshold, 1)).alias("removed_count"))
    report = report.withColumn("removed_pct", X.ieee_div(F.col("removed_count") * F.lit(100.0),
                                                         F.col("original_size")))
    counts = flagged.agg(*[F.count(F.when(F.col(f"_out_{f}"), 1)).alias(f) for f in feats])
    counts_long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("long").alias("count")) for f in feats])))
    details = counts_long.join(fences.select("feature", "lower", "upper"), "feature").where(F.col("count") > 0)
    return IqrFilterResult(kept, removed, report, details)
