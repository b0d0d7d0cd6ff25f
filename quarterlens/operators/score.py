"""Entity score 0-10 against the national benchmark.

The raw score is a pure column expression over the entity row and the
benchmark row of the same fiscal year (a one-row table: broadcast is bounded
by construction).  The 0-10 normalisation is a min-rank percentile computed
with ``functions.ranking`` (distributed, exact) instead of a global window.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.ranking import min_rank_pct


@dataclass(frozen=True)
class ScoreConfig:
    """Weights, clip bounds and eps of the score (defaults = the reference model)."""
    # fixed values: component weights, clip bounds, eps and penalties
    weight_rate_nos: float = 1.0
    weight_growth_volume: float = 0.8
    weight_growth_rate_nos: float = 0.8
    weight_nos_su: float = 0.9
    clip_low: float = -3.0
    clip_high: float = 3.0
    eps: float = 1e-10
    penalty_negative_nos: float = -5.0
    penalty_negative_volume_index: float = -3.0
    penalty_negative_nos_index: float = -3.0
    # index value below which a growth counts as negative (0 in the reference;
    # 100 would mean "shrinking" on a base-100 index)
    growth_floor: float = 0.0


BENCH_COLUMNS = {
    "rate_nos": "general_rate_nos",
    "nos_su": "general_nos_su",
    "variation_rate_volume": "general_growth_volume",
    "variation_rate_nos": "general_growth_rate_nos",
}


def benchmark_row(national: DataFrame, fiscal_year: int) -> DataFrame:
    """The national row of ``fiscal_year`` (earliest quarter if several): one row."""
    row = (national.where(F.col("fiscal_year") == F.lit(int(fiscal_year)))
                   .orderBy("quarter").limit(1))
    return row.select(*[F.col(k).alias(v) for k, v in BENCH_COLUMNS.items()])


def _component(value, bench, cfg: ScoreConfig, negative_passthrough: bool, use_abs: bool):
    value, bench = F.col(value), F.col(bench)
    if negative_passthrough:
        diff = F.when(value < F.lit(0.0), value).otherwise(value - bench)
    else:
        diff = value - bench
    denom = (F.abs(bench) if use_abs else bench) + F.lit(cfg.eps)
    return X.clip(X.ieee_div(diff, denom), cfg.clip_low, cfg.clip_high)


def raw_score(cfg: ScoreConfig = ScoreConfig()):
    """Score before normalisation, accumulated in the reference's order."""
    c1 = _component("rate_nos", "general_rate_nos", cfg, False, False)
    c2 = _component("variation_rate_volume", "general_growth_volume", cfg, True, True)
    c3 = _component("nos_su", "general_nos_su", cfg, True, True)
    c4 = _component("variation_rate_nos", "general_growth_rate_nos", cfg, True, True)
    s = F.lit(0.0) + F.lit(cfg.weight_rate_nos) * c1
    s = s + F.lit(cfg.weight_growth_volume) * c2
    s = s + F.lit(cfg.weight_nos_su) * c3
    s = s + F.lit(cfg.weight_growth_rate_nos) * c4
    s = s + F.when(F.col("nos") < 0, F.lit(cfg.penalty_negative_nos)).otherwise(F.lit(0.0))
    s = s + F.when(F.col("variation_rate_volume") < F.lit(cfg.growth_floor),
                   F.lit(cfg.penalty_negative_volume_index)).otherwise(F.lit(0.0))
    s = s + F.when(F.col("variation_rate_nos") < F.lit(cfg.growth_floor),
                   F.lit(cfg.penalty_negative_nos_index)).otherwise(F.lit(0.0))
    return X.no_nan(s)


SCORE_OUTPUT = ["rate_nos", "general_rate_nos", "variation_rate_volume", "general_growth_volume",
                "nos_su", "general_nos_su", "variation_rate_nos", "general_growth_rate_nos", "SCORE"]


def score(national: DataFrame, entities: DataFrame, dimension_cols: Sequence[str],
          fiscal_year: int, cfg: ScoreConfig = ScoreConfig(), buckets: int | None = None) -> DataFrame:
    """K1: score every entity row of ``fiscal_year`` against that year's benchmark."""
    dims = list(dimension_cols)
    missing = [c for c in dims if c not in entities.columns]
    if missing:
        raise ValueError(f"dimension columns not in the table: {missing}")
    rows = entities.where(F.col("fiscal_year") == F.lit(int(fiscal_year)))
    rows = rows.crossJoin(F.broadcast(benchmark_row(national, fiscal_year)))
    rows = rows.withColumn("_raw", raw_score(cfg))
    ranked = min_rank_pct(rows, "_raw", "SCORE", scale=10.0, buckets=buckets)
    cols = dims + (["quarter"] if "quarter" not in dims else [])
    cols += [c for c in SCORE_OUTPUT if c not in cols]
    return ranked.select(*cols)


def score_ranges(scored: DataFrame, strict: bool = False) -> DataFrame:
    """Entities per 1-point SCORE band [k, k+1), empty bands kept.

    ``strict=True`` reproduces the reference: SCORE = 10 falls outside every
    band and leaves the denominator; by default the last band is [9, 10].
    """
    s = F.col("SCORE")
    band = F.floor(s).cast("int")
    if not strict:
        band = F.when(s == F.lit(10.0), F.lit(9)).otherwise(band)
    counted = (scored.where(s.isNotNull() & (s >= 0) & (s < 10 if strict else s <= 10))
                     .groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("count")))
    bands = scored.sparkSession.range(0, 10).select(F.col("id").cast("int").alias("band"))
    out = bands.join(F.broadcast(counted), "band", "left").fillna(0, ["count"])
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    label_hi = F.when((F.col("band") == 9) & F.lit(not strict), F.lit("]")).otherwise(F.lit(")"))
    return out.select(
        "band",
        F.concat(F.lit("["), F.col("band").cast("string"), F.lit(", "),
                 (F.col("band") + 1).cast("string"), label_hi).alias("score_range"),
        F.col("count").cast("long").alias("count"),
        F.bround(X.ieee_div(F.lit(100.0) * F.col("count"), total), 2).alias("pct"),
    )


def score_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """A35 (score part): equal-width SCORE histogram with the mean and median."""
    from ..functions.ranking import quantiles_long
    from .explore import histogram_feed
    hist = histogram_feed(scored, ["SCORE"], bins=bins, trim=False)
    s = scored.where(F.col("SCORE").isNotNull())
    mean = s.agg(X.ieee_div(F.sum(F.col("SCORE").cast("decimal(38,18)")).cast("double"),
                            F.count(F.lit(1))).alias("mean_score"))
    med = quantiles_long(s.select(F.lit("SCORE").alias("column"), "SCORE"), "SCORE", [0.5], ["column"])
    return (hist.join(med.select("column", F.col("q").alias("median_score")), "column", "left")
            .crossJoin(F.broadcast(mean)))
