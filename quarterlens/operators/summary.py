"""Quarterly and annual summaries.

Shape of every summary: one hash aggregation to (fiscal_year, quarter, keys)
(partial + final, so skewed keys collapse map-side), then a window
partitioned by the keys on the aggregated table (a handful of rows per key).
The national variants have no keys: the window then runs over the few
(fiscal_year, quarter) rows in a single task, which is bounded by the number
of periods, not by the data.
"""

from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.schemas import SUMMARY_MEASURES

INDEX_COLUMNS = [
    ("variation_rate_gs", "gross_sales"),
    ("variation_rate_nos", "nos_excl_NIT"),
    ("variation_rate_volume", "volume_excl_nit_su"),
    ("variation_rate_nos_su", "nos_su"),
    ("variation_rate_sd", "sd"),
    ("variation_rate_nsrd", "nsrd_excl_nit"),
]


def _keys(group_by) -> list[str]:
    return [group_by] if isinstance(group_by, str) else list(group_by)


def filter_quarters(df: DataFrame, quarters: Sequence) -> DataFrame:
    """Keep the chosen quarter starts."""
    qs = [q if isinstance(q, _dt.date) else _dt.date.fromisoformat(str(q)) for q in quarters]
    return df.where(F.col("quarter").isin(qs))


def filter_fiscal_year(df: DataFrame, year: int) -> DataFrame:
    """P8."""
    return df.where(F.col("fiscal_year") == F.lit(int(year)))


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "rate_nos": X.rate100("nos_excl_NIT", "gross_sales"),
        "rate_nsrd": X.rate100("nsrd_excl_nit", "gross_sales"),
        "rate_sd": X.rate100("sd", "gross_sales"),
    }).withColumn("srm", X.no_nan(F.col("variation_rate_nos") - F.col("variation_rate_volume")))


def national_summary(df: DataFrame) -> DataFrame:
    """A8 + W1: national quarterly sums, nos_su, base-100 indices, rates, srm."""
    g = X.exact_sums(df, ["fiscal_year", "quarter"], SUMMARY_MEASURES)
    g = g.withColumn("nos_su", X.ieee_div("nos_excl_NIT", "volume_excl_nit_su"))
    w = Window.orderBy("fiscal_year", "quarter")
    g = g.withColumns({name: X.index100(F.col(src), F.lag(src).over(w)) for name, src in INDEX_COLUMNS})
    return _rates(g)


def group_summary(df: DataFrame, group_by, years: Sequence[int] | None = None) -> DataFrame:
    """A9 + A10 + W2: quarterly summary per key list with fiscal-year-aware indices.

    A row's predecessor (previous quarter of the same keys) only counts when it
    lies in the same or the previous fiscal year; across a gap the index is
    missing.  ``years`` restricts the fiscal years taken into account.
    """
    keys = _keys(group_by)
    if years is not None:
        df = df.where(F.col("fiscal_year").isin([int(y) for y in years]))
    others = []
    if "customer" in df.columns and "customer" not in keys:
        others.append(F.count_distinct("customer").alias("n_customers"))
    g = X.exact_sums(df, ["fiscal_year", "quarter", *keys], SUMMARY_MEASURES, *others)
    g = g.withColumn("nos_su", X.ieee_div("nos_excl_NIT", "volume_excl_nit_su"))
    w = Window.partitionBy(*keys).orderBy("quarter")
    prev_fy = F.lag("fiscal_year").over(w)
    adjacent = prev_fy >= F.col("fiscal_year") - 1
    g = g.withColumns({
        name: F.when(adjacent, X.index100(F.col(src), F.lag(src).over(w)))
        for name, src in INDEX_COLUMNS
    })
    return _rates(g)


def customer_summary(df: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Default grain customer x channel x team."""
    return group_summary(df, ["customer", "channel", "team"], years)


ANNUAL_MEASURES = ["gross_sales", "nos", "nsrd", "sd"]


def annual_national(df: DataFrame) -> DataFrame:
    """A11 + W3: yearly sums, growth % (not base 100), rates over gross sales."""
    g = X.exact_sums(df, ["fiscal_year"], ANNUAL_MEASURES)
    w = Window.orderBy("fiscal_year")
    g = g.withColumns({
        "variation_rate_gs": X.growth_pct(F.col("gross_sales"), F.lag("gross_sales").over(w)),
        "variation_rate_nos": X.growth_pct(F.col("nos"), F.lag("nos").over(w)),
        "variation_rate_sd": X.growth_pct(F.col("sd"), F.lag("sd").over(w)),
        "variation_rate_nsrd": X.growth_pct(F.col("nsrd"), F.lag("nsrd").over(w)),
    })
    return g.withColumns({
        "rate_nos": X.rate100("nos", "gross_sales"),
        "rate_nsrd": X.rate100("nsrd", "gross_sales"),
        "rate_sd": X.rate100("sd", "gross_sales"),
    })


def annual_by_group(df: DataFrame, group_by=("customer", "channel", "team")) -> DataFrame:
    """A12 + W3: yearly sums per keys, growth % against the previous listed year."""
    keys = _keys(group_by)
    g = X.exact_sums(df, ["fiscal_year", *keys], ANNUAL_MEASURES)
    w = Window.partitionBy(*keys).orderBy("fiscal_year")
    g = g.withColumns({
        "growth_rate_gs": X.growth_pct(F.col("gross_sales"), F.lag("gross_sales").over(w)),
        "growth_rate_nos": X.growth_pct(F.col("nos"), F.lag("nos").over(w)),
        "growth_rate_sd": X.growth_pct(F.col("sd"), F.lag("sd").over(w)),
        "growth_rate_nsrd": X.growth_pct(F.col("nsrd"), F.lag("nsrd").over(w)),
    })
    g = g.withColumns({
        "rate_nos": X.rate100("nos", "gross_sales"),
        "rate_nsrd": X.rate100("nsrd", "gross_sales"),
        "rate_sd": X.rate100("sd", "gross_sales"),
    })
    return g.withColumn("fiscal_year", F.col("fiscal_year").cast("string"))
