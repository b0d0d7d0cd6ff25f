"""Preparation of the three landing sources (E1: P1-P6, A1, A2).

All functions are lazy ``DataFrame -> DataFrame`` steps.  The master dedups
(A1/A2) are hash aggregations with map-side partial aggregation, so a hot
key (or the NULL key) collapses before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S
from ..sources.readers import ROW_ORDER


def first_non_missing(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                      order_col: str = ROW_ORDER, drop_null_keys: bool = False) -> DataFrame:
    """Per key, each value column takes its first non-missing value in file order.

    ``min_by(value, order) FILTER (WHERE value IS NOT NULL)`` is deterministic
    (unlike ``first``), and each column picks independently, so one output row
    may combine values of different source rows.
    """
    if drop_null_keys:
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).isNotNull()
        df = df.where(cond)
    aggs = [F.expr(f"min_by(`{v}`, `{order_col}`) FILTER (WHERE `{v}` IS NOT NULL)").alias(v)
            for v in values]
    return df.groupBy(*keys).agg(*aggs)


def prepare_report(raw: DataFrame) -> DataFrame:
    """P1 keep 18 columns, P2 ids as text, P4 drop placeholder customers, P3 rename.

    A missing customer id is kept (only ids containing 'Dummy' are dropped).
    """
    df = raw.select(
        *[F.col(c).cast("string").alias(c) for c in S.REPORT_ID_COLUMNS],
        *S.REPORT_MEASURES,
    )
    df = df.where(~F.coalesce(F.col("corp_cust_id").contains("Dummy"), F.lit(False)))
    return df.withColumnsRenamed(S.REPORT_RENAMES)


def prepare_customer(raw: DataFrame, country: str | None = None,
                     order_col: str = ROW_ORDER) -> DataFrame:
    """P1 -> A1 dedup per (id, country), NULL keys kept -> P3 rename -> P5 upper -> P6."""
    keys = S.CUSTOMER_KEYS_RAW
    values = [c for c in S.CUSTOMER_RAW_COLUMNS if c not in keys]
    df = raw.select(*[F.col(c).cast("string").alias(c) for c in S.CUSTOMER_RAW_COLUMNS],
                    F.col(order_col))
    df = first_non_missing(df, keys, values, order_col)
    df = df.withColumnsRenamed(S.CUSTOMER_RENAMES)
    df = df.select(*[F.upper(F.col(c)).alias(c) for c in df.columns])
    if country is not None:
        df = df.where(F.col("cust_country_name") == F.lit(country.upper()))
    return df


def prepare_product(raw: DataFrame, uppercase: bool = False,
                    order_col: str = ROW_ORDER) -> DataFrame:
    """P1 -> A2 dedup per (fpc, gtin), NULL keys dropped -> P3 rename -> optional P5."""
    keys = S.PRODUCT_KEYS_RAW
    values = [c for c in S.PRODUCT_RAW_COLUMNS if c not in keys]
    df = raw.select(*[F.col(c).cast("string").alias(c) for c in S.PRODUCT_RAW_COLUMNS],
                    F.col(order_col))
    df = first_non_missing(df, keys, values, order_col, drop_null_keys=True)
    df = df.withColumnsRenamed(S.PRODUCT_RENAMES)
    if uppercase:
        df = df.withColumns({c: F.upper(F.col(c)) for c in S.PRODUCT_TEXT_COLUMNS})
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column (A13 list form), sorted at the sink."""
    return df.select(column).distinct()
