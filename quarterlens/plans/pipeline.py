"""Composite jobs (E1-E5) wired to the test tables.

``Inputs`` bundles the four landing tables; ``fixture_inputs`` derives them
from ``/root/testdata``-style folders and ``file_inputs`` reads real landing
files.  ``Run`` holds the scope of one run (summary quarters, fiscal years,
scored year and train year), all parameters instead of hard-coded values.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import cut
from ..operators import merge as M
from ..operators import prepare as P
from ..operators import score as K
from ..operators import summary as Q
from ..sources import fixtures as FX
from ..sources import readers as R


@dataclass(frozen=True)
class Run:
    # fixed values of the test scope: one quarter in three fiscal years
    quarters: Sequence[dt.date] = (dt.date(1998, 10, 1), dt.date(1999, 10, 1), dt.date(2000, 10, 1))
    years: Sequence[int] = (1998, 1999, 2000)
    score_year: int = 2000
    train_year: int = 1999
    country: str | None = None


DEFAULT_RUN = Run()


@dataclass
class Inputs:
    report_raw: DataFrame
    customer_raw: DataFrame
    product_raw: DataFrame
    dictionary: DataFrame


def fixture_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(FX.report_landing(spark, sf_dir), FX.customer_landing(spark, sf_dir),
                  FX.product_landing(spark, sf_dir), FX.category_dictionary(spark, sf_dir))


def file_inputs(spark: SparkSession, reports, customers, products, dictionary,
                report_fmt: str = "parquet", master_fmt: str = "csv") -> Inputs:
    return Inputs(R.read_reports(spark, reports, report_fmt),
                  R.read_customer_master(spark, customers, master_fmt),
                  R.read_product_master(spark, products, master_fmt),
                  R.read_category_dictionary(spark, dictionary, master_fmt))


@dataclass
class Prepared:
    report: DataFrame
    customers: DataFrame
    products: DataFrame
    dictionary: DataFrame


def prepare(inputs: Inputs, run: Run = DEFAULT_RUN) -> Prepared:
    """E1."""
    return Prepared(P.prepare_report(inputs.report_raw),
                    P.prepare_customer(inputs.customer_raw, run.country),
                    P.prepare_product(inputs.product_raw),
                    inputs.dictionary)


def merged(inputs: Inputs, run: Run = DEFAULT_RUN) -> M.MergeResult:
    """E2 on top of E1."""
    p = prepare(inputs, run)
    return M.data_merge(p.report, p.customers, p.products, p.dictionary)


def final_table(inputs: Inputs, run: Run = DEFAULT_RUN) -> DataFrame:
    """E2's fiscal-quarter table, for one reader."""
    return merged(inputs, run).quarterly


def final_in_scope(inputs: Inputs, run: Run = DEFAULT_RUN) -> DataFrame:
    """Final quarterly table restricted to the run's quarters, written once to the checkpoint folder.

    Every summary, score and model reads it several times; the cut keeps the
    fact-table joins from being recomputed per branch, and stands after the
    choice of quarters, so Spark aggregates and writes those alone.
    """
    return cut(Q.filter_quarters(final_table(inputs, run), run.quarters))


# The six summary grains of the reference job.
SUMMARY_GRAINS = {
    "team": ["team"],
    "channel": ["channel"],
    "category": ["category_smo"],
    "customer": ["customer", "channel", "team"],
    "customer_category": ["customer", "category_smo", "channel", "team"],
}


def summaries(final: DataFrame, run: Run = DEFAULT_RUN) -> dict[str, DataFrame]:
    """National summary plus one per grain."""
    out = {"national": Q.national_summary(final)}
    for name, keys in SUMMARY_GRAINS.items():
        out[name] = Q.group_summary(final, keys, run.years)
    return out


SCORE_DIMENSIONS = {
    "category": ["category_smo"],
    "channel": ["channel"],
    "team": ["team"],
    "customer": ["customer", "channel", "team"],
}


def scores(final: DataFrame, run: Run = DEFAULT_RUN, which: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """E5: score each dimension against the national benchmark of ``run.score_year``."""
    national = Q.national_summary(final)
    out = {}
    for name, dims in SCORE_DIMENSIONS.items():
        if which is not None and name not in which:
            continue
        entities = Q.group_summary(final, dims, run.years)
        out[name] = K.score(national, entities, dims, run.score_year)
    return out


def customer_year(final: DataFrame, year: int, run: Run = DEFAULT_RUN) -> DataFrame:
    """Customer-grain summary rows of one fiscal year (train/test tables)."""
    return Q.filter_fiscal_year(Q.customer_summary(final, run.years), year)


def train_table(final: DataFrame, run: Run = DEFAULT_RUN) -> DataFrame:
    """Prior-year customer rows whose NOS index is present."""
    return customer_year(final, run.train_year, run).where(F.col("variation_rate_nos").isNotNull())
