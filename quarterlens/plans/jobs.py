"""End-to-end jobs (E3-E9): what a user of the pipeline runs, with sinks.

Each job takes the session, its inputs and an output folder, builds the lazy
plans of the operators and writes the tables; the only actions are the
writes (and the bounded model parameters the ML steps bring back).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import cut, marked, release
from ..operators import anomaly as AN
from ..operators import cluster as CL
from ..operators import explore as EX
from ..operators import report as RP
from ..operators import score as K
from ..operators import summary as Q
from ..sources import readers as R
from ..sources import sinks as SK
from . import pipeline as PL

KEYS = ["customer", "channel", "team"]
ANOMALY_FEATURES = ["rate_nsrd", "rate_sd", "nos_su", "variation_rate_nos", "variation_rate_volume"]
CLUSTER_FEATURES = ["nos_su", "rate_nsrd", "rate_sd", "variation_rate_nos", "variation_rate_volume", "SCORE"]


def preparation_job(inputs: PL.Inputs, out_dir: str, run: PL.Run = PL.DEFAULT_RUN,
                    fmt: str = "parquet") -> dict:
    """Prepared sources, the fiscal-quarter table and the quality side tables."""
    p = PL.prepare(inputs, run)
    since = marked(inputs.report_raw.sparkSession)
    m = PL.M.data_merge(p.report, p.customers, p.products, p.dictionary, keep_rows=True)
    out = {
        "final": SK.write_table(m.final, f"{out_dir}/final_df", fmt),
        "missing_channel_team": SK.write_table(m.missing_channel_team, f"{out_dir}/missing_channel_team", fmt),
        "missing_product": SK.write_table(m.missing_product, f"{out_dir}/missing_product", fmt),
    }
    if SK.write_if_findings(m.name_quality_after, f"{out_dir}/quality_check_optima_names", fmt):
        out["quality_check_optima_names"] = f"{out_dir}/quality_check_optima_names"
    release(inputs.report_raw.sparkSession, since)  # all outputs are written
    return out


def summary_job(final: DataFrame, out_dir: str, run: PL.Run = PL.DEFAULT_RUN, fmt: str = "parquet") -> dict:
    """The national summary and the five grains, in the run's quarters."""
    scoped = Q.filter_quarters(final, run.quarters)
    order = {name: [*PL.SUMMARY_GRAINS.get(name, []), "fiscal_year", "quarter"] for name in ("national", *PL.SUMMARY_GRAINS)}
    return {f"summary_{name}": SK.write_table(df.orderBy(*order[name]), f"{out_dir}/summary_{name}", fmt)  # T1
            for name, df in PL.summaries(scoped, run).items()}


def score_job(final: DataFrame, out_dir: str, run: PL.Run = PL.DEFAULT_RUN, fmt: str = "parquet") -> dict:
    """E5: the four score dimensions."""
    scoped = Q.filter_quarters(final, run.quarters)
    return {f"score_{name}": SK.write_table(df.orderBy(F.desc("SCORE"), *PL.SCORE_DIMENSIONS[name]),  # T2
                                           f"{out_dir}/score_{name}", fmt)
            for name, df in PL.scores(scoped, run).items()}


@dataclass
class ModelOutputs:
    anomalies: DataFrame
    clusters: CL.ClusterResult
    scores: DataFrame
    grid: AN.GridResult | None
    paths: dict = field(default_factory=dict)


def model_job(final: DataFrame, out_dir: str, run: PL.Run = PL.DEFAULT_RUN, fmt: str = "parquet",
              optimize: bool = True) -> ModelOutputs:
    """E6 + E7: anomaly grid search and model, clustering with feature selection."""
    scoped = Q.filter_quarters(final, run.quarters)
    cust = cut(Q.customer_summary(scoped, run.years))
    train = Q.filter_fiscal_year(cust, run.train_year).where(F.col("variation_rate_nos").isNotNull())
    test = Q.filter_fiscal_year(cust, run.score_year)
    national = Q.filter_fiscal_year(Q.national_summary(scoped), run.score_year)
    found = AN.complete_analysis(train, test, KEYS, ANOMALY_FEATURES, ("channel", "team"), national, optimize)
    anomalies = found.predictions
    scores = cut(K.score(Q.national_summary(scoped), cust, KEYS, run.score_year))
    data = (test.select(*KEYS, *[f for f in CLUSTER_FEATURES if f != "SCORE"])
            .join(scores.select(*KEYS, "SCORE"), KEYS, "left").dropna(subset=CLUSTER_FEATURES))
    clusters = CL.full_analysis(data, KEYS, CLUSTER_FEATURES)
    by_score = [F.desc("anomaly_score"), *KEYS]
    tables = {
        "anomaly_predictions": anomalies,
        "anomaly_metrics": found.metrics,
        "anomaly_explanations": found.explanations.orderBy(*by_score),
        "anomaly_summary": found.summary.orderBy(*by_score),
        **{f"anomaly_by_{c}": df for c, df in found.segments.items()},
        "cluster_grid": clusters.grid,
        "cluster_winners": clusters.winners,
        "cluster_labels": clusters.labels,
    }
    if found.grid:
        tables["anomaly_grid"] = found.grid.experiments
    paths = {name: SK.write_table(df, f"{out_dir}/{name}", fmt) for name, df in tables.items()}
    return ModelOutputs(anomalies, clusters, scores, found.grid, paths)


def report_job(final: DataFrame, models: ModelOutputs, out_dir: str, run: PL.Run = PL.DEFAULT_RUN,
               run_date: dt.date | None = None, fmt: str = "parquet") -> dict:
    """Final report, its coverage, and the dated export."""
    scoped = Q.filter_quarters(final, run.quarters)
    base = Q.filter_fiscal_year(Q.customer_summary(scoped, run.years), run.score_year)
    report = cut(RP.final_report(base, models.scores, models.anomalies, models.clusters.labels, KEYS))
    return {"final_report": SK.write_dated(report, out_dir, "final_report", run_date, fmt),
            "coverage": SK.write_table(RP.coverage(report), f"{out_dir}/report_coverage", fmt)}


def exploration_job(spark: SparkSession, summary_path: str, out_dir: str, year: int,
                    fmt: str = "parquet", columns: Sequence[str] = ("channel", "team"),
                    category_path: str | None = None, score_path: str | None = None) -> dict:
    """Exploratory tables on a saved customer summary (S8), and on saved category and score tables."""
    df = Q.filter_fiscal_year(R.read_saved_table(spark, summary_path, fmt), year)
    rates = ["rate_nos", "rate_nsrd", "rate_sd", "nos_su", "variation_rate_nos", "variation_rate_volume"]
    cols = [c for c in columns if c in df.columns]
    tables = {
        "distinct_counts": EX.distinct_counts(df, ["customer", "channel", "team"]),
        "value_counts": EX.value_counts(df, cols),
        "customers_by": EX.customers_by(df, cols),
        "descriptive": EX.descriptive(df, rates, remove_outliers=True),
        "nos_table": EX.nos_table(df, cols),
        **{f"corr_{m}": EX.correlation(df, rates, m, keys=KEYS) for m in ("pearson", "spearman", "kendall")},
        "share_bands": EX.share_bands(df),
        "top_customers": EX.top_customers(df, 10),
        "histogram_feed": EX.histogram_feed(df, rates),
    }
    if category_path is not None:
        by_category = Q.filter_fiscal_year(R.read_saved_table(spark, category_path, fmt), year)
        tables["nos_table_category"] = EX.nos_table(by_category, ["category_smo"])
    if score_path is not None:
        tables["score_histogram"] = K.score_histogram(R.read_saved_table(spark, score_path, fmt))
    return {k: SK.write_table(v, f"{out_dir}/{k}", fmt) for k, v in tables.items()}


def full_job(spark: SparkSession, inputs: PL.Inputs, out_dir: str, run: PL.Run = PL.DEFAULT_RUN,
             fmt: str = "parquet") -> dict:
    """E3 -> E8 in order; E9 reads the saved customer summary."""
    out = preparation_job(inputs, out_dir, run, fmt)
    final = R.read_saved_table(spark, out["final"], fmt)
    out.update(summary_job(final, out_dir, run, fmt))
    out.update(score_job(final, out_dir, run, fmt))
    models = model_job(final, out_dir, run, fmt)
    out.update(models.paths)
    out.update(report_job(final, models, out_dir, run, fmt=fmt))
    out.update(exploration_job(spark, out["summary_customer"], f"{out_dir}/exploration", run.score_year, fmt,
                               category_path=out["summary_customer_category"], score_path=out["score_customer"]))
    return out
