"""End-to-end job on the smallest test tables: every output is written and readable."""
import tempfile

from quarterlens.plans import jobs as J
from quarterlens.plans import pipeline as PL

SF = "/root/testdata/sf0.001"


def test_preparation_summary_and_score_jobs(spark):
    out_dir = tempfile.mkdtemp(prefix="ql-job-", dir="/tmp")
    paths = J.preparation_job(PL.fixture_inputs(spark, SF), out_dir)
    final = spark.read.parquet(paths["final"])
    assert final.count() > 0
    s = J.summary_job(final, out_dir)
    assert spark.read.parquet(s["summary_team"]).count() > 0
    k = J.score_job(final, out_dir)
    sc = spark.read.parquet(k["score_customer"])
    assert sc.count() > 0 and "SCORE" in sc.columns
    paths = J.exploration_job(spark, s["summary_customer"], f"{out_dir}/exploration", PL.DEFAULT_RUN.score_year,
                              category_path=s["summary_customer_category"], score_path=k["score_customer"])
    for name in ("value_counts", "corr_pearson", "corr_spearman", "corr_kendall", "nos_table_category", "score_histogram"):
        assert spark.read.parquet(paths[name]).count() > 0, name
    models = J.model_job(final, out_dir, optimize=False)
    for name in ("anomaly_predictions", "anomaly_metrics", "anomaly_by_channel", "cluster_winners", "cluster_labels"):
        assert spark.read.parquet(models.paths[name]).count() > 0, name
    report = J.report_job(final, models, out_dir)
    assert spark.read.parquet(report["coverage"]).count() > 0
