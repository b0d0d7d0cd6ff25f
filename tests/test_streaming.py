"""Incremental landing: only new files are processed, nothing twice."""
import tempfile

from pyspark.sql import functions as F

from quarterlens.sources import fixtures as FX
from quarterlens.streaming.landing import land_reports

SF = "/root/testdata/sf0.001"


def test_incremental_landing_is_exactly_once(spark):
    raw = FX.report_landing(spark, SF)
    first, second = raw.where(F.col("time_id") < "199807"), raw.where(F.col("time_id") >= "199807")
    root = tempfile.mkdtemp(prefix="ql-stream-", dir="/tmp")
    first.write.parquet(f"{root}/landing/a")
    q = land_reports(spark, f"{root}/landing/*", f"{root}/table", f"{root}/progress")
    q.awaitTermination()
    n1 = spark.read.parquet(f"{root}/table").count()
    second.write.parquet(f"{root}/landing/b")
    q = land_reports(spark, f"{root}/landing/*", f"{root}/table", f"{root}/progress")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/table")
    expected = raw.where(~F.coalesce(F.col("corp_cust_id").contains("Dummy"), F.lit(False))).count()
    assert 0 < n1 < expected
    assert out.count() == expected
