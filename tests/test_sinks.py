"""Sinks: empty quality reports are not written; dated names; readers stack files."""
import datetime as dt
import os
import tempfile

from quarterlens.sources import readers as R
from quarterlens.sources import sinks as SK


def test_sinks_and_reader_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="ql-sink-", dir="/tmp")
    empty = spark.range(0).selectExpr("cast(id as string) as optima_id")
    assert SK.write_if_findings(empty, f"{root}/quality") is False
    assert not os.path.exists(f"{root}/quality")
    df = spark.createDataFrame([("202401", "7", "p1", *([1.5] * 15))],
                               ", ".join(["time_id string", "corp_cust_id string", "prod_id string"]
                                         + [f"{c} double" for c in R.S.REPORT_MEASURES]))
    SK.write_table(df, f"{root}/reports/a")
    SK.write_table(df.drop("volume_su"), f"{root}/reports/b")
    path = SK.write_dated(df, root, "final_report", dt.date(2025, 3, 1))
    assert path.endswith("final_report_01-03-2025")
    stacked = R.read_reports(spark, f"{root}/reports/*")
    rows = stacked.collect()
    assert len(rows) == 2 and sorted(r.volume_su is None for r in rows) == [False, True]
