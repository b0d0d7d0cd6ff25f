"""What the jobs write: rows in order over the files (T1, T2), the same rows as the queries, both formats."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from quarterlens.operators import summary as Q
from quarterlens.plans import jobs as J
from quarterlens.plans import pipeline as PL
from quarterlens.sources import readers as R
from quarterlens.sources import sinks as SK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def final(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("prepared"))
    paths = J.preparation_job(PL.fixture_inputs(spark, SF), out)
    return spark.read.parquet(paths["final"])


def in_files(path):
    """Rows of a written table, file by file in the order of their names."""
    return [r for f in sorted(glob.glob(f"{path}/part-*.parquet")) for r in pq.read_table(f).to_pylist()]


def nulls_first(values):
    return tuple((v is not None, v) for v in values)


def as_rows(rows):
    return sorted((repr(sorted(r.items())) for r in rows))


def test_summaries_are_written_in_order_and_whole(spark, final, tmp_path):
    written = J.summary_job(final, str(tmp_path))
    want = PL.summaries(Q.filter_quarters(final, PL.DEFAULT_RUN.quarters), PL.DEFAULT_RUN)
    assert set(written) == {f"summary_{name}" for name in want}
    for name, grain in (("national", []), ("team", PL.SUMMARY_GRAINS["team"]), ("customer", PL.SUMMARY_GRAINS["customer"])):
        rows = in_files(written[f"summary_{name}"])
        keys = [nulls_first(r[c] for c in [*grain, "fiscal_year", "quarter"]) for r in rows]
        assert len(keys) > 1 and keys == sorted(keys) and len(set(keys)) == len(keys)
        assert as_rows(rows) == as_rows(r.asDict() for r in want[name].collect())


def test_scores_are_written_best_first(spark, final, tmp_path):
    written = J.score_job(final, str(tmp_path))
    for name, dims in PL.SCORE_DIMENSIONS.items():
        rows = in_files(written[f"score_{name}"])
        # Best first, rows without a score last, ties by dimension.
        keys = [(r["SCORE"] is None, -(r["SCORE"] or 0.0), nulls_first(r[c] for c in dims)) for r in rows]
        assert keys and keys == sorted(keys), name


def test_tables_are_replaced_in_both_formats_and_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x, y"), ("b", 2, None), ("a", 3, 'say "z"')], "k string, n int, t string")
    rows = {tuple(r) for r in df.collect()}
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        SK.write_table(df.limit(1), path, fmt)
        assert SK.write_table(df, path, fmt) == path
        back = R.read_saved_table(spark, path, fmt)
        assert back.dtypes == df.dtypes and {tuple(r) for r in back.collect()} == rows
    path = SK.write_table(df, str(tmp_path / "by"), partition_by="k")
    assert sorted(f for f in os.listdir(path) if f.startswith("k=")) == ["k=a", "k=b"]
    assert {(r["k"], r["n"], r["t"]) for r in spark.read.parquet(path).collect()} == rows
    assert SK.write_if_findings(df, str(tmp_path / "found")) is True
    assert spark.read.parquet(str(tmp_path / "found")).count() == 3
