"""Sums beyond 64 bits, files by header and in order, streams over sessions, cuts, one pass over facts."""

import os

import pytest
from pyspark.sql import functions as F

from quarterlens.functions import exprs as X
from quarterlens.functions import materialize as MT
from quarterlens.operators import merge as M
from quarterlens.operators import prepare as P
from quarterlens.plans import pipeline as PL
from quarterlens.session import ensure_checkpoint_dir
from quarterlens.sources import readers as R
from quarterlens.streaming.landing import land_reports

SF = "/root/testdata/sf0.001"


def test_exact_sum_has_no_cap(spark):
    rows = [("a", 9.3e12), ("b", 1e13), ("c", 1e15), ("c", 1e15), ("d", float("inf")), ("d", 1.0), ("e", None),
            ("f", 0.1), ("f", 0.2), ("g", -1e20), ("g", 1e20), ("h", 1e27)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {"a": 9.3e12, "b": 1e13, "c": 2e15, "d": None, "e": 0.0, "f": 0.3, "g": 0.0, "h": None}
    for total in (X.exact_sum("x"), X.exact_sum(F.col("x"))):
        assert {r["k"]: r["s"] for r in df.groupBy("k").agg(total.alias("s")).collect()} == want


def _csv(folder, name, header, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\n", encoding="latin-1")
    return str(folder / name)


def test_csv_files_are_stacked_by_name(spark, tmp_path):
    a = _csv(tmp_path / "in", "a.csv", ["time_id", "corp_cust_id", "giv_lc"], ["202401", "CUST1", "1.5"])
    b = _csv(tmp_path / "in", "b.csv", ["corp_cust_id", "time_id"], ["CUST2", "202402"])
    for paths in ([a, b], str(tmp_path / "in"), str(tmp_path / "in" / "*.csv")):
        out = {r["time_id"]: (r["corp_cust_id"], r["giv_lc"]) for r in R.read_reports(spark, paths, "csv").collect()}
        assert out == {"202401": ("CUST1", 1.5), "202402": ("CUST2", None)}
    with pytest.raises(FileNotFoundError):
        R.read_reports(spark, str(tmp_path / "nothing" / "*.csv"), "csv")


def test_first_value_follows_the_order_of_files(spark, tmp_path):
    cols = R.S.CUSTOMER_RAW_COLUMNS
    keys = R.S.CUSTOMER_KEYS_RAW
    value = next(c for c in cols if c not in keys)
    line = lambda v: ["k" if c in keys else v if c == value else "" for c in cols]
    filler = [[f"{c}{i}" for c in cols] for i in range(2000)]
    a = _csv(tmp_path / "m", "a.csv", cols, line("Ésta"))
    b = _csv(tmp_path / "m", "b.csv", cols[::-1], line("other")[::-1], *[f[::-1] for f in filler])
    name = R.S.CUSTOMER_RENAMES.get(value, value)
    for paths, want in (([a, b], "ÉSTA"), ([b, a], "OTHER")):
        out = P.prepare_customer(R.read_customer_master(spark, paths))
        key = R.S.CUSTOMER_RENAMES.get(keys[0], keys[0])
        assert [r[name] for r in out.where(F.col(key) == "K").collect()] == [want]


def test_stream_goes_on_in_another_session(spark, tmp_path):
    cols = R.S.REPORT_ID_COLUMNS + R.S.REPORT_MEASURES
    types = ", ".join(f"{c} {'string' if c in R.S.REPORT_ID_COLUMNS else 'double'}" for c in cols)
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    for session, time_id in ((spark, "202401"), (spark.newSession(), "202402")):
        row = tuple(time_id if c == "time_id" else "x" if c in R.S.REPORT_ID_COLUMNS else 1.0 for c in cols)
        session.createDataFrame([row], types).write.mode("append").parquet(landing)
        land_reports(session, landing, table).awaitTermination()
    assert sorted(r["time_id"] for r in spark.read.parquet(table).collect()) == ["202401", "202402"]
    assert os.path.isdir(f"{table}_progress")


def test_cuts_are_removed(spark):
    since = MT.marked(spark)
    df = MT.cut(spark.range(3))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    assert MT.release(spark, since) == 1 and not os.path.exists(folder) and MT.marked(spark) == since


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_side_tables_come_from_written_rows(spark):
    """The joined facts are written once; final and side tables scan what was written."""
    p = PL.prepare(PL.fixture_inputs(spark, SF))
    m = M.data_merge(p.report, p.customers, p.products, p.dictionary, keep_rows=True)
    for df in (m.final, m.missing_channel_team, m.missing_product, m.name_quality_after):
        files = df.inputFiles()
        assert not any("lineitem" in f for f in files) and any("ql-tables" in f for f in files)
    lazy = M.data_merge(p.report, p.customers, p.products, p.dictionary)
    assert not any("lineitem" in f for f in lazy.final.inputFiles())
    assert lazy.final.count() == m.final.count()


def _forest_rows(spark, n=400):
    import random
    rnd = random.Random(1)
    rows = [(f"k{i}", rnd.gauss(0, 1), rnd.gauss(5, 2)) for i in range(n)]
    rows += [("far", 30.0, -40.0), (None, 29.0, -39.0), (None, 0.1, 5.0), ("k1", 0.0, None)]
    return spark.createDataFrame(rows, "k string, a double, b double")


def test_rows_are_scored_where_they_are(spark):
    from quarterlens.operators import anomaly as AN
    df = _forest_rows(spark)
    model = AN.fit_model(df, ["k"], ["a", "b"], 50, 0.02)
    out = AN.predict(df, model, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = out.collect()
    assert len(got) == df.count()
    assert sum(r["anomaly_score"] is None for r in got) == 1
    nameless = sorted(r["anomaly_score"] for r in got if r["k"] is None)
    assert nameless[0] < 0 < nameless[1]
    by_forest = AN.score_rows(df, model.fit, ["k"], [0], [10, 50])
    assert by_forest.where("T = 50").count() == by_forest.where("T = 10").count() == df.count() - 1


def test_a_sparse_feature_does_not_send_the_table_to_every_tree(spark):
    """The sample of a sparse subset is drawn from its complete rows, the others' from a small share."""
    from quarterlens.operators import anomaly as AN
    df = spark.range(40000).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("a"), F.rand(2).alias("b"),
                                   F.when(F.col("id") % 100 == 0, F.rand(3)).alias("c"))
    fit = AN.fit_forests(df, ["k"], [("a", "b"), ("a", "c")], ("auto",), 4)
    roots = fit.nodes.where("node = 0").groupBy("forest").count().collect()
    assert {r["forest"]: r["count"] for r in roots} == {0: 4, 1: 4}
    leaves = fit.nodes.where("feature < 0").groupBy("forest", "tree").agg(F.sum("size").alias("n")).collect()
    assert all(r["n"] == 256 for r in leaves)
    plan = [r for r in fit.candidates.groupBy("tree").count().collect()]
    assert max(r["count"] for r in plan) < 4000
