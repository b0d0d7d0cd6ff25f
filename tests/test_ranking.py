"""Distributed exact ranks and quantiles against pandas / NumPy."""
import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from quarterlens.functions import ranking as R


def test_min_rank_pct_trap(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None), (4, 3.0), (5, float("inf"))], "id int, v double")
    out = {r.id: r.pct for r in R.min_rank_pct(df, "v", "pct", buckets=3).collect()}
    assert out == {1: 0.5, 2: 0.25, 3: None, 4: 0.5, 5: 1.0}


def test_quartiles_trap(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    q = {r.p: r.q for r in R.quantiles_long(df, "v", [0.25, 0.5], buckets=2).collect()}
    assert q == {0.25: 1.75, 0.5: 3.0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.integers(1, 6))
def test_ranks_and_quantiles_match_pandas(spark, values, buckets):
    pdf = pd.DataFrame({"id": range(len(values)), "v": [float(x) for x in values]})
    df = spark.createDataFrame(pdf)
    got = R.min_rank_pct(df, "v", "pct", buckets=buckets).toPandas().sort_values("id")
    want = pdf["v"].rank(method="min", pct=True)
    assert np.allclose(got["pct"].to_numpy(), want.to_numpy())
    avg = R.average_rank(df, "v", "r", buckets=buckets).toPandas().sort_values("id")
    assert np.allclose(avg["r"].to_numpy(), pdf["v"].rank(method="average").to_numpy())
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    q = {r.p: r.q for r in R.quantiles_long(df, "v", probs, buckets=buckets).collect()}
    for p in probs:
        assert q[p] == np.percentile(pdf["v"].to_numpy(), p * 100)


def test_frequent_and_missing_values_spread(spark):
    values = [7.0] * 500 + [None] * 600 + [float(i % 90) for i in range(400)] + [0.0, -0.0, float("inf"), -3.5]
    pdf = pd.DataFrame({"id": range(len(values)), "g": [i % 2 for i in range(len(values))], "v": values})
    df = spark.createDataFrame([tuple(r) for r in pdf.astype(object).where(pdf.notna(), None).values.tolist()],
                               "id long, g long, v double").repartition(6)
    for groups in ([], ["g"]):
        by = pdf.groupby("g")["v"] if groups else pdf["v"]
        for partitions in (1, 5, 9):
            got = R.min_rank_pct(df, "v", "r", groups=groups, buckets=partitions).toPandas().sort_values("id")
            assert np.allclose(got["r"].to_numpy(float), by.rank(method="min", pct=True).to_numpy(), equal_nan=True)
            got = R.average_rank(df, "v", "r", groups=groups, buckets=partitions).toPandas().sort_values("id")
            assert np.allclose(got["r"].to_numpy(float), by.rank(method="average").to_numpy(), equal_nan=True)


def test_ranks_are_not_joined_on_the_value(spark, capsys):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id long, v double")
    R.min_rank_pct(df, "v", "r", buckets=4).explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join" in line]
    assert joins and not any("SortMergeJoin" in line or "[v#" in line or "[_v#" in line for line in joins)


def test_positions_over_the_whole_table(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 10).alias("k")).repartition(4)
    out = R.sorted_positions(df, [F.col("k").desc(), F.col("id")], "at", 5).collect()
    want = sorted(((r["k"], r["id"]) for r in out), key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["id"]) for r in sorted(out, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in out) == list(range(1000))
