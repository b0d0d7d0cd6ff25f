"""Null / infinity policy of the shared expressions."""
import math

from pyspark.sql import functions as F

from quarterlens.functions import exprs as X


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_ieee_div_zero_base(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (0.0, 5.0), (-2.0, 4.0), (-1.0, 0.0)], "x double, prev double")
    got = [r["v"] for r in rows.select(X.index100("x", "prev").alias("v")).collect()]
    assert got[0] == math.inf
    assert got[1] is None
    assert got[2] == 0.0
    assert got[3] == -50.0
    assert got[4] == -math.inf


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (-7.0,), (1.5,)], "x double")
    got = [r["v"] for r in df.select(X.clip("x", -3, 3).alias("v")).collect()]
    assert got == [None, 3.0, -3.0, 1.5]


def test_finite_and_to_number(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,), ("inf",)], "s string")
    got = [r["v"] for r in df.select(X.finite(X.to_number("s")).alias("v")).collect()]
    assert got == [1.5, None, None, None]


def test_fiscal_year_and_quarter(spark):
    df = spark.createDataFrame([("202502",), ("202507",), ("202412",)], "t string")
    out = df.select(X.fiscal_year(X.month_id_to_date("t")).alias("fy"),
                    X.quarter_start(X.month_id_to_date("t")).cast("string").alias("q")).collect()
    assert [(r.fy, r.q) for r in out] == [(2024, "2025-01-01"), (2025, "2025-07-01"), (2024, "2024-10-01")]


def test_exact_sum_is_order_free(spark):
    vals = [0.1] * 1000 + [1e9, -1e9, 0.3]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = df.repartition(7).agg(X.exact_sum("x").alias("s")).first()["s"]
    b = df.coalesce(1).agg(X.exact_sum("x").alias("s")).first()["s"]
    assert a == b == 100.3
    assert spark.createDataFrame([(None,)], "x double").agg(X.exact_sum("x").alias("s")).first()["s"] == 0.0


def test_limb_sums_equal_exact_integers(spark):
    import random
    rnd = random.Random(8)
    values = [rnd.choice([1, -1]) * rnd.random() * 10 ** rnd.randint(-7, 18) for _ in range(400)] + [0.0, -0.0, 1e21, -1e21, 5e-7]
    rows = [(i % 3, v, None if i % 4 else v / 3, float("inf") if i == 5 else 1.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows + [(9, None, None, None)], "k int, x double, y double, z double").repartition(5)
    got = {r["k"]: r for r in X.exact_sums(df, ["k"], ["x", "y", "z"], F.count("x").alias("n")).collect()}
    for k in range(3):
        mine = [r for r in rows if r[0] == k]
        for at, name in ((1, "x"), (2, "y")):
            want = float(sum(int(round(r[at] * 1e6)) for r in mine if r[at] is not None)) / 1e6
            assert got[k][name] == want
        assert got[k]["z"] == (None if k == 2 else float(len(mine))) and got[k]["n"] == len(mine)
    assert (got[9]["x"], got[9]["y"], got[9]["n"]) == (0.0, 0.0, 0)
    one = df.groupBy("k").agg(X.exact_sum("x").alias("s")).collect()
    assert {r["k"]: r["s"] for r in one} == {k: r["x"] for k, r in got.items()}


def test_limb_sums_beyond_the_range_are_missing(spark):
    big = spark.range(1 << 10).select(F.lit(1).alias("k"), F.lit(1e21).alias("x"), F.lit(-1e21).alias("y"), F.lit(1e22).alias("z"))
    row = X.exact_sums(big, ["k"], ["x", "y", "z"]).first()
    assert (row["x"], row["y"], row["z"]) == (None, None, None)  # the totals run over; a value is too large
    assert X.exact_sums(big.limit(2), ["k"], ["x"]).first()["x"] == 2e21
