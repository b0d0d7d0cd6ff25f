"""Hand tables for the traps listed in FIXTURES.md section 3."""
import datetime as dt

from pyspark.sql import functions as F

from quarterlens.operators import anomaly as AN
from quarterlens.operators import explore as EX
from quarterlens.operators import merge as M
from quarterlens.operators import prepare as P
from quarterlens.operators import score as K
from quarterlens.operators import summary as Q

MEASURES = ["gross_sales", "giv", "nos", "nsrd", "sd", "nos_excl_NIT", "nsrd_excl_nit", "volume_excl_nit_su"]


def _quarter_rows(spark, rows):
    data = [(fy, dt.date(fy, 10, 1), key, *([float(v)] * len(MEASURES))) for key, fy, v in rows]
    return spark.createDataFrame(data, ["fiscal_year", "quarter", "team", *MEASURES])


def test_w2_gap_rule(spark):
    df = _quarter_rows(spark, [("a", 2023, 10), ("a", 2025, 30), ("b", 2023, 1), ("b", 2024, 2), ("b", 2025, 4)])
    out = {(r.team, r.fiscal_year): r.variation_rate_gs
           for r in Q.group_summary(df, "team", [2023, 2024, 2025]).collect()}
    assert out[("a", 2025)] is None
    assert out[("b", 2024)] == 200.0 and out[("b", 2025)] == 200.0
    assert out[("a", 2023)] is None


def test_a4_tie_picks_first_channel_team(spark):
    df = spark.createDataFrame([("1", "A", "y", 5.0), ("1", "B", "x", 5.0), ("1", "C", "z", 1.0)],
                               "optima_id string, channel string, team string, giv_lc double")
    best = M.best_channel_team(df).first()
    assert (best.best_channel, best.best_team) == ("A", "y")


def test_p4_keeps_missing_customer(spark):
    cols = ["time_id", "corp_cust_id", "prod_id"] + [
        "giv_lc", "gs_lc", "nit_lc", "nos_lc", "nsrd_manual_input_lc", "nsrd_sap_lc", "nsrd_tie_out_lc",
        "nsrd_total_lc", "sd_live_rates_lc", "sd_manual_input_lc", "sd_total_lc", "sd_tpr_lc",
        "volume_excl_nit_su", "volume_nit_su", "volume_su"]
    rows = [("202401", None, "p", *([1.0] * 15)), ("202401", "xDummy1", "p", *([1.0] * 15)),
            ("202401", "dummy", "p", *([1.0] * 15))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if i < 3 else 'double'}" for i, c in enumerate(cols)))
    kept = [r.cust_id for r in P.prepare_report(df).collect()]
    assert sorted(kept, key=str) == sorted([None, "dummy"], key=str)


def test_a1_first_non_missing(spark):
    df = spark.createDataFrame([("g", None, 1), ("g", "a", 2), ("g", "b", 3)], "k string, v string, _row long")
    assert P.first_non_missing(df, ["k"], ["v"]).first().v == "a"


def test_a7_drops_missing_keys(spark):
    base = {"fiscal_year": 2024, "quarter": dt.date(2024, 10, 1), "category_smo": "S", "customer": "c",
            "channel": "x", "team": "t", "gs_lc": 1.0, "giv_lc": 1.0, "nos_lc": 1.0, "nsrd_total_lc": 1.0,
            "nit_lc": 0.0, "sd_total_lc": 1.0, "nos_excl_NIT": 1.0, "nsrd_excl_nit": 1.0,
            "volume_excl_nit_su": 1.0}
    rows = [dict(base), dict(base, category_smo=None), dict(base, channel=None)]
    df = spark.createDataFrame(rows)
    out = M.quarterly_format(df).collect()
    assert len(out) == 1 and out[0].gross_sales == 1.0


def test_a22_edge_scores(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,)], "SCORE double")
    default = {r.band: r["count"] for r in K.score_ranges(df).collect()}
    strict = {r.band: r["count"] for r in K.score_ranges(df, strict=True).collect()}
    assert default[0] == 1 and default[9] == 2 and sum(default.values()) == 3
    assert strict[9] == 1 and sum(strict.values()) == 2


def test_missing_index_gives_missing_score(spark):
    nat = spark.createDataFrame([(2025, dt.date(2025, 10, 1), 90.0, 10.0, 110.0, 105.0)],
                                "fiscal_year int, quarter date, rate_nos double, nos_su double, "
                                "variation_rate_volume double, variation_rate_nos double")
    ent = spark.createDataFrame([("a", 2025, dt.date(2025, 10, 1), 100.0, 95.0, 11.0, None, 120.0),
                                 ("b", 2025, dt.date(2025, 10, 1), 100.0, 85.0, 9.0, 100.0, 90.0)],
                                "team string, fiscal_year int, quarter date, nos double, rate_nos double, "
                                "nos_su double, variation_rate_volume double, variation_rate_nos double")
    out = {r.team: r.SCORE for r in K.score(nat, ent, ["team"], 2025).collect()}
    assert out["a"] is None and out["b"] == 10.0


def test_constant_column_correlation_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    rows = {r.variable: r for r in EX.correlation(df, ["a", "b"]).collect()}
    assert rows["a"]["b"] is None and rows["b"]["b"] == 1.0


def test_a25_histogram_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "anomaly_score double")
    bins = {r.bin: r["count"] for r in AN.score_histogram(df, 10).collect()}
    assert bins[1] == 2 and bins[10] == 1 and sum(bins.values()) == 3
