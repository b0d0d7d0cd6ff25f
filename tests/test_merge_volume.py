"""E2 writes no table between the facts and the quarterly table, and reads what its reader asks for."""

import datetime as dt

from quarterlens.functions import materialize as MZ
from quarterlens.operators import merge as M
from quarterlens.operators import summary as Q
from quarterlens.sources import schemas as S


def _merged(spark):
    def fact(cust, prod, month, giv):
        return (month, cust, prod, *[giv if m == "giv_lc" else 1.0 for m in S.REPORT_MEASURES])

    report = spark.createDataFrame(
        [fact("1", "p", "200001", 5.0), fact("2", "p", "199901", 7.0), fact("2", "q", "200001", 1.0),
         fact("3", "p", "200001", 2.0), fact("4", "p", "200001", 9.0), fact("1", "none", "200001", 99.0)],
        f"time_id string, cust_id string, prod_id string, {', '.join(f'{m} double' for m in S.REPORT_MEASURES)}")
    customers = spark.createDataFrame(
        [("1", "X", "o", "O", "A", "sa", "t", "st"), ("2", "X", "o", "O", None, "sb", "u", "su"),
         ("3", "X", None, None, "B", "sb", "t", "st")],
        "cust_id string, cust_country_name string, optima_id string, optima_name string, channel string, "
        "sub_channel string, team string, sub_team string")
    products = spark.createDataFrame(
        [("p", "g1", "n", "b", "cat", "s"), ("p", "g2", "n", "b", "cat", "s"), ("q", "g1", "n", "b", "cat", "s")],
        "prod_id string, " + ", ".join(f"{c} string" for c in M.PRODUCT_ATTRS))
    dictionary = spark.createDataFrame([("cat", "SMO")], "corporate_category_name string, category_smo string")
    return M.data_merge(report, customers, products, dictionary)


def test_aggregation_without_a_table_in_between(spark):
    before = MZ.marked(spark)
    merged = _merged(spark)
    rows = {(r["optima_id"], r["time_id"], r["corporate_item_gtin"]): (r["channel"], r["team"], r["giv_lc"])
            for r in merged.aggregated.collect()}
    # The pair (OTHERS, U) of customer 2 has the larger GIV over all months, both gtins counted.
    assert rows == {("o", "200001", "g1"): ("OTHERS", "u", 6.0), ("o", "200001", "g2"): ("OTHERS", "u", 5.0),
                    ("o", "199901", "g1"): ("OTHERS", "u", 7.0), ("o", "199901", "g2"): ("OTHERS", "u", 7.0),
                    (None, "200001", "g1"): (None, None, 2.0), (None, "200001", "g2"): (None, None, 2.0)}
    assert MZ.marked(spark) == before


def test_generic_form_gives_the_same_groups(spark):
    merged = _merged(spark)
    filled = M.fill_channel_team(merged._matched)
    plain = M.assigned_aggregation(filled)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, merged.aggregated.select(*plain.columns).collect()))


def test_product_key_stands_for_the_attributes(spark):
    attrs = [("p", "g1", "n", "b", "c", "s"), ("q", "g1", "n", "b", "c", "s"), ("p", "g2", "n", "b", "c", "s"),
             ("p", "g1", "n", None, "c", "s"), ("p", "g1", "n", "b", "c", "s"), ("r", "g1", None, None, "c", None),
             ("r", "g1", None, None, "c", None), ("s", None, "n", "b", "c", "s")]
    df = M.with_product_key(spark.createDataFrame(attrs, "prod_id string, " + ", ".join(f"{c} string" for c in M.PRODUCT_ATTRS)))
    pairs = {(tuple(r[c] for c in M.PRODUCT_ATTRS), (r["corporate_item_gtin"], r["product_key"], r["product_variant"]))
             for r in df.collect()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({k for _, k in pairs}) == 4


def test_final_is_that_of_the_enriched_rows(spark):
    merged = _merged(spark)
    plain = M.quarterly_format(merged.enriched)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, merged.final.collect()))


def test_choice_of_quarters_reaches_the_facts(spark):
    found = Q.filter_quarters(_merged(spark).quarterly, [dt.date(2000, 1, 1)])
    assert [(r["customer"], r["channel"], r["giv"]) for r in found.collect()] == [("o - O", "OTHERS", 11.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    last_sum = max(i for i, line in enumerate(lines) if "Aggregate [optima_id" in line and "time_id" in line)
    assert any("Filter" in line and "trunc" in line and "time_id" in line for line in lines[last_sum:])


def _plain_assigned(merged):
    return M.assign_best_channel_team(M.fill_channel_team(merged._matched))


def test_name_quality_writes_its_counts_alone(spark):
    merged, before = _merged(spark), MZ.marked(spark)
    merged._customers = merged._customers.union(spark.createDataFrame(
        [("4", "X", "o", "O2", "A", "sa", "t", "st")], merged._customers.schema))
    got = merged.name_quality_after.collect()
    assert MZ.marked(spark) == before + 1  # the counts, not the joined rows
    assert [(r["optima_id"], r["names"], r["cust_ids"], r["n_rows"], r["channels"], r["teams"]) for r in got] == [
        ("o", "O | O2", "1, 2, 4", 7, "A", "t")]


def test_missing_product_rows_are_not_written_and_filtered_at_the_master(spark):
    merged, before = _merged(spark), MZ.marked(spark)
    merged._products = merged._products.union(spark.createDataFrame(
        [("q", "g3", "n", None, "cat", "s"), ("p", "g4", None, "b", "cat", None)], merged._products.schema))
    merged._matched = M.merge_products(merged._cust_matched, merged._products)[0]
    found = merged.missing_product
    plain = M.missing_product(_plain_assigned(merged))
    assert found.columns == plain.columns and found.count() == 4
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert MZ.marked(spark) == before
    # The rows meet the customers after the filter on the products.
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Filter" in line and "isnull(corporate_brand_name" in line)
    assert sum("Join" in line for line in lines[:at]) >= 2


def test_quarterly_rows_move_once_for_both_sums(spark):
    """A6 and A7 sum where the rows were dealt; what shares labels, texts or categories comes out as by the written steps."""
    merged = _merged(spark)
    merged._customers = merged._customers.union(spark.createDataFrame(
        [("4", "X", "a - b", "c", "A", "sa", "t", "st"), ("5", "X", "a", "b - c", "A", "sa", "t", "st"),
         ("4", "Y", "o", None, "A", "sa", "t", "st")], merged._customers.schema))
    merged._products = merged._products.union(spark.createDataFrame(
        [("q", "g2", "n", "b", "cat", "s"), ("r", "g9", None, None, "dog", None), ("q", "g9", None, None, "dog", None),
         ("p", "g5", "n", "b", "unmapped", "s")], merged._products.schema))
    merged._dictionary = merged._dictionary.union(spark.createDataFrame([("dog", "SMO"), ("dog", "SMO 2")], merged._dictionary.schema))
    more = [("200002", "5", "r", *[3.0] * 15), (None, "5", "p", *[1.0] * 15), ("200002", "1", "q", *[None] * 15),
            ("200002", "4", "r", *[2.5] * 15)]
    merged._report = merged._report.union(spark.createDataFrame(more, merged._report.schema))
    merged._matched = M.merge_products(M.merge_customers(merged._report, merged._customers)[0], merged._products)[0]
    plain = M.quarterly_format(M.add_category_smo(M.add_calculated_columns(M.assigned_aggregation(
        M.fill_channel_team(merged._matched))), merged._dictionary))
    found = merged.quarterly
    assert found.columns == plain.columns
    assert found.count() >= 5 and sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(customer" in plan and "Exchange hashpartitioning(fiscal_year" not in plan


def test_aggregation_sums_where_rows_meet_their_product(spark):
    """Attributes that several products share, master rows that come twice and missing keys give the groups of the plain form."""
    merged = _merged(spark)
    merged._products = merged._products.union(spark.createDataFrame(
        [("q", "g2", "n", "b", "cat", "s"), ("r", "g9", None, None, None, None), ("q", "g9", None, None, None, None),
         ("r", "g7", "n", None, "cat", "s"), ("r", "g7", "n", None, "cat", "s"), ("r", "g6", "n", None, "cat", "s"), (None, "g8", "n", "b", "cat", "s"),
         ("p", None, "n", "b", "cat", "s")], merged._products.schema))
    more = [("200001", "1", "r", *[3.0] * 15), (None, "2", "p", *[1.0] * 15), ("200001", "1", "q", *[None] * 15),
            ("200001", "1", None, *[2.5] * 15), ("200001", "1", "p", *[1e22] * 15)]
    merged._report = merged._report.union(spark.createDataFrame(more, merged._report.schema))
    merged._matched = M.merge_products(M.merge_customers(merged._report, merged._customers)[0], merged._products)[0]
    plain = M.assigned_aggregation(M.fill_channel_team(merged._matched))
    found = merged.aggregated
    assert found.columns == plain.columns
    rows = sorted(map(repr, found.collect()))
    assert len(rows) == 11 and rows == sorted(map(repr, plain.collect()))
    # The facts move by customer and by product; both parts read one shuffle of them.
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Final Plan =="):plan.index("== Initial Plan ==")]
    by_product = [line for line in plan.splitlines() if "Exchange hashpartitioning(prod_id" in line and "giv_lc" in line
                  or "Exchange hashpartitioning(prod_id" in line and "REPARTITION_BY_COL" in line]
    assert "Union" in plan and len(by_product) == 2 and sum("ReusedExchange" in line for line in by_product) == 1
