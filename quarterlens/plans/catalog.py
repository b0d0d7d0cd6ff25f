"""Registered queries: name -> (Spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import table_folder
from ..operators import merge as M
from ..operators import prepare as P
from ..operators import score as K
from ..operators import summary as Q
from ..session import ship_package
from ..sources import readers as R
from ..sources import schemas as S
from . import oracle as O
from . import pipeline as PL

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


_MEMO: dict = {}


_SHARED = False


@contextmanager
def shared_tables():
    """Within this context queries share the tables that they have in common."""
    global _SHARED
    _MEMO.clear()
    _SHARED = True
    try:
        yield
    finally:
        _SHARED = False
        _MEMO.clear()


def register(name: str, sql: str | None = None):
    """Register a query; outside ``shared_tables`` each call starts with an empty memo of shared tables."""
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            if not _SHARED:
                _MEMO.clear()
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all():
    # importing registers the remaining query families
    from . import catalog_explore, catalog_models, catalog_rules  # noqa: F401


def _inputs(spark, sf_dir):
    return PL.fixture_inputs(spark, sf_dir)


def _merged(spark, sf_dir):
    return PL.merged(_inputs(spark, sf_dir))


def final_table(spark, sf_dir):
    """E2 output over all quarters, for queries that read it once."""
    return PL.final_table(_inputs(spark, sf_dir))


def final_in_scope(spark, sf_dir):
    """The run's quarters of it, checkpointed once per query build and shared by its branches."""
    key = ("final", spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = PL.final_in_scope(_inputs(spark, sf_dir))
    return _MEMO[key]


# ------------------------------------------------------------ preparation
@register("prep_report", O.with_prefix("SELECT * FROM report"))
def q_prep_report(spark, sf_dir):
    return PL.prepare(_inputs(spark, sf_dir)).report


@register("prep_customer", O.with_prefix("SELECT * FROM customers"))
def q_prep_customer(spark, sf_dir):
    return PL.prepare(_inputs(spark, sf_dir)).customers


@register("prep_product", O.with_prefix("SELECT * FROM products"))
def q_prep_product(spark, sf_dir):
    return PL.prepare(_inputs(spark, sf_dir)).products


@register("category_dictionary", O.with_prefix("SELECT * FROM dict"))
def q_dictionary(spark, sf_dir):
    return _inputs(spark, sf_dir).dictionary


# The same landing tables by way of CSV files whose headers differ in their order.
def _as_csv(df, columns, order=None, encoding="UTF-8"):
    base = table_folder(df)
    if order is None:
        parts = [df.where(F.pmod(F.xxhash64(*columns), F.lit(2)) == k) for k in (0, 1)]
    else:  # files in the order of the rows
        middle = df.agg(F.percentile_approx(order, 0.5)).first()[0]
        parts = [d.repartitionByRange(order).sortWithinPartitions(order)
                 for d in (df.where(F.col(order) <= middle), df.where(F.col(order) > middle))]
    paths = [f"{base}/first", f"{base}/second"]
    for path, part, cols in zip(paths, parts, (columns, columns[::-1])):
        part.select(*cols).write.options(header=True, encoding=encoding, ignoreLeadingWhiteSpace=False,
                                         ignoreTrailingWhiteSpace=False).csv(path)
    return paths


@register("prep_report_csv", O.with_prefix("SELECT * FROM report"))
def q_prep_report_csv(spark, sf_dir):
    raw = _inputs(spark, sf_dir).report_raw
    return P.prepare_report(R.read_reports(spark, _as_csv(raw, S.REPORT_ID_COLUMNS + S.REPORT_MEASURES), "csv"))


@register("prep_customer_csv", O.with_prefix("SELECT * FROM customers"))
def q_prep_customer_csv(spark, sf_dir):
    paths = _as_csv(_inputs(spark, sf_dir).customer_raw, S.CUSTOMER_RAW_COLUMNS, R.ROW_ORDER, "ISO-8859-1")
    return P.prepare_customer(R.read_customer_master(spark, paths), PL.DEFAULT_RUN.country)


@register("prep_product_csv", O.with_prefix("SELECT * FROM products"))
def q_prep_product_csv(spark, sf_dir):
    paths = _as_csv(_inputs(spark, sf_dir).product_raw, S.PRODUCT_RAW_COLUMNS, R.ROW_ORDER)
    return P.prepare_product(R.read_product_master(spark, paths))


@register("category_dictionary_csv", O.with_prefix("SELECT * FROM dict"))
def q_dictionary_csv(spark, sf_dir):
    return R.read_category_dictionary(spark, _as_csv(_inputs(spark, sf_dir).dictionary, S.DICTIONARY_COLUMNS))


# ------------------------------------------------------------------ merge
def _matched_parts(spark, sf_dir):
    p = PL.prepare(_inputs(spark, sf_dir))
    cm, cu = M.merge_customers(p.report, p.customers)
    pm, pu = M.merge_products(cm, p.products)
    return p, cm, cu, pm, pu


@register("customer_match", O.with_prefix("SELECT * FROM cust_matched"))
def q_customer_match(spark, sf_dir):
    return _matched_parts(spark, sf_dir)[1]


@register("customer_unmatched", O.with_prefix("SELECT * FROM cust_unmatched"))
def q_customer_unmatched(spark, sf_dir):
    return _matched_parts(spark, sf_dir)[2]


@register("product_match", O.with_prefix("SELECT * FROM prod_matched"))
def q_product_match(spark, sf_dir):
    return _matched_parts(spark, sf_dir)[3]


@register("product_unmatched", O.with_prefix("SELECT * FROM prod_unmatched"))
def q_product_unmatched(spark, sf_dir):
    return _matched_parts(spark, sf_dir)[4]


@register("missing_channel_team", O.with_prefix(
    f"SELECT cust_id, optima_id, optima_name, channel, team, time_id, {O.dsum('giv_lc')} AS giv_lc "
    "FROM prod_matched GROUP BY cust_id, optima_id, optima_name, channel, team, time_id "
    "HAVING channel IS NULL OR team IS NULL"))
def q_missing_channel_team(spark, sf_dir):
    return _merged(spark, sf_dir).missing_channel_team


@register("best_channel_team", O.with_prefix("SELECT * FROM best"))
def q_best_channel_team(spark, sf_dir):
    p, cm, cu, pm, pu = _matched_parts(spark, sf_dir)
    return M.best_channel_team(M.fill_channel_team(pm))


def _name_quality_sql(source: str) -> str:
    return f"""
SELECT c.optima_id, c.n_names, c.names, c.n_cust_ids, c.cust_ids, r.n_rows,
  coalesce(c.channels, 'N/A') AS channels, coalesce(c.teams, 'N/A') AS teams
FROM (
  SELECT optima_id, count(DISTINCT optima_name) AS n_names,
    coalesce(string_agg(DISTINCT optima_name, ' | ' ORDER BY optima_name), '') AS names,
    count(DISTINCT cust_id) AS n_cust_ids,
    coalesce(string_agg(DISTINCT cust_id, ', ' ORDER BY cust_id), '') AS cust_ids,
    string_agg(DISTINCT channel, ', ' ORDER BY channel) AS channels,
    string_agg(DISTINCT team, ', ' ORDER BY team) AS teams
  FROM {source} WHERE optima_id IS NOT NULL GROUP BY optima_id
  HAVING count(DISTINCT optima_name) > 1) c
JOIN (SELECT optima_id, count(*) AS n_rows FROM {source} WHERE optima_id IS NOT NULL GROUP BY optima_id) r
ON c.optima_id = r.optima_id"""


@register("name_quality", O.with_prefix(_name_quality_sql("assigned")))
def q_name_quality(spark, sf_dir):
    return _merged(spark, sf_dir).name_quality_after


@register("name_quality_matched", O.with_prefix(_name_quality_sql("cust_matched")))
def q_name_quality_matched(spark, sf_dir):
    return _merged(spark, sf_dir).name_quality_before


@register("missing_product", O.with_prefix(
    "SELECT * FROM assigned WHERE corporate_item_gtin IS NULL OR corporate_product_name IS NULL "
    "OR corporate_brand_name IS NULL OR corporate_category_name IS NULL OR corporate_sub_sector_name IS NULL"))
def q_missing_product(spark, sf_dir):
    return _merged(spark, sf_dir).missing_product


@register("final_aggregation", O.with_prefix("SELECT * FROM agg6"))
def q_final_aggregation(spark, sf_dir):
    return _merged(spark, sf_dir).aggregated


@register("unmapped_categories", O.with_prefix(
    "SELECT corporate_category_name, count(*) AS n_rows FROM enriched WHERE category_smo IS NULL "
    "GROUP BY corporate_category_name"))
def q_unmapped(spark, sf_dir):
    return M.unmapped_categories(_merged(spark, sf_dir).enriched)


@register("final_quarterly", O.with_prefix("SELECT * FROM final"))
def q_final_quarterly(spark, sf_dir):
    return final_table(spark, sf_dir)


@register("final_in_scope", O.with_prefix("SELECT * FROM fq"))
def q_final_in_scope(spark, sf_dir):
    return final_in_scope(spark, sf_dir)


# -------------------------------------------------------------- summaries
@register("summary_national", O.with_prefix(O.national_sql()))
def q_summary_national(spark, sf_dir):
    return Q.national_summary(final_in_scope(spark, sf_dir))


def _summary(grain):
    def build(spark, sf_dir):
        return Q.group_summary(final_in_scope(spark, sf_dir), PL.SUMMARY_GRAINS[grain], PL.DEFAULT_RUN.years)
    return build


for _grain, _keys in PL.SUMMARY_GRAINS.items():
    register(f"summary_{_grain}", O.with_prefix(O.group_sql(_keys)))(_summary(_grain))


_ANNUAL_NAT = f"""
SELECT *, {O.rate('nos', 'gross_sales')} AS rate_nos, {O.rate('nsrd', 'gross_sales')} AS rate_nsrd,
  {O.rate('sd', 'gross_sales')} AS rate_sd
FROM (SELECT *, {O.growth('gross_sales', 'lag(gross_sales) OVER w')} AS variation_rate_gs,
    {O.growth('nos', 'lag(nos) OVER w')} AS variation_rate_nos,
    {O.growth('sd', 'lag(sd) OVER w')} AS variation_rate_sd,
    {O.growth('nsrd', 'lag(nsrd) OVER w')} AS variation_rate_nsrd
  FROM (SELECT fiscal_year, {O.dsum('gross_sales')} AS gross_sales, {O.dsum('nos')} AS nos,
          {O.dsum('nsrd')} AS nsrd, {O.dsum('sd')} AS sd FROM final GROUP BY fiscal_year) a
  WINDOW w AS (ORDER BY fiscal_year)) b"""

_ANNUAL_CUST = f"""
SELECT * REPLACE (CAST(fiscal_year AS VARCHAR) AS fiscal_year),
  {O.rate('nos', 'gross_sales')} AS rate_nos, {O.rate('nsrd', 'gross_sales')} AS rate_nsrd,
  {O.rate('sd', 'gross_sales')} AS rate_sd
FROM (SELECT *, {O.growth('gross_sales', 'lag(gross_sales) OVER w')} AS growth_rate_gs,
    {O.growth('nos', 'lag(nos) OVER w')} AS growth_rate_nos,
    {O.growth('sd', 'lag(sd) OVER w')} AS growth_rate_sd,
    {O.growth('nsrd', 'lag(nsrd) OVER w')} AS growth_rate_nsrd
  FROM (SELECT fiscal_year, customer, channel, team, {O.dsum('gross_sales')} AS gross_sales,
          {O.dsum('nos')} AS nos, {O.dsum('nsrd')} AS nsrd, {O.dsum('sd')} AS sd
        FROM final GROUP BY fiscal_year, customer, channel, team) a
  WINDOW w AS (PARTITION BY customer, channel, team ORDER BY fiscal_year)) b"""


@register("annual_national", O.with_prefix(_ANNUAL_NAT))
def q_annual_national(spark, sf_dir):
    return Q.annual_national(final_table(spark, sf_dir))


@register("annual_customer", O.with_prefix(_ANNUAL_CUST))
def q_annual_customer(spark, sf_dir):
    return Q.annual_by_group(final_table(spark, sf_dir))


# ----------------------------------------------------------------- scores
def _score(name):
    def build(spark, sf_dir):
        return PL.scores(final_in_scope(spark, sf_dir), which=[name])[name]
    return build


for _name, _dims in PL.SCORE_DIMENSIONS.items():
    register(f"score_{_name}", O.with_prefix(O.score_sql(_dims)))(_score(_name))


def score_ranges_sql(strict: bool = False) -> str:
    if strict:
        band = "CAST(floor(SCORE) AS INTEGER)"
        keep = "SCORE >= 0 AND SCORE < 10"
        hi = "')'"
    else:
        band = "CASE WHEN SCORE = 10.0 THEN 9 ELSE CAST(floor(SCORE) AS INTEGER) END"
        keep = "SCORE >= 0 AND SCORE <= 10"
        hi = "CASE WHEN b.band = 9 THEN ']' ELSE ')' END"
    return f"""
SELECT b.band, '[' || CAST(b.band AS VARCHAR) || ', ' || CAST(b.band + 1 AS VARCHAR) || {hi} AS score_range,
  coalesce(c.count, 0) AS count,
  round_even({O.div('100.0 * coalesce(c.count, 0)', 'sum(coalesce(c.count, 0)) OVER ()')}, 2) AS pct
FROM (SELECT CAST(range AS INTEGER) AS band FROM range(0, 10)) b
LEFT JOIN (SELECT {band} AS band, count(*) AS count FROM ({O.score_sql(PL.SCORE_DIMENSIONS['customer'])}) s
           WHERE SCORE IS NOT NULL AND {keep} GROUP BY 1) c ON b.band = c.band"""


@register("score_ranges", O.with_prefix(score_ranges_sql()))
def q_score_ranges(spark, sf_dir):
    return K.score_ranges(_score("customer")(spark, sf_dir))


@register("score_ranges_strict", O.with_prefix(score_ranges_sql(strict=True)))
def q_score_ranges_strict(spark, sf_dir):
    return K.score_ranges(_score("customer")(spark, sf_dir), strict=True)


# -------------------------------------------------------------- streaming
@register("prep_report_stream", O.with_prefix("SELECT * FROM report"))
def q_prep_report_stream(spark, sf_dir):
    """S1 + E1 incrementally: land the report files, stream-prepare them, read the table."""
    from ..streaming.landing import land_reports
    raw = _inputs(spark, sf_dir).report_raw
    folder = table_folder(raw)
    raw.write.parquet(f"{folder}/landing")
    q = land_reports(spark, f"{folder}/landing", f"{folder}/table", f"{folder}/progress")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/table")
