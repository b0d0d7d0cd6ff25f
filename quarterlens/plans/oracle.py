"""Equivalent ANSI SQL (DuckDB dialect) for the registered queries.

The SQL restates each step independently of the Spark code: the fixture
mapping, preparation, merge chain, summaries and scores as CTEs over the
pre-registered test tables.  Helpers below spell out the null / infinity
policy (division, NaN, clip) the same way the Spark expressions define it.
"""

from __future__ import annotations

from typing import Sequence


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def nn(x: str) -> str:
    """NaN -> NULL."""
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def div(n: str, d: str) -> str:
    n2, d2 = f"CAST({n} AS DOUBLE)", f"CAST({d} AS DOUBLE)"
    return (f"(CASE WHEN {d2} = 0 THEN (CASE WHEN {n2} > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN {n2} < 0 THEN CAST('-inf' AS DOUBLE) END) ELSE {nn(f'({n2} / {d2})')} END)")


def index100(x: str, prev: str) -> str:
    return nn(f"(({dbl(1.0)} + ({div(x, prev)} - {dbl(1.0)})) * {dbl(100.0)})")


def growth(x: str, prev: str) -> str:
    return nn(f"(({div(x, prev)} - {dbl(1.0)}) * {dbl(100.0)})")


def rate(n: str, d: str) -> str:
    return nn(f"({div(n, d)} * {dbl(100.0)})")


def dsum(x: str) -> str:
    """Exact sum in whole micro-units, NULL over a value beyond 1e26 (same definition as the Spark side)."""
    units = f"TRY_CAST(round_even({x} * {dbl(1e6)}, 0) AS DECIMAL(38,0))"
    return (f"(CASE WHEN NOT coalesce(bool_or(abs({x}) > {dbl(1e26)}), false) "
            f"THEN coalesce(CAST(sum({units}) AS DOUBLE) / {dbl(1e6)}, {dbl(0.0)}) END)")


def clip(x: str, lo: float = -3.0, hi: float = 3.0) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({dbl(lo)}, least({dbl(hi)}, {x})) END)"


def finite(x: str) -> str:
    return f"(CASE WHEN abs({x}) = CAST('inf' AS DOUBLE) THEN NULL ELSE {nn(x)} END)"


def lerp(a: str, b: str, t: str) -> str:
    return (f"(CASE WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * ({dbl(1.0)} - {t}) "
            f"ELSE {a} + ({b} - {a}) * {t} END)")


# ---------------------------------------------------------------- fixture
REPORT_MEASURES = [
    "giv_lc", "gs_lc", "nit_lc", "nos_lc",
    "nsrd_manual_input_lc", "nsrd_sap_lc", "nsrd_tie_out_lc", "nsrd_total_lc",
    "sd_live_rates_lc", "sd_manual_input_lc", "sd_total_lc", "sd_tpr_lc",
    "volume_excl_nit_su", "volume_nit_su", "volume_su",
]

_FIXTURE = f"""
report_raw AS (
  SELECT strftime(l.l_shipdate, '%Y%m') AS time_id,
    CASE WHEN o.o_custkey % 41 = 0 THEN 'Dummy' || CAST(o.o_custkey AS VARCHAR)
         WHEN o.o_custkey % 43 = 0 THEN CAST(o.o_custkey + 1000000000 AS VARCHAR)
         ELSE CAST(o.o_custkey AS VARCHAR) END AS corp_cust_id,
    CASE WHEN l.l_partkey % 37 = 0 THEN CAST(l.l_partkey + 1000000000 AS VARCHAR)
         ELSE CAST(l.l_partkey AS VARCHAR) END AS prod_id,
    l.l_extendedprice * ({dbl(1.0)} + l.l_tax) AS giv_lc,
    l.l_extendedprice AS gs_lc,
    CASE WHEN l.l_returnflag = 'R' THEN {dbl(-0.01)} * l.l_extendedprice ELSE {dbl(0.0)} END AS nit_lc,
    l.l_extendedprice * ({dbl(1.0)} - l.l_discount) AS nos_lc,
    {dbl(0.5)} * (l.l_extendedprice * l.l_tax) AS nsrd_manual_input_lc,
    {dbl(0.3)} * (l.l_extendedprice * l.l_tax) AS nsrd_sap_lc,
    {dbl(0.2)} * (l.l_extendedprice * l.l_tax) AS nsrd_tie_out_lc,
    l.l_extendedprice * l.l_tax AS nsrd_total_lc,
    {dbl(0.5)} * (l.l_extendedprice * l.l_discount) AS sd_live_rates_lc,
    {dbl(0.3)} * (l.l_extendedprice * l.l_discount) AS sd_manual_input_lc,
    l.l_extendedprice * l.l_discount AS sd_total_lc,
    {dbl(0.2)} * (l.l_extendedprice * l.l_discount) AS sd_tpr_lc,
    l.l_quantity AS volume_excl_nit_su,
    CASE WHEN l.l_returnflag = 'R' THEN {dbl(1.0)} ELSE {dbl(0.0)} END AS volume_nit_su,
    l.l_quantity + CASE WHEN l.l_returnflag = 'R' THEN {dbl(1.0)} ELSE {dbl(0.0)} END AS volume_su
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
cust_base AS (
  SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
customer_raw AS (
  SELECT CAST(c_custkey AS VARCHAR) AS corp_cust_898_lvl_9_id,
    CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE upper(n_name) END AS cust_country_name,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS la_cust_channel_name,
    lower(c_mktsegment) AS la_cust_sub_channel_name,
    CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE r_name END AS la_cust_team_name,
    lower(n_name) AS la_cust_sub_team_name,
    CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE CAST(c_custkey - c_custkey % 4 AS VARCHAR) END
      AS la_local_cnosgc_reporting_customer_optima_id,
    CASE WHEN c_custkey % 53 = 0 THEN NULL
         ELSE 'Optima ' || CAST(c_custkey - c_custkey % 4 AS VARCHAR)
              || CASE WHEN c_custkey % 59 = 0 THEN ' B' ELSE '' END END
      AS la_local_cnosgc_reporting_customer_name,
    c_custkey * 2 AS _row
  FROM cust_base
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR),
    CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE upper(n_name) END,
    NULL, NULL, 'Second team', NULL, NULL, NULL, c_custkey * 2 + 1
  FROM cust_base WHERE c_custkey % 61 = 0),
product_raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS corporate_fpc, 'G' || CAST(p_partkey AS VARCHAR) AS corporate_item_gtin,
    p_name AS corporate_product_name,
    CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END AS corporate_brand_name,
    p_type AS corporate_category_name, 'SS' || CAST(p_size % 4 AS VARCHAR) AS corporate_sub_sector_name,
    p_partkey * 2 AS _row
  FROM part
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), 'G' || CAST(p_partkey AS VARCHAR) || '-2', p_name,
    CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END,
    p_type, 'SS' || CAST(p_size % 4 AS VARCHAR), p_partkey * 2 + 1
  FROM part WHERE p_partkey % 29 = 0),
dict AS (
  SELECT corporate_category_name, 'SMO ' || CAST((rk + 1) // 2 AS VARCHAR) AS category_smo
  FROM (SELECT corporate_category_name, dense_rank() OVER (ORDER BY corporate_category_name) AS rk
        FROM (SELECT DISTINCT p_type AS corporate_category_name FROM part)) t
  WHERE rk <= 5)"""


def _first(c: str) -> str:
    return f"arg_min({c}, _row) FILTER (WHERE {c} IS NOT NULL)"


_PREP = f"""
report AS (
  SELECT time_id, corp_cust_id AS cust_id, prod_id, {', '.join(REPORT_MEASURES)}
  FROM report_raw WHERE NOT coalesce(contains(corp_cust_id, 'Dummy'), false)),
customers AS (
  SELECT upper(corp_cust_898_lvl_9_id) AS cust_id, upper(cust_country_name) AS cust_country_name,
    upper({_first('la_cust_channel_name')}) AS channel,
    upper({_first('la_cust_sub_channel_name')}) AS sub_channel,
    upper({_first('la_cust_team_name')}) AS team,
    upper({_first('la_cust_sub_team_name')}) AS sub_team,
    upper({_first('la_local_cnosgc_reporting_customer_optima_id')}) AS optima_id,
    upper({_first('la_local_cnosgc_reporting_customer_name')}) AS optima_name
  FROM customer_raw GROUP BY corp_cust_898_lvl_9_id, cust_country_name),
products AS (
  SELECT corporate_fpc AS prod_id, corporate_item_gtin,
    {_first('corporate_product_name')} AS corporate_product_name,
    {_first('corporate_brand_name')} AS corporate_brand_name,
    {_first('corporate_category_name')} AS corporate_category_name,
    {_first('corporate_sub_sector_name')} AS corporate_sub_sector_name
  FROM product_raw WHERE corporate_fpc IS NOT NULL AND corporate_item_gtin IS NOT NULL
  GROUP BY corporate_fpc, corporate_item_gtin)"""

_A6_KEYS = ["optima_id", "optima_name", "channel", "team", "time_id", "corporate_item_gtin",
            "corporate_product_name", "corporate_brand_name", "corporate_category_name",
            "corporate_sub_sector_name"]

QUARTER_MEASURES = [("giv_lc", "giv"), ("gs_lc", "gross_sales"), ("nit_lc", "nit_lc"),
                    ("nos_lc", "nos"), ("nos_excl_NIT", "nos_excl_NIT"), ("nsrd_total_lc", "nsrd"),
                    ("nsrd_excl_nit", "nsrd_excl_nit"), ("sd_total_lc", "sd"),
                    ("volume_excl_nit_su", "volume_excl_nit_su")]
QUARTER_KEYS = ["fiscal_year", "quarter", "category_smo", "customer", "channel", "team"]
SUMMARY_MEASURES = ["gross_sales", "giv", "nos", "nsrd", "sd", "nos_excl_NIT",
                    "nsrd_excl_nit", "volume_excl_nit_su"]

_MERGE = f"""
j1 AS (
  SELECT r.*, c.cust_country_name, c.channel, c.sub_channel, c.team, c.sub_team, c.optima_id, c.optima_name
  FROM report r LEFT JOIN customers c ON r.cust_id = c.cust_id),
cust_matched AS (SELECT * FROM j1 WHERE cust_country_name IS NOT NULL),
cust_unmatched AS (SELECT * FROM j1 WHERE cust_country_name IS NULL),
j2 AS (
  SELECT m.*, p.corporate_item_gtin, p.corporate_product_name, p.corporate_brand_name,
    p.corporate_category_name, p.corporate_sub_sector_name
  FROM cust_matched m LEFT JOIN products p ON m.prod_id = p.prod_id),
prod_matched AS (SELECT * FROM j2 WHERE corporate_item_gtin IS NOT NULL),
prod_unmatched AS (SELECT * FROM j2 WHERE corporate_item_gtin IS NULL),
filled AS (
  SELECT * REPLACE (coalesce(channel, 'OTHERS') AS channel, coalesce(team, 'OTHERS') AS team)
  FROM prod_matched),
giv_oct AS (
  SELECT optima_id, channel, team, {dsum('giv_lc')} AS giv_lc
  FROM filled WHERE optima_id IS NOT NULL GROUP BY optima_id, channel, team),
best AS (
  SELECT optima_id, channel AS best_channel, team AS best_team FROM (
    SELECT *, row_number() OVER (PARTITION BY optima_id
                                 ORDER BY giv_lc DESC, channel ASC NULLS FIRST, team ASC NULLS FIRST) AS rn
    FROM giv_oct) t WHERE rn = 1),
assigned AS (
  SELECT f.* REPLACE (b.best_channel AS channel, b.best_team AS team)
  FROM filled f LEFT JOIN best b ON f.optima_id = b.optima_id),
agg6 AS (
  SELECT {', '.join(_A6_KEYS)}, {', '.join(f"{dsum(m)} AS {m}" for m in REPORT_MEASURES)}
  FROM assigned GROUP BY {', '.join(_A6_KEYS)}),
calc AS (
  SELECT * REPLACE (CAST(strptime(time_id || '01', '%Y%m%d') AS DATE) AS time_id),
    coalesce(optima_id, 'nan') || ' - ' || coalesce(optima_name, 'nan') AS customer,
    nos_lc + nit_lc AS nos_excl_NIT, nsrd_total_lc - nit_lc AS nsrd_excl_nit
  FROM agg6),
calc2 AS (
  SELECT *, CAST(year(time_id) - CASE WHEN month(time_id) >= 7 THEN 0 ELSE 1 END AS INTEGER) AS fiscal_year,
    CAST(date_trunc('quarter', time_id) AS DATE) AS quarter
  FROM calc),
enriched AS (
  SELECT c.*, d.category_smo FROM calc2 c LEFT JOIN dict d
  ON c.corporate_category_name = d.corporate_category_name),
final AS (
  SELECT {', '.join(QUARTER_KEYS)},
    {', '.join(f"{dsum(src)} AS {dst}" for src, dst in sorted(QUARTER_MEASURES, key=lambda p: p[1]))}
  FROM enriched WHERE {' AND '.join(f"{k} IS NOT NULL" for k in QUARTER_KEYS)}
  GROUP BY {', '.join(QUARTER_KEYS)}),
fq AS (SELECT * FROM final WHERE quarter IN (DATE '1998-10-01', DATE '1999-10-01', DATE '2000-10-01'))"""

PREFIX = "WITH" + _FIXTURE + "," + _PREP + "," + _MERGE

YEARS = (1998, 1999, 2000)
SCORE_YEAR = 2000
TRAIN_YEAR = 1999

INDEX_COLUMNS = [("variation_rate_gs", "gross_sales"), ("variation_rate_nos", "nos_excl_NIT"),
                 ("variation_rate_volume", "volume_excl_nit_su"), ("variation_rate_nos_su", "nos_su"),
                 ("variation_rate_sd", "sd"), ("variation_rate_nsrd", "nsrd_excl_nit")]


def _rates_sql(inner: str) -> str:
    return (f"SELECT *, {nn('(variation_rate_nos - variation_rate_volume)')} AS srm FROM ("
            f"SELECT *, {rate('nos_excl_NIT', 'gross_sales')} AS rate_nos, "
            f"{rate('nsrd_excl_nit', 'gross_sales')} AS rate_nsrd, "
            f"{rate('sd', 'gross_sales')} AS rate_sd FROM ({inner}) r0) r1")


def national_sql(source: str = "fq") -> str:
    g = (f"SELECT fiscal_year, quarter, {', '.join(f'{dsum(m)} AS {m}' for m in SUMMARY_MEASURES)} "
         f"FROM {source} GROUP BY fiscal_year, quarter")
    g = f"SELECT *, {div('nos_excl_NIT', 'volume_excl_nit_su')} AS nos_su FROM ({g}) n0"
    idx = ", ".join(f"{index100(src, f'lag({src}) OVER w')} AS {name}" for name, src in INDEX_COLUMNS)
    g = f"SELECT *, {idx} FROM ({g}) n1 WINDOW w AS (ORDER BY fiscal_year, quarter)"
    return _rates_sql(g)


def group_sql(keys: Sequence[str], source: str = "fq", years=YEARS, with_customers: bool = True) -> str:
    k = ", ".join(keys)
    aggs = ", ".join(f"{dsum(m)} AS {m}" for m in SUMMARY_MEASURES)
    if with_customers and "customer" not in keys:
        aggs += ", count(DISTINCT customer) AS n_customers"
    yrs = ", ".join(str(y) for y in years)
    g = (f"SELECT fiscal_year, quarter, {k}, {aggs} FROM {source} WHERE fiscal_year IN ({yrs}) "
         f"GROUP BY fiscal_year, quarter, {k}")
    g = f"SELECT *, {div('nos_excl_NIT', 'volume_excl_nit_su')} AS nos_su FROM ({g}) g0"
    idx = ", ".join(
        f"CASE WHEN lag(fiscal_year) OVER w >= fiscal_year - 1 THEN {index100(src, f'lag({src}) OVER w')} END AS {name}"
        for name, src in INDEX_COLUMNS)
    g = f"SELECT *, {idx} FROM ({g}) g1 WINDOW w AS (PARTITION BY {k} ORDER BY quarter)"
    return _rates_sql(g)


def _component(v: str, b: str, passthrough: bool, use_abs: bool) -> str:
    diff = f"(CASE WHEN {v} < {dbl(0.0)} THEN {v} ELSE {v} - {b} END)" if passthrough else f"({v} - {b})"
    denom = f"(abs({b}) + {dbl(1e-10)})" if use_abs else f"({b} + {dbl(1e-10)})"
    return clip(div(diff, denom))


def raw_score_sql() -> str:
    s = f"({dbl(0.0)} + {dbl(1.0)} * {_component('rate_nos', 'general_rate_nos', False, False)})"
    s = f"({s} + {dbl(0.8)} * {_component('variation_rate_volume', 'general_growth_volume', True, True)})"
    s = f"({s} + {dbl(0.9)} * {_component('nos_su', 'general_nos_su', True, True)})"
    s = f"({s} + {dbl(0.8)} * {_component('variation_rate_nos', 'general_growth_rate_nos', True, True)})"
    s = f"({s} + CASE WHEN nos < 0 THEN {dbl(-5.0)} ELSE {dbl(0.0)} END)"
    s = f"({s} + CASE WHEN variation_rate_volume < {dbl(0.0)} THEN {dbl(-3.0)} ELSE {dbl(0.0)} END)"
    s = f"({s} + CASE WHEN variation_rate_nos < {dbl(0.0)} THEN {dbl(-3.0)} ELSE {dbl(0.0)} END)"
    return nn(s)


SCORE_OUTPUT = ["rate_nos", "general_rate_nos", "variation_rate_volume", "general_growth_volume",
                "nos_su", "general_nos_su", "variation_rate_nos", "general_growth_rate_nos", "SCORE"]


def score_sql(dims: Sequence[str], year: int = SCORE_YEAR) -> str:
    bench = (f"SELECT rate_nos AS general_rate_nos, nos_su AS general_nos_su, "
             f"variation_rate_volume AS general_growth_volume, variation_rate_nos AS general_growth_rate_nos "
             f"FROM ({national_sql()}) nat WHERE fiscal_year = {year} ORDER BY quarter LIMIT 1")
    ent = f"SELECT * FROM ({group_sql(dims)}) e WHERE fiscal_year = {year}"
    sc = f"SELECT e.*, b.*, {raw_score_sql()} AS _raw FROM ({ent}) e CROSS JOIN ({bench}) b"
    ranked = (f"SELECT *, CASE WHEN _raw IS NULL THEN NULL ELSE "
              f"(CAST(rank() OVER (ORDER BY _raw ASC NULLS LAST) AS DOUBLE) / "
              f"CAST(count(_raw) OVER () AS DOUBLE)) * {dbl(10.0)} END AS SCORE FROM ({sc}) s")
    cols = list(dims) + (["quarter"] if "quarter" not in dims else [])
    cols += [c for c in SCORE_OUTPUT if c not in cols]
    return f"SELECT {', '.join(cols)} FROM ({ranked}) k"


def with_prefix(body: str, extra_ctes: str = "") -> str:
    return PREFIX + (("," + extra_ctes) if extra_ctes else "") + "\n" + body
