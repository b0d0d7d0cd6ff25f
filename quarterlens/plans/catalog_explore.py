"""Exploration queries (A13-A21, A35, P17) on the scored year's customer summary."""

from __future__ import annotations

from ..operators import explore as EX
from ..operators import summary as Q
from . import oracle as O
from . import pipeline as PL
from .catalog import final_in_scope, register

RUN = PL.DEFAULT_RUN
CUSTOMER_DIMS = PL.SCORE_DIMENSIONS["customer"]
RATE_COLUMNS = ["rate_nos", "rate_nsrd", "rate_sd", "nos_su", "variation_rate_nos", "variation_rate_volume"]
CORR_COLUMNS = ["rate_nos", "rate_nsrd", "rate_sd", "nos_su", "variation_rate_nos", "variation_rate_volume"]
HIST_COLUMNS = ["rate_nos", "rate_nsrd", "rate_sd", "nos_su", "variation_rate_nos", "variation_rate_volume"]
GROUP_COLUMNS = ["channel", "team"]


def explore_base(spark, sf_dir):
    """Customer x channel x team summary rows of the scored fiscal year."""
    return Q.filter_fiscal_year(Q.group_summary(final_in_scope(spark, sf_dir), CUSTOMER_DIMS, RUN.years),
                                RUN.score_year)


def explore_category_base(spark, sf_dir):
    return Q.filter_fiscal_year(
        Q.group_summary(final_in_scope(spark, sf_dir), PL.SUMMARY_GRAINS["customer_category"], RUN.years),
        RUN.score_year)


EX_CTE = (f"ex AS (SELECT * FROM ({O.group_sql(CUSTOMER_DIMS)}) e WHERE fiscal_year = {O.SCORE_YEAR}), "
          f"exc AS (SELECT * FROM ({O.group_sql(PL.SUMMARY_GRAINS['customer_category'])}) e "
          f"WHERE fiscal_year = {O.SCORE_YEAR})")


def sql(body: str, extra: str = "") -> str:
    return O.with_prefix(body, EX_CTE + (", " + extra if extra else ""))


def _long_text_sql(src: str, cols, keep=()) -> str:
    k = "".join(f"{c}, " for c in keep)
    return " UNION ALL ".join(f"SELECT {k}'{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {src}"
                              for c in cols)


def _long_num_sql(src: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {src}"
                              for c in cols)


def quantile_sql(src: str, probs) -> str:
    """Exact linear-interpolation quantiles per "column" of a (column, value) table."""
    pos = (f"SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS k, "
           f"count(*) OVER (PARTITION BY \"column\") AS n FROM {src}")
    parts = []
    for p in probs:
        h = f"(CAST(n - 1 AS DOUBLE) * {O.dbl(p)})"
        parts.append(
            f"SELECT \"column\", {O.dbl(p)} AS p, "
            f"max(CASE WHEN k = floor({h}) THEN value END) AS a, "
            f"max(CASE WHEN k = least(floor({h}) + 1, n - 1) THEN value END) AS b, "
            f"max({h} - floor({h})) AS t FROM ({pos}) qp GROUP BY \"column\"")
    body = " UNION ALL ".join(parts)
    return f"SELECT \"column\", p, {O.lerp('a', 'b', 't')} AS q FROM ({body}) qq"


def trimmed_sql(src: str, lower=0.05, upper=0.95) -> str:
    q = quantile_sql(src, [lower, upper])
    return (f"SELECT l.* FROM {src} l JOIN (SELECT \"column\", "
            f"max(CASE WHEN p = {O.dbl(lower)} THEN q END) AS _lo, max(CASE WHEN p = {O.dbl(upper)} THEN q END) AS _hi "
            f"FROM ({q}) q0 GROUP BY \"column\") b ON l.\"column\" = b.\"column\" "
            f"WHERE l.value >= b._lo AND l.value <= b._hi")


# ------------------------------------------------------------------ A13
@register("distinct_counts", sql(
    "SELECT count(DISTINCT customer) AS customer_distinct, count(DISTINCT channel) AS channel_distinct, "
    "count(DISTINCT team) AS team_distinct FROM ex"))
def q_distinct_counts(spark, sf_dir):
    return EX.distinct_counts(explore_base(spark, sf_dir), ["customer", "channel", "team"])


# --------------------------------------------------------------- A14-A17
@register("value_counts", sql(
    f"SELECT \"column\", value, count(*) AS count FROM ({_long_text_sql('ex', GROUP_COLUMNS)}) v "
    "WHERE value IS NOT NULL GROUP BY \"column\", value"))
def q_value_counts(spark, sf_dir):
    return EX.value_counts(explore_base(spark, sf_dir), GROUP_COLUMNS)


@register("customers_by", sql(
    f"SELECT \"column\", value, count(DISTINCT customer) AS n_customers "
    f"FROM ({_long_text_sql('ex', GROUP_COLUMNS, ['customer'])}) v "
    "WHERE value IS NOT NULL GROUP BY \"column\", value"))
def q_customers_by(spark, sf_dir):
    return EX.customers_by(explore_base(spark, sf_dir), GROUP_COLUMNS)


_PER = (lambda src, cols: f"SELECT \"column\", value, {O.dsum('nos_excl_NIT')} AS _sum, "
        f"count(DISTINCT customer) AS n_customers "
        f"FROM ({_long_text_sql(src, cols, ['nos_excl_NIT', 'customer'])}) v "
        "WHERE value IS NOT NULL GROUP BY \"column\", value")


def _share_sql(src, cols):
    return (f"SELECT p.\"column\", p.value, {O.rate('p._sum', 't._total')} AS nos_pct "
            f"FROM ({_PER(src, cols)}) p JOIN (SELECT \"column\", {O.dsum('_sum')} AS _total "
            f"FROM ({_PER(src, cols)}) p2 GROUP BY \"column\") t ON p.\"column\" = t.\"column\"")


def _table_sql(src, cols):
    return (f"SELECT p.\"column\", p.value, p.n_customers, "
            f"round_even({O.rate('p.n_customers', 't._cust_total')}, 1) AS customers_pct, "
            f"round_even({O.rate('p._sum', 't._total')}, 1) AS nos_pct "
            f"FROM ({_PER(src, cols)}) p JOIN (SELECT \"column\", {O.dsum('_sum')} AS _total, "
            f"sum(n_customers) AS _cust_total FROM ({_PER(src, cols)}) p2 GROUP BY \"column\") t "
            f"ON p.\"column\" = t.\"column\"")


@register("nos_share", sql(_share_sql("ex", GROUP_COLUMNS)))
def q_nos_share(spark, sf_dir):
    return EX.nos_share(explore_base(spark, sf_dir), GROUP_COLUMNS)


@register("nos_table", sql(_table_sql("ex", GROUP_COLUMNS)))
def q_nos_table(spark, sf_dir):
    return EX.nos_table(explore_base(spark, sf_dir), GROUP_COLUMNS)


@register("nos_table_category", sql(_table_sql("exc", ["category_smo"])))
def q_nos_table_category(spark, sf_dir):
    return EX.nos_table(explore_category_base(spark, sf_dir), ["category_smo"])


# --------------------------------------------------------------- A20, A21
_SHARES = (f"SELECT c.customer, {O.rate('c._sum', 't._total')} AS nos_pct FROM "
           f"(SELECT customer, {O.dsum('nos_excl_NIT')} AS _sum FROM ex GROUP BY customer) c CROSS JOIN "
           f"(SELECT {O.dsum('_sum')} AS _total FROM (SELECT customer, {O.dsum('nos_excl_NIT')} AS _sum "
           f"FROM ex GROUP BY customer) c2) t")


def _band_case(x: str) -> str:
    edges = EX.SHARE_BINS
    whens = " ".join(f"WHEN {x} >= {O.dbl(float(edges[i]))} AND {x} < {O.dbl(float(edges[i + 1]))} THEN {i}"
                     for i in range(len(edges) - 1))
    return f"CASE {whens} END"


_LABELS = " UNION ALL ".join(f"SELECT {i} AS band, '{lab}' AS label" for i, lab in enumerate(EX.SHARE_LABELS))


@register("share_bands", sql(
    f"SELECT d.band, d.label, CAST(coalesce(c.n_customers, 0) AS BIGINT) AS n_customers FROM ({_LABELS}) d "
    f"LEFT JOIN (SELECT band, count(*) AS n_customers FROM (SELECT {_band_case('nos_pct')} AS band "
    f"FROM ({_SHARES}) s) b WHERE band IS NOT NULL GROUP BY band) c ON d.band = c.band"))
def q_share_bands(spark, sf_dir):
    return EX.share_bands(explore_base(spark, sf_dir))


@register("top_customers", sql(f"SELECT * FROM ({_SHARES}) s ORDER BY nos_pct DESC, customer ASC LIMIT 10"))
def q_top_customers(spark, sf_dir):
    return EX.top_customers(explore_base(spark, sf_dir), 10)


# ---------------------------------------------------------------- A18
def _descriptive_sql(trim: bool) -> str:
    raw = _long_num_sql("ex", RATE_COLUMNS)
    lng = f"SELECT \"column\", {O.finite('value')} AS value FROM ({raw}) r WHERE {O.finite('value')} IS NOT NULL"
    ctes = f"d_raw AS ({raw}), d_lng0 AS ({lng}), "
    ctes += f"d_lng AS ({trimmed_sql('d_lng0')})" if trim else "d_lng AS (SELECT * FROM d_lng0)"
    ctes += (", d_first AS (SELECT \"column\", count(*) AS count, sum(CAST(value AS DECIMAL(38,12))) AS _total, "
             "min(value) AS _min, max(value) AS _max FROM d_lng GROUP BY \"column\"), "
             f"d_first2 AS (SELECT *, {O.div('CAST(_total AS DOUBLE)', 'count')} AS _mean FROM d_first), "
             "d_dev AS (SELECT l.\"column\", sum(CAST((l.value - f._mean) * (l.value - f._mean) AS DECIMAL(38,12))) "
             "AS _ss FROM d_lng l JOIN d_first2 f ON l.\"column\" = f.\"column\" GROUP BY l.\"column\"), "
             f"d_med AS (SELECT \"column\", q AS _median FROM ({quantile_sql('d_lng', [0.5])}) m), "
             "d_orig AS (SELECT \"column\", count(value) AS count_original FROM d_raw GROUP BY \"column\")")
    std = f"CASE WHEN f.count > 1 THEN sqrt({O.div('CAST(d._ss AS DOUBLE)', 'f.count - 1')}) END"
    body = (f"SELECT o.\"column\" AS variable, round_even(f._mean, 2) AS mean, round_even(m._median, 2) AS median, "
            f"round_even({std}, 2) AS std, round_even(f._min, 2) AS min, round_even(f._max, 2) AS max, "
            f"CAST(coalesce(f.count, 0) AS BIGINT) AS count, o.count_original "
            f"FROM d_orig o LEFT JOIN d_first2 f ON o.\"column\" = f.\"column\" "
            f"LEFT JOIN d_dev d ON o.\"column\" = d.\"column\" LEFT JOIN d_med m ON o.\"column\" = m.\"column\"")
    return sql(body, ctes)


@register("descriptive", _descriptive_sql(False))
def q_descriptive(spark, sf_dir):
    return EX.descriptive(explore_base(spark, sf_dir), RATE_COLUMNS)


@register("descriptive_trimmed", _descriptive_sql(True))
def q_descriptive_trimmed(spark, sf_dir):
    return EX.descriptive(explore_base(spark, sf_dir), RATE_COLUMNS, remove_outliers=True)


# ---------------------------------------------------------------- A19
def _cc_sql(cols, keys=()):
    vals = ", ".join(f"{O.finite(f'TRY_CAST({c} AS DOUBLE)')} AS _v_{c}" for c in cols)
    k = "".join(f"{c}, " for c in keys)
    cond = " AND ".join(f"_v_{c} IS NOT NULL" for c in cols)
    return f"SELECT * FROM (SELECT {k}{vals} FROM ex) c WHERE {cond}"


def _pearson_sql(src: str, vals, names) -> str:
    means = ", ".join(f"{O.div(f'CAST(sum(CAST({v} AS DECIMAL(38,12))) AS DOUBLE)', 'count(*)')} AS _m{i}"
                      for i, v in enumerate(vals))
    sums = []
    for a in range(len(vals)):
        for b in range(a, len(vals)):
            sums.append(f"CAST(sum(CAST(({vals[a]} - _m{a}) * ({vals[b]} - _m{b}) AS DECIMAL(38,12))) AS DOUBLE) "
                        f"AS _s{a}_{b}")
    s = f"SELECT {', '.join(sums)} FROM {src} CROSS JOIN (SELECT {means} FROM {src}) m"

    def sname(a, b):
        return f"_s{min(a, b)}_{max(a, b)}"

    def corr(a, b):
        num, den = sname(a, b), f"sqrt({sname(a, a)} * {sname(b, b)})"
        return f"round_even({O.clip(f'CASE WHEN {den} > 0 THEN {num} / {den} END', -1.0, 1.0)}, 3)"

    rows = " UNION ALL ".join(
        f"SELECT '{names[a]}' AS variable, " + ", ".join(f"{corr(a, b)} AS {names[b]}" for b in range(len(vals)))
        + " FROM s" for a in range(len(vals)))
    return f"WITH s AS ({s}) {rows}"


@register("corr_pearson", sql(
    f"SELECT * FROM ({_pearson_sql('cc', [f'_v_{c}' for c in CORR_COLUMNS], CORR_COLUMNS)}) x",
    f"cc AS ({_cc_sql(CORR_COLUMNS)})"))
def q_corr_pearson(spark, sf_dir):
    return EX.correlation(explore_base(spark, sf_dir), CORR_COLUMNS, "pearson")


def _spearman_cte():
    ranks = ", ".join(
        f"CAST(rank() OVER (ORDER BY _v_{c}) - 1 AS DOUBLE) + "
        f"(CAST(count(*) OVER (PARTITION BY _v_{c}) AS DOUBLE) + {O.dbl(1.0)}) / {O.dbl(2.0)} AS _v_{c}"
        for c in CORR_COLUMNS)
    return f"cc AS ({_cc_sql(CORR_COLUMNS, CUSTOMER_DIMS)}), rk AS (SELECT {ranks} FROM cc)"


@register("corr_spearman", sql(
    f"SELECT * FROM ({_pearson_sql('rk', [f'_v_{c}' for c in CORR_COLUMNS], CORR_COLUMNS)}) x",
    _spearman_cte()))
def q_corr_spearman(spark, sf_dir):
    return EX.correlation(explore_base(spark, sf_dir), CORR_COLUMNS, "spearman", keys=CUSTOMER_DIMS)


# ---------------------------------------------------------------- A35
def _histogram_sql(bins: int = 30, src: str = "ex", cols=HIST_COLUMNS, trim: bool = True,
                   extra_ctes: str = "", tail: str = "") -> str:
    raw = _long_num_sql(src, cols)
    ctes = (extra_ctes + f"h_lng0 AS (SELECT \"column\", {O.finite('value')} AS value FROM ({raw}) r "
            f"WHERE {O.finite('value')} IS NOT NULL), "
            + (f"h_lng AS ({trimmed_sql('h_lng0')}), " if trim else "h_lng AS (SELECT * FROM h_lng0), ")
            + "h_rng AS (SELECT \"column\", min(value) AS _lo, max(value) AS _hi FROM h_lng GROUP BY \"column\")")
    idx = (f"CASE WHEN r._hi - r._lo > 0 THEN CAST(least({bins - 1}, floor((l.value - r._lo) * "
           f"({O.dbl(float(bins))} / (r._hi - r._lo)))) AS INTEGER) ELSE 0 END")
    counted = (f"SELECT l.\"column\", {idx} AS bin, count(*) AS count FROM h_lng l JOIN h_rng r "
               f"ON l.\"column\" = r.\"column\" GROUP BY 1, 2")
    body = (f"SELECT r.\"column\", b.bin, r._lo + (r._hi - r._lo) * b.bin / {O.dbl(float(bins))} AS bin_lo, "
            f"r._lo + (r._hi - r._lo) * (b.bin + 1) / {O.dbl(float(bins))} AS bin_hi, "
            f"CAST(coalesce(c.count, 0) AS BIGINT) AS count{tail} "
            f"FROM h_rng r CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, {bins})) b "
            f"LEFT JOIN ({counted}) c ON r.\"column\" = c.\"column\" AND b.bin = c.bin")
    return sql(body, ctes)


@register("histogram_feed", _histogram_sql())
def q_histogram_feed(spark, sf_dir):
    return EX.histogram_feed(explore_base(spark, sf_dir), HIST_COLUMNS)


def _score_histogram_sql(bins: int = 30) -> str:
    sc = (f"sc AS (SELECT * FROM ({O.score_sql(CUSTOMER_DIMS)}) s), "
          f"sc_mean AS (SELECT {O.div('CAST(sum(CAST(SCORE AS DECIMAL(38,18))) AS DOUBLE)', 'count(*)')} "
          "AS mean_score FROM sc WHERE SCORE IS NOT NULL), "
          "sc_long AS (SELECT 'SCORE' AS \"column\", SCORE AS value FROM sc WHERE SCORE IS NOT NULL), "
          f"sc_med AS (SELECT q AS median_score FROM ({quantile_sql('sc_long', [0.5])}) m), ")
    tail = ", (SELECT median_score FROM sc_med) AS median_score, (SELECT mean_score FROM sc_mean) AS mean_score"
    return _histogram_sql(bins, "sc", ["SCORE"], False, sc, tail)


@register("score_histogram", _score_histogram_sql())
def q_score_histogram(spark, sf_dir):
    from ..operators import score as K
    final = final_in_scope(spark, sf_dir)
    scored = K.score(Q.national_summary(final), Q.group_summary(final, CUSTOMER_DIMS, RUN.years),
                     CUSTOMER_DIMS, RUN.score_year)
    return K.score_histogram(scored)


def _kendall_sql() -> str:
    cols = CORR_COLUMNS
    combos = [(a, b) for a in range(len(cols)) for b in range(a + 1, len(cols))]
    aggs = ["count(*) AS n0"]
    for i, (a, b) in enumerate(combos):
        ca, cb = f"_v_{cols[a]}", f"_v_{cols[b]}"
        aggs += [f"sum(sign(p.{ca} - q.{ca}) * sign(p.{cb} - q.{cb})) AS s{i}",
                 f"sum(CASE WHEN p.{ca} = q.{ca} THEN 1 ELSE 0 END) AS ta{i}",
                 f"sum(CASE WHEN p.{cb} = q.{cb} THEN 1 ELSE 0 END) AS tb{i}"]
    ctes = (f"cc AS ({_cc_sql(cols)}), kk AS (SELECT row_number() OVER () AS rid, * FROM cc), "
            f"ks AS (SELECT {', '.join(aggs)} FROM kk p JOIN kk q ON p.rid < q.rid)")
    index = {pair: i for i, pair in enumerate(combos)}

    def cell(a, b):
        if a == b:
            return O.dbl(1.0)
        i = index[(min(a, b), max(a, b))]
        den = f"sqrt(CAST(n0 - ta{i} AS DOUBLE) * CAST(n0 - tb{i} AS DOUBLE))"
        return f"round_even({O.clip(f'CASE WHEN {den} > 0 THEN CAST(s{i} AS DOUBLE) / {den} END', -1.0, 1.0)}, 3)"

    rows = " UNION ALL ".join(
        f"SELECT '{cols[a]}' AS variable, " + ", ".join(f"{cell(a, b)} AS {cols[b]}" for b in range(len(cols)))
        + " FROM ks" for a in range(len(cols)))
    return sql(f"SELECT * FROM ({rows}) x", ctes)


@register("corr_kendall", _kendall_sql())
def q_corr_kendall(spark, sf_dir):
    return EX.correlation(explore_base(spark, sf_dir), CORR_COLUMNS, "kendall")
