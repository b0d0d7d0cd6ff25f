"""Report queries on fixed rules, each with oracle SQL.

Forests and clusterings have no SQL form, but what is reported about them has.
Here the same report operators run over the whole scored table with a fixed
rule in place of the model: the score of ``fixed_rule``, labels by the signs of
the two growth rates, and one experiment per feature subset whose score is the
share of its values outside the fences.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.materialize import cut
from ..operators import anomaly as AN
from ..operators import cluster as CL
from ..operators import prepare as P
from ..operators import report as RP
from ..operators import scale as SC
from ..sources import schemas as S
from . import oracle as O
from .catalog import _inputs, register
from .catalog_explore import quantile_sql
from .catalog_models import (ANOMALY_FEATURES, CLUSTER_FEATURES, KEYS, OUTLIER_FEATURES, _cluster_input_sql,
                             _complete, _fence_ctes, _fences_sql, cluster_input, customer_scores, explain_parts,
                             fixed_rule, msql, test_table)

K = ", ".join(KEYS)
HUNDRED = O.dbl(100.0)


def _scored(spark, sf_dir):
    return cut(fixed_rule(test_table(spark, sf_dir)))


def _percent(part: str, whole: str) -> str:
    return O.div(f"({part}) * {HUNDRED}", whole)


def _mean(c: str, n: str = "count(*)", digits: int = 12) -> str:
    return O.div(f"CAST(sum(CAST({c} AS DECIMAL(38,{digits}))) AS DOUBLE)", n)


EXPLAIN, RULE = explain_parts()  # RULE holds r_flag, the scored table

# ------------------------------------------------------------- A23, A24
METRICS = (
    "m_agg AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE anomaly) AS anomalies_count, "
    "min(anomaly_score) AS score_min, max(anomaly_score) AS score_max, count(anomaly_score) AS scored, "
    f"{_mean('anomaly_score', 'count(anomaly_score)')} AS score_mean FROM r_flag), "
    "m_long AS (SELECT 's' AS \"column\", anomaly_score AS value FROM r_flag WHERE anomaly_score IS NOT NULL), "
    "m_ss AS (SELECT CAST(sum(CAST((anomaly_score - score_mean) * (anomaly_score - score_mean) AS DECIMAL(38,12))) "
    "AS DOUBLE) AS ss FROM r_flag, m_agg), "
    "m_all AS (SELECT total_records, anomalies_count, total_records - anomalies_count AS normal_count, "
    f"{_percent('anomalies_count', 'total_records')} AS anomaly_percentage, "
    f"{_percent('total_records - anomalies_count', 'total_records')} AS normal_percentage, "
    f"score_min, score_max, score_mean, (SELECT q FROM ({quantile_sql('m_long', [0.5])}) z) AS score_median, "
    f"CASE WHEN scored > 1 THEN sqrt({O.div('ss', 'scored - 1')}) END AS score_std FROM m_agg, m_ss)")


@register("rule_metrics", msql("SELECT * FROM m_all", RULE + ", " + METRICS))
def q_metrics(spark, sf_dir):
    """A23."""
    return AN.metrics(_scored(spark, sf_dir))


def _segment_sql(c: str) -> str:
    return (f"SELECT '{c}' AS segment_column, {c} AS segment, count(*) AS total_records, "
            "count(*) FILTER (WHERE anomaly) AS anomalies_count, count(*) FILTER (WHERE NOT anomaly) AS normal_count, "
            f"{_percent('count(*) FILTER (WHERE anomaly)', 'count(*)')} AS anomaly_percentage, "
            "min(anomaly_score) AS score_min, max(anomaly_score) AS score_max, "
            f"{_mean('anomaly_score', 'count(anomaly_score)')} AS score_mean FROM r_flag GROUP BY {c}")


@register("rule_segments", msql(f"{_segment_sql('channel')} UNION ALL {_segment_sql('team')}", RULE))
def q_segments(spark, sf_dir):
    """A24."""
    scored = _scored(spark, sf_dir)
    return AN.segmented(scored, "channel").unionByName(AN.segmented(scored, "team"))


# ------------------------------------------------------------------ A25
def _histogram_sql(bins: int = 10) -> str:
    b = O.dbl(float(bins))
    ctes = (
        "m_long AS (SELECT 's' AS \"column\", anomaly_score AS value FROM r_flag WHERE anomaly_score IS NOT NULL), "
        "h AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM m_long), "
        f"h_p AS (SELECT q AS threshold FROM ({quantile_sql('m_long', [0.95])}) z), "
        f"h_c AS (SELECT CASE WHEN (hi - lo) / {b} > 0 THEN CAST(greatest(1, least({bins}, "
        f"ceil((value - lo) / ((hi - lo) / {b})))) AS INTEGER) ELSE 1 END AS bin, count(*) AS c FROM m_long, h GROUP BY 1), "
        "h_h AS (SELECT count(*) FILTER (WHERE value >= threshold) AS high_score_count FROM m_long, h_p)")
    return msql(
        f"SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i = 1 THEN lo - (hi - lo) * {O.dbl(0.001)} "
        f"ELSE lo + (i - 1) * (hi - lo) / {b} END AS bin_lo, lo + i * (hi - lo) / {b} AS bin_hi, "
        "coalesce(c, 0) AS count, threshold, high_score_count, "
        f"{_percent('high_score_count', 'n')} AS high_score_percentage, n AS total_scores "
        f"FROM range(1, {bins + 1}) t(i) CROSS JOIN h CROSS JOIN h_p CROSS JOIN h_h LEFT JOIN h_c ON h_c.bin = i",
        RULE + ", " + ctes)


@register("rule_histogram", _histogram_sql())
def q_histogram(spark, sf_dir):
    """A25."""
    return AN.score_histogram(_scored(spark, sf_dir))


# ------------------------------------------------------- A26, A28, M4 text
FREQUENCY = "e_all AS ({}), e_freq AS ({})".format(EXPLAIN, " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f}_status IN ('bajo', 'alto')) AS n_anomalies_outlier FROM e_all"
    for f in ANOMALY_FEATURES))


@register("rule_outlier_frequency", msql("SELECT * FROM e_freq", RULE + ", " + FREQUENCY))
def q_outlier_frequency(spark, sf_dir):
    """A28."""
    return AN.outlier_frequency(AN.explain(_scored(spark, sf_dir), ANOMALY_FEATURES, KEYS), ANOMALY_FEATURES)


@register("rule_report", msql(
    "SELECT m.*, e.*, t.* FROM m_all m, (SELECT count(*) AS explained_anomalies, avg(outlier_count) AS avg_outlier_count, "
    "max(outlier_count) AS max_outlier_count FROM e_all) e, (SELECT feature AS top_outlier_feature, "
    "n_anomalies_outlier AS top_outlier_count FROM e_freq ORDER BY n_anomalies_outlier DESC, feature LIMIT 1) t",
    ", ".join([RULE, METRICS, FREQUENCY])))
def q_report(spark, sf_dir):
    """A26."""
    scored = _scored(spark, sf_dir)
    return AN.combined_report(scored, AN.explain(scored, ANOMALY_FEATURES, KEYS), ANOMALY_FEATURES)


def _text_sql() -> str:
    def three(x):
        return f"printf('%.3f', round_even({x}, 3) + 0.0)"

    parts, outside = [], []
    for f in ANOMALY_FEATURES:
        lo, hi = (f"(SELECT {side} FROM f_fences WHERE feature = '{f}')" for side in ("lower", "upper"))
        parts.append(f"CASE WHEN {f} < {lo} THEN '{f}: ' || {three(f)} || ' < ' || {three(lo)} || ' (low)' "
                     f"WHEN {f} > {hi} THEN '{f}: ' || {three(f)} || ' > ' || {three(hi)} || ' (high)' END")
        outside.append(f"CASE WHEN {f} < {lo} OR {f} > {hi} THEN 1 ELSE 0 END")
    return msql(f"SELECT {K}, CAST({' + '.join(outside)} AS INTEGER) AS n_outlier_features, "
                f"coalesce(nullif(concat_ws('; ', {', '.join(parts)}), ''), 'No obvious outliers') AS explanation "
                "FROM r_flag", RULE)


@register("explain_rows", _text_sql())
def q_explain_rows(spark, sf_dir):
    """M4, single-row text form, for every row."""
    return AN.explain_rows(test_table(spark, sf_dir), ANOMALY_FEATURES, KEYS)


# ------------------------------------------------- A29, A30, M8 and T4
SUBSETS = AN.feature_subsets(ANOMALY_FEATURES)


def _experiments_ctes() -> str:
    def outside(f):
        lo, hi = (f"(SELECT {side} FROM f_fences WHERE feature = '{f}')" for side in ("lower", "upper"))
        return f"count(*) FILTER (WHERE {f} < {lo} OR {f} > {hi}) AS {f}"

    rows = " UNION ALL ".join(
        f"SELECT {i} AS subset, '{', '.join(fs)}' AS features, {len(fs)} AS n_features, 100 AS n_estimators, "
        f"{O.dbl(0.05)} AS contamination, 'auto' AS max_samples, {O.div(' + '.join(fs), f'n * {len(fs)}')} AS mean_score "
        "FROM x_count" for i, fs in enumerate(SUBSETS))
    return (f"{_fence_ctes('m_test', ANOMALY_FEATURES)}, x_count AS (SELECT count(*) AS n, "
            f"{', '.join(outside(f) for f in ANOMALY_FEATURES)} FROM m_test), x_all AS ({rows}), "
            "x_top AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, subset) AS rank FROM x_all)")


EXPERIMENTS = _experiments_ctes()


def _experiments(spark, sf_dir):
    flagged = SC.outlier_flags(test_table(spark, sf_dir), ANOMALY_FEATURES)
    counts = flagged.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.col(f"_out_{f}"), 1)).alias(f) for f in ANOMALY_FEATURES])
    rows = [F.struct(
        F.lit(i).alias("subset"), F.lit(", ".join(fs)).alias("features"), F.lit(len(fs)).alias("n_features"),
        F.lit(100).alias("n_estimators"), F.lit(0.05).alias("contamination"), F.lit("auto").alias("max_samples"),
        X.ieee_div(sum((F.col(f) for f in fs[1:]), F.col(fs[0])), F.col("n") * F.lit(len(fs))).alias("mean_score"))
        for i, fs in enumerate(SUBSETS)]
    return cut(counts.select(F.inline(F.array(*rows))))


@register("rule_experiments", msql("SELECT * FROM x_all", EXPERIMENTS))
def q_experiments(spark, sf_dir):
    """One experiment per feature subset."""
    return _experiments(spark, sf_dir)


@register("rule_grid_by_size", msql(
    f"SELECT n_features, {_mean('mean_score', digits=18)} AS mean, max(mean_score) AS max, count(*) AS count FROM x_all "
    "GROUP BY n_features", EXPERIMENTS))
def q_grid_by_size(spark, sf_dir):
    """A29."""
    return AN.summary_by_size(_experiments(spark, sf_dir))


@register("rule_top_features", msql(
    "SELECT feature, count(*) AS count FROM (SELECT unnest(string_split(features, ', ')) AS feature FROM x_top "
    "WHERE rank <= 5) u GROUP BY feature", EXPERIMENTS))
def q_top_features(spark, sf_dir):
    """A30."""
    return AN.top_feature_frequency(_experiments(spark, sf_dir), 5)


@register("rule_ranked", msql(
    "SELECT CAST(rank AS INTEGER) AS rank, features AS features_selected, n_features, contamination, n_estimators, "
    "max_samples, round_even(mean_score, 4) AS mean_score FROM x_top WHERE rank <= 10", EXPERIMENTS))
def q_ranked(spark, sf_dir):
    """M8, T4."""
    return AN.ranked_experiments(_experiments(spark, sf_dir), 10)


@register("rule_grid_stats", msql(
    "SELECT count(*) AS total_combinations_evaluated, CAST(min(n_features) AS VARCHAR) || '-' || "
    "CAST(max(n_features) AS VARCHAR) AS feature_range, max(mean_score) AS best_mean_score, "
    "round_even(avg(mean_score), 4) AS mean_mean_score, round_even(stddev_samp(mean_score), 4) AS std_mean_score "
    "FROM x_all", EXPERIMENTS))
def q_grid_stats(spark, sf_dir):
    """M8 statistics."""
    return AN.grid_statistics(_experiments(spark, sf_dir))


# ------------------------------------------------------- J7, A31-A34
LABELS = (f"l_all AS (SELECT *, CAST(1 + CASE WHEN variation_rate_nos >= {HUNDRED} THEN 1 ELSE 0 END "
          f"+ CASE WHEN variation_rate_volume >= {HUNDRED} THEN 2 ELSE 0 END AS BIGINT) AS cluster FROM m_test "
          f"WHERE {_complete(ANOMALY_FEATURES)})")


def _labelled(spark, sf_dir):
    """Complete rows with a label of 1 to 4 by their growth."""
    up = lambda c, n: F.when(F.col(c) >= F.lit(100.0), F.lit(n)).otherwise(F.lit(0))
    label = F.lit(1) + up("variation_rate_nos", 1) + up("variation_rate_volume", 2)
    rows = test_table(spark, sf_dir).dropna(subset=ANOMALY_FEATURES)
    return cut(rows.withColumn("cluster", label.cast("long")))


def _centroids_sql(src: str) -> str:
    means = ", ".join(f"round_even(avg({f}), 4) AS {f}" for f in ANOMALY_FEATURES)
    return f"SELECT cluster, {means}, count(*) AS size FROM {src} GROUP BY cluster"


@register("rule_centroids", msql(_centroids_sql("l_all"), LABELS))
def q_centroids(spark, sf_dir):
    """A31."""
    rows = _labelled(spark, sf_dir)
    return CL.centroids(rows.drop("cluster"), rows.select(*KEYS, "cluster"), KEYS, ANOMALY_FEATURES)


def _profile_ctes() -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS \"column\", {f} AS value FROM l_all" for f in ANOMALY_FEATURES)

    def at(f, p):
        return f"(SELECT q FROM l_q WHERE \"column\" = '{f}' AND p = {O.dbl(p)})"

    scaled = []
    for f in ANOMALY_FEATURES:
        iqr = f"({at(f, 0.75)} - {at(f, 0.25)})"
        scaled.append(f"({f} - {at(f, 0.5)}) / CASE WHEN abs({iqr}) < {O.dbl(SC.ZERO_SCALE)} THEN {O.dbl(1.0)} "
                      f"ELSE {iqr} END AS {f}")
    return (f"{LABELS}, l_long AS ({long}), l_q AS ({quantile_sql('l_long', [0.25, 0.5, 0.75])}), "
            f"l_scaled AS (SELECT cluster, {', '.join(scaled)} FROM l_all)")


@register("rule_profile", msql(_centroids_sql("l_scaled"), _profile_ctes()))
def q_profile(spark, sf_dir):
    """The clusters on robust-scaled features."""
    rows = _labelled(spark, sf_dir)
    scaled = SC.robust_transform(rows, SC.robust_fit(rows, ANOMALY_FEATURES), ANOMALY_FEATURES, prefix="scaled_")
    scaled = scaled.select(*KEYS, *[F.col(f"scaled_{f}").alias(f) for f in ANOMALY_FEATURES])
    return CL.centroids(scaled, rows.select(*KEYS, "cluster"), KEYS, ANOMALY_FEATURES)


@register("rule_cluster_sizes", msql(
    f"SELECT cluster, count(*) AS size, round_even(count(*) * {HUNDRED} / (SELECT count(*) FROM l_all), 1) AS pct "
    "FROM l_all GROUP BY cluster", LABELS))
def q_cluster_sizes(spark, sf_dir):
    """Rows per cluster."""
    return CL.cluster_sizes(_labelled(spark, sf_dir))


@register("rule_top_counts", msql(
    "SELECT kind, value, count(*) AS count, "
    f"round_even(count(*) * {HUNDRED} / (SELECT count(*) FROM t_top), 1) AS pct FROM ("
    "SELECT 'method' AS kind, method AS value FROM t_top UNION ALL SELECT 'metric', metric FROM t_top) u "
    "GROUP BY kind, value",
    "t_grid AS (SELECT channel AS method, team AS metric, count(*) AS silhouette, "
    "row_number() OVER (ORDER BY channel, team) AS experiment FROM m_test GROUP BY channel, team), "
    "t_top AS (SELECT * FROM t_grid ORDER BY silhouette DESC, experiment LIMIT 10)"))
def q_top_counts(spark, sf_dir):
    """Values among the ten best experiments; every (channel, team) stands for one, its rows for the score."""
    grid = test_table(spark, sf_dir).groupBy(F.col("channel").alias("method"), F.col("team").alias("metric")).agg(
        F.count(F.lit(1)).alias("silhouette"))
    grid = grid.withColumn("experiment", F.row_number().over(Window.orderBy("method", "metric")))
    return CL.top_experiment_counts(grid, 10)


def _on(side: str) -> str:
    return " AND ".join(f"t.{k} = {side}.{k}" for k in KEYS)


FINAL = (f"{RULE}, {LABELS}, r_report AS (SELECT {', '.join(f't.{c}' for c in [*KEYS, *RP.BASE_COLUMNS])}, s.SCORE, "
         f"r.anomaly, r.anomaly_score, l.cluster FROM m_test t LEFT JOIN ({O.score_sql(KEYS)}) s ON {_on('s')} "
         f"LEFT JOIN r_flag r ON {_on('r')} LEFT JOIN l_all l ON {_on('l')})")


def _final_report(spark, sf_dir):
    return RP.final_report(test_table(spark, sf_dir), cut(customer_scores(spark, sf_dir)), _scored(spark, sf_dir),
                           _labelled(spark, sf_dir), KEYS)


@register("rule_final_report", msql("SELECT * FROM r_report", FINAL))
def q_final_report(spark, sf_dir):
    """J7."""
    return _final_report(spark, sf_dir)


def _coverage_sql() -> str:
    missing, nothing = [], []
    for name, c in (("score", "SCORE"), ("anomaly", "anomaly"), ("cluster", "cluster")):
        gone = f"count(*) FILTER (WHERE {c} IS NULL)"
        missing.append(f"{gone} AS missing_{name}, {_percent(gone, 'count(*)')} AS missing_{name}_pct")
        nothing.append(f"CAST(NULL AS BIGINT) AS missing_{name}, CAST(NULL AS DOUBLE) AS missing_{name}_pct")
    rate = _percent("count(*) FILTER (WHERE anomaly)", "count(anomaly)")
    share = _percent("count(*)", "(SELECT count(*) FROM r_report)")
    return msql(
        f"SELECT 'summary' AS kind, CAST(NULL AS BIGINT) AS cluster, count(*) AS rows, {', '.join(missing)}, "
        f"{rate} AS anomaly_rate_pct, CAST(NULL AS DOUBLE) AS share_pct FROM r_report UNION ALL "
        f"SELECT 'cluster', cluster, count(*), {', '.join(nothing)}, NULL, {share} FROM r_report GROUP BY cluster", FINAL)


@register("rule_coverage", _coverage_sql())
def q_coverage(spark, sf_dir):
    """A34."""
    return RP.coverage(cut(_final_report(spark, sf_dir)))


# ------------------------------------------------------------------ P18
def _filter_ctes() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM c_in" for c in OUTLIER_FEATURES)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, lower, upper, count(*) FILTER (WHERE {f} < lower OR {f} > upper) AS count "
        f"FROM c_in, f_fences WHERE feature = '{f}' GROUP BY lower, upper" for f in OUTLIER_FEATURES)
    out = " OR ".join(f"{f} {op} (SELECT {side} FROM f_fences WHERE feature = '{f}')"
                      for f in OUTLIER_FEATURES for op, side in (("<", "lower"), (">", "upper")))
    return (f"{_cluster_input_sql()}, f_long AS ({long}), f_fences AS ({_fences_sql('c_in', OUTLIER_FEATURES)}), "
            f"o_rows AS ({rows}), o_flag AS (SELECT ({out}) AS removed FROM c_in)")


@register("iqr_filter_report", msql(
    "SELECT count(*) AS original_size, count(*) FILTER (WHERE NOT removed) AS filtered_size, "
    f"count(*) FILTER (WHERE removed) AS removed_count, {_percent('count(*) FILTER (WHERE removed)', 'count(*)')} "
    "AS removed_pct FROM o_flag", _filter_ctes()))
def q_filter_report(spark, sf_dir):
    """Sizes before and after."""
    return SC.iqr_filter(cut(cluster_input(spark, sf_dir)), CLUSTER_FEATURES, 1.5, 1, ["SCORE"]).report


@register("iqr_filter_details", msql("SELECT * FROM o_rows WHERE count > 0", _filter_ctes()))
def q_filter_details(spark, sf_dir):
    """Outliers and fences per feature."""
    return SC.iqr_filter(cut(cluster_input(spark, sf_dir)), CLUSTER_FEATURES, 1.5, 1, ["SCORE"]).details


# ------------------------------------------------------- A13, P5, P6
@register("distinct_lists", msql(
    "SELECT DISTINCT 'channel' AS \"column\", channel AS value FROM m_test UNION ALL "
    "SELECT DISTINCT 'team', team FROM m_test"))
def q_distinct_lists(spark, sf_dir):
    """A13 as lists of values."""
    rows = test_table(spark, sf_dir)
    lists = [P.distinct_values(rows, c).select(F.lit(c).alias("column"), F.col(c).alias("value"))
             for c in ("channel", "team")]
    return lists[0].unionByName(lists[1])


@register("prep_product_upper", O.with_prefix("SELECT * REPLACE ({}) FROM products".format(
    ", ".join(f"upper({c}) AS {c}" for c in S.PRODUCT_TEXT_COLUMNS))))
def q_prep_product_upper(spark, sf_dir):
    """P5 on products."""
    return P.prepare_product(_inputs(spark, sf_dir).product_raw, uppercase=True)


@register("prep_customer_country", O.with_prefix(
    "SELECT * FROM customers WHERE cust_country_name = (SELECT upper(min(n_name)) FROM nation)"))
def q_prep_customer_country(spark, sf_dir):
    """Customers of one country."""
    country = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet").agg(F.min("n_name")).first()[0]
    return P.prepare_customer(_inputs(spark, sf_dir).customer_raw, country)
