"""Model queries: scaling, IQR rules, isolation forest, clustering, final report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.materialize import cut
from ..operators import anomaly as AN
from ..operators import scale as SC
from ..operators import summary as Q
from . import oracle as O
from . import pipeline as PL
from .catalog import _MEMO, final_in_scope, register
from .catalog_explore import quantile_sql

RUN = PL.DEFAULT_RUN
KEYS = PL.SCORE_DIMENSIONS["customer"]
# fixed value: the anomaly model's features
ANOMALY_FEATURES = ["rate_nsrd", "rate_sd", "nos_su", "variation_rate_nos", "variation_rate_volume"]


def _customer_summary(spark, sf_dir):
    """The customers' summary, written once per query build: train, test and scored tables follow from it."""
    key = ("customer summary", spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = cut(Q.customer_summary(final_in_scope(spark, sf_dir), RUN.years))
    return _MEMO[key]


def train_table(spark, sf_dir):
    """Prior-year customer rows whose NOS index is present (inf -> missing)."""
    s = _customer_summary(spark, sf_dir)
    t = Q.filter_fiscal_year(s, RUN.train_year).where(F.col("variation_rate_nos").isNotNull())
    return t.withColumns({f: X.finite(f) for f in ANOMALY_FEATURES})


def test_table(spark, sf_dir):
    s = Q.filter_fiscal_year(_customer_summary(spark, sf_dir), RUN.score_year)
    return s.withColumns({f: X.finite(f) for f in ANOMALY_FEATURES})


CUST_SQL = O.group_sql(KEYS)


def _finite_cols(cols):
    return ", ".join(f"{O.finite(c)} AS {c}" for c in cols)


MODEL_CTE = (
    f"m_train AS (SELECT * REPLACE ({_finite_cols(ANOMALY_FEATURES)}) FROM ({CUST_SQL}) c "
    f"WHERE fiscal_year = {O.TRAIN_YEAR} AND variation_rate_nos IS NOT NULL), "
    f"m_test AS (SELECT * REPLACE ({_finite_cols(ANOMALY_FEATURES)}) FROM ({CUST_SQL}) c "
    f"WHERE fiscal_year = {O.SCORE_YEAR})")


def msql(body: str, extra: str = "") -> str:
    return O.with_prefix(body, MODEL_CTE + (", " + extra if extra else ""))


def _long_sql(src, cols, where=""):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {src} {where}" for c in cols)


# ----------------------------------------------------------------- M1
def _complete(cols):
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def _robust_scale_sql():
    ctes = (f"rs_long AS ({_long_sql('m_train', ANOMALY_FEATURES, 'WHERE ' + _complete(ANOMALY_FEATURES))}), "
            f"rs_q AS ({quantile_sql('rs_long', [0.25, 0.5, 0.75])}), "
            "rs_p AS (SELECT \"column\" AS feature, max(CASE WHEN p = 0.5 THEN q END) AS center, "
            "max(CASE WHEN p = 0.75 THEN q END) - max(CASE WHEN p = 0.25 THEN q END) AS iqr FROM rs_q GROUP BY 1), "
            f"rs_s AS (SELECT feature, center, CASE WHEN abs(iqr) < {O.dbl(SC.ZERO_SCALE)} THEN {O.dbl(1.0)} "
            "ELSE iqr END AS scale FROM rs_p)")
    sel = ", ".join(
        f"(t.{f} - (SELECT center FROM rs_s WHERE feature = '{f}')) / (SELECT scale FROM rs_s WHERE feature = '{f}') AS scaled_{f}"
        for f in ANOMALY_FEATURES)
    body = f"SELECT {', '.join('t.' + k for k in KEYS)}, {sel} FROM m_test t WHERE {_complete(['t.' + f for f in ANOMALY_FEATURES])}"
    return msql(body, ctes)


@register("robust_scale", _robust_scale_sql())
def q_robust_scale(spark, sf_dir):
    train = train_table(spark, sf_dir).dropna(subset=ANOMALY_FEATURES)
    test = test_table(spark, sf_dir).dropna(subset=ANOMALY_FEATURES)
    scales = SC.robust_fit(train, ANOMALY_FEATURES)
    out = SC.robust_transform(test, scales, ANOMALY_FEATURES, prefix="scaled_")
    return out.select(*KEYS, *[f"scaled_{f}" for f in ANOMALY_FEATURES])


# ---------------------------------------------------------------- A27
def _fences_sql(src: str, feats, k=1.5) -> str:
    q = quantile_sql("f_long", [0.25, 0.75])
    return (f"SELECT \"column\" AS feature, q1, q3, q3 - q1 AS iqr, q1 - {O.dbl(k)} * (q3 - q1) AS lower, "
            f"q3 + {O.dbl(k)} * (q3 - q1) AS upper FROM (SELECT \"column\", max(CASE WHEN p = 0.25 THEN q END) AS q1, "
            f"max(CASE WHEN p = 0.75 THEN q END) AS q3 FROM ({q}) f0 GROUP BY 1) f1")


def _fence_ctes(src, feats):
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {src} WHERE {c} IS NOT NULL"
                              for c in feats)
    return f"f_long AS ({long}), f_fences AS ({_fences_sql(src, feats)})"


@register("iqr_fences", msql("SELECT * FROM f_fences", _fence_ctes("m_test", ANOMALY_FEATURES)))
def q_iqr_fences(spark, sf_dir):
    return SC.iqr_fences(test_table(spark, sf_dir), ANOMALY_FEATURES)


# ----------------------------------------------------------------- M4
def fixed_rule(df):
    """A deterministic stand-in for model output: |NOS index - 100| / 100 - 0.5."""
    score = F.abs(F.col("variation_rate_nos") - F.lit(100.0)) / F.lit(100.0) - F.lit(0.5)
    return df.withColumns({"anomaly_score": score,
                           "anomaly": F.coalesce(score > F.lit(0.0), F.lit(False))})


def explain_parts():
    """(SELECT of the explanations, its CTEs) on the fixed rule."""
    f_ctes = _fence_ctes("r_rule", ANOMALY_FEATURES)
    rule = (f"r_rule AS (SELECT *, abs(variation_rate_nos - {O.dbl(100.0)}) / {O.dbl(100.0)} - {O.dbl(0.5)} "
            "AS anomaly_score FROM m_test), "
            "r_flag AS (SELECT *, coalesce(anomaly_score > 0, false) AS anomaly FROM r_rule), ")
    med = f"r_med AS (SELECT \"column\" AS feature, q AS median FROM ({quantile_sql('f_long', [0.5])}) m)"
    cols, outs = [], []
    for f in ANOMALY_FEATURES:
        lo = f"(SELECT lower FROM f_fences WHERE feature = '{f}')"
        hi = f"(SELECT upper FROM f_fences WHERE feature = '{f}')"
        st = (f"CASE WHEN {f} IS NULL THEN 'N/A' WHEN {f} < {lo} THEN 'bajo' WHEN {f} > {hi} THEN 'alto' "
              f"ELSE 'normal' END")
        cols += [f, f"(SELECT median FROM r_med WHERE feature = '{f}') AS median_{f}", f"{st} AS {f}_status"]
        outs.append(f"CASE WHEN {f}_status IN ('bajo', 'alto') THEN 1 ELSE 0 END")
    inner = f"SELECT {', '.join(KEYS)}, anomaly_score, {', '.join(cols)} FROM r_flag WHERE anomaly"
    names = " || ".join(
        f"CASE WHEN {f}_status IN ('bajo', 'alto') THEN '{f}' || ', ' ELSE '' END" for f in ANOMALY_FEATURES)
    cnt = " + ".join(outs)
    body = (f"SELECT *, CASE WHEN outlier_count > 0 THEN 'outlier en ' || CAST(outlier_count AS VARCHAR) || "
            f"' variables: ' || rtrim(_names, ', ') ELSE 'sin outliers claros' END AS outlier_variables "
            f"FROM (SELECT *, CAST({cnt} AS INTEGER) AS outlier_count, {names} AS _names FROM ({inner}) i) j")
    return f"SELECT * EXCLUDE (_names) FROM ({body}) k", rule + f_ctes + ", " + med


@register("explain", msql(*explain_parts()))
def q_explain(spark, sf_dir):
    scored = fixed_rule(test_table(spark, sf_dir))
    return AN.explain(scored, ANOMALY_FEATURES, KEYS)


# --------------------------------------------------------------- forest
def _grid(spark, sf_dir):
    return AN.grid_search(train_table(spark, sf_dir), test_table(spark, sf_dir), KEYS, ANOMALY_FEATURES)


def _best_model(spark, sf_dir):
    found = AN.complete_analysis(train_table(spark, sf_dir), test_table(spark, sf_dir), KEYS, ANOMALY_FEATURES)
    return found.model, found.predictions


def default_model_result(spark, sf_dir):
    """The reference's default fit: all five features, 100 trees, contamination .05, auto."""
    train, test = train_table(spark, sf_dir), test_table(spark, sf_dir)
    AN.validate_inputs(train, test, ANOMALY_FEATURES)
    model = AN.fit_model(train, KEYS, ANOMALY_FEATURES, 100, 0.05, "auto")
    return model, cut(AN.predict(test, model, KEYS))


@register("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    model, res = default_model_result(spark, sf_dir)
    return res.select(*KEYS, *ANOMALY_FEATURES, "anomaly", "anomaly_score")


@register("anomaly_metrics")
def q_anomaly_metrics(spark, sf_dir):
    return AN.metrics(default_model_result(spark, sf_dir)[1])


@register("anomaly_segments")
def q_anomaly_segments(spark, sf_dir):
    res = default_model_result(spark, sf_dir)[1]
    return AN.segmented(res, "channel").unionByName(AN.segmented(res, "team"))


@register("anomaly_histogram")
def q_anomaly_histogram(spark, sf_dir):
    return AN.score_histogram(default_model_result(spark, sf_dir)[1])


@register("anomaly_explain")
def q_anomaly_explain(spark, sf_dir):
    model, res = default_model_result(spark, sf_dir)
    return AN.explain(res, model.features, KEYS)


@register("anomaly_grid")
def q_anomaly_grid(spark, sf_dir):
    return _grid(spark, sf_dir).experiments


@register("anomaly_best")
def q_anomaly_best(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return g.best_per_subset.select("subset", "features", "n_features", "n_estimators", "contamination",
                                    "max_samples", "mean_score")


@register("anomaly_summary")
def q_anomaly_summary(spark, sf_dir):
    """M7 with the grid-selected model and the national values of the scored year."""
    national = Q.filter_fiscal_year(Q.national_summary(final_in_scope(spark, sf_dir)), RUN.score_year)
    return AN.complete_analysis(train_table(spark, sf_dir), test_table(spark, sf_dir), KEYS, ANOMALY_FEATURES,
                                national=national).summary


# ------------------------------------------------------------ clustering
from ..operators import cluster as CL  # noqa: E402
from ..operators import report as RP  # noqa: E402
from ..operators import score as K  # noqa: E402

# fixed value: the clustering features of the reference job
CLUSTER_FEATURES = ["nos_su", "rate_nsrd", "rate_sd", "variation_rate_nos", "variation_rate_volume", "SCORE"]
OUTLIER_FEATURES = [f for f in CLUSTER_FEATURES if f != "SCORE"]


def customer_scores(spark, sf_dir):
    final = final_in_scope(spark, sf_dir)
    national = Q.national_summary(final)
    entities = _customer_summary(spark, sf_dir)
    return K.score(national, entities, KEYS, RUN.score_year)


def cluster_input(spark, sf_dir):
    """J6 + P16: test-year customer features with their SCORE, complete rows only."""
    test = test_table(spark, sf_dir).select(*KEYS, *OUTLIER_FEATURES)
    sc = customer_scores(spark, sf_dir).select(*KEYS, "SCORE")
    return test.join(sc, KEYS, "left").dropna(subset=CLUSTER_FEATURES)


def _cluster_input_sql():
    return (f"c_in AS (SELECT t.{', t.'.join(KEYS)}, {', '.join('t.' + f for f in OUTLIER_FEATURES)}, s.SCORE "
            f"FROM m_test t LEFT JOIN ({O.score_sql(KEYS)}) s ON "
            + " AND ".join(f"t.{k} = s.{k}" for k in KEYS)
            + f" WHERE {_complete(['t.' + f for f in OUTLIER_FEATURES] + ['s.SCORE'])})")


def _iqr_filter_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM c_in" for c in OUTLIER_FEATURES)
    ctes = (_cluster_input_sql() + f", f_long AS ({long}), f_fences AS ({_fences_sql('c_in', OUTLIER_FEATURES)})")
    cnt = " + ".join(
        f"CASE WHEN {f} < (SELECT lower FROM f_fences WHERE feature = '{f}') OR "
        f"{f} > (SELECT upper FROM f_fences WHERE feature = '{f}') THEN 1 ELSE 0 END" for f in OUTLIER_FEATURES)
    return msql(f"SELECT * FROM c_in WHERE ({cnt}) < 1", ctes)


@register("iqr_filter", _iqr_filter_sql())
def q_iqr_filter(spark, sf_dir):
    data = cluster_input(spark, sf_dir)
    return SC.iqr_filter(data, CLUSTER_FEATURES, 1.5, 1, ["SCORE"]).kept


EMB_DIMS = 64  # all components of the embeddings table


def _silhouette_sql(squared: bool = False):
    xs = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(EMB_DIMS))
    dist = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(EMB_DIMS))
    dist = dist if squared else f"sqrt({dist})"
    return (f"WITH p AS (SELECT vec_id, CAST(label AS BIGINT) AS label, {xs} FROM embeddings), "
            f"d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, {dist} AS dist FROM p a JOIN p b "
            "ON a.vec_id <> b.vec_id), "
            "per AS (SELECT vec_id, la, lb, sum(dist) AS s, count(*) AS c FROM d GROUP BY vec_id, la, lb), "
            "aa AS (SELECT vec_id, s / c AS a FROM per WHERE la = lb), "
            "bb AS (SELECT vec_id, min(s / c) AS b FROM per WHERE la <> lb GROUP BY vec_id), "
            "sil AS (SELECT p.vec_id, CASE WHEN aa.a IS NULL OR bb.b IS NULL THEN 0.0 "
            "ELSE (bb.b - aa.a) / greatest(aa.a, bb.b) END AS s FROM p LEFT JOIN aa ON p.vec_id = aa.vec_id "
            "LEFT JOIN bb ON p.vec_id = bb.vec_id) "
            "SELECT count(*) AS n_points, (SELECT count(DISTINCT label) FROM p) AS n_clusters, "
            "round_even(avg(s), 6) AS silhouette FROM sil")


def _embedded_points(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}")
                                           for i in range(EMB_DIMS)])


@register("silhouette", _silhouette_sql())
def q_silhouette(spark, sf_dir):
    return CL.silhouette(_embedded_points(spark, sf_dir), "vec_id", "label", [f"x{i}" for i in range(EMB_DIMS)])


@register("silhouette_squared", _silhouette_sql(squared=True))
def q_silhouette_squared(spark, sf_dir):
    """C3 on squared distances: one pass for the clusters' moments, one for the rows."""
    return CL.silhouette_squared(_embedded_points(spark, sf_dir), "label", [f"x{i}" for i in range(EMB_DIMS)])


def _clusters(spark, sf_dir):
    key = ("clusters", spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = CL.full_analysis(cluster_input(spark, sf_dir), KEYS, CLUSTER_FEATURES)
    return _MEMO[key]


@register("cluster_winners")
def q_cluster_winners(spark, sf_dir):
    return _clusters(spark, sf_dir).winners


@register("cluster_params")
def q_cluster_params(spark, sf_dir):
    return _clusters(spark, sf_dir).params


@register("cluster_grid")
def q_cluster_grid(spark, sf_dir):
    return _clusters(spark, sf_dir).grid


@register("cluster_labels")
def q_cluster_labels(spark, sf_dir):
    return _clusters(spark, sf_dir).labels


@register("cluster_centroids")
def q_cluster_centroids(spark, sf_dir):
    r = _clusters(spark, sf_dir)
    return CL.centroids(r.clean, r.labels, KEYS, CLUSTER_FEATURES)


@register("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    r = _clusters(spark, sf_dir)
    return CL.centroids(r.scaled, r.labels, KEYS, CLUSTER_FEATURES)


# ---------------------------------------------------------- final report
def _final_report(spark, sf_dir):
    base = test_table(spark, sf_dir)
    scores = customer_scores(spark, sf_dir)
    model, anomalies = _best_model(spark, sf_dir)
    clusters = _clusters(spark, sf_dir).labels
    return RP.final_report(base, scores, anomalies, clusters, KEYS)


@register("final_report")
def q_final_report(spark, sf_dir):
    return _final_report(spark, sf_dir)


@register("report_coverage")
def q_report_coverage(spark, sf_dir):
    return RP.coverage(_final_report(spark, sf_dir))


@register("anomaly_outlier_frequency")
def q_anomaly_outlier_frequency(spark, sf_dir):
    """A28 on the explanations of the default model."""
    model, res = default_model_result(spark, sf_dir)
    return AN.outlier_frequency(AN.explain(res, model.features, KEYS), model.features)


@register("anomaly_grid_by_size")
def q_anomaly_grid_by_size(spark, sf_dir):
    """Best score per subset size."""
    return AN.summary_by_size(_grid(spark, sf_dir).best_per_subset)


@register("anomaly_top_features")
def q_anomaly_top_features(spark, sf_dir):
    """Feature frequency among the five best subsets."""
    return AN.top_feature_frequency(_grid(spark, sf_dir).best_per_subset, 5)


@register("cluster_linkage")
def q_cluster_linkage(spark, sf_dir):
    """Merge table of the tuned model and its colour threshold."""
    r = _clusters(spark, sf_dir)
    return CL.linkage_table(spark, r)


@register("anomaly_ranked")
def q_anomaly_ranked(spark, sf_dir):
    """M8: ranked experiment table (top 10 subsets)."""
    return AN.ranked_experiments(_grid(spark, sf_dir).best_per_subset, 10)


@register("anomaly_grid_stats")
def q_anomaly_grid_stats(spark, sf_dir):
    """M8: statistics of the grid."""
    return AN.grid_statistics(_grid(spark, sf_dir).best_per_subset)


@register("cluster_top_counts")
def q_cluster_top_counts(spark, sf_dir):
    """Methods / metrics among the ten best experiments."""
    return CL.top_experiment_counts(_clusters(spark, sf_dir).grid, 10)


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    """Cluster sizes and shares."""
    return CL.cluster_sizes(_clusters(spark, sf_dir).labels)


@register("anomaly_report")
def q_anomaly_report(spark, sf_dir):
    """Combined metrics and explanation statistics of the default model."""
    model, res = default_model_result(spark, sf_dir)
    return AN.combined_report(res, AN.explain(res, model.features, KEYS), model.features)


@register("anomaly_scales")
def q_anomaly_scales(spark, sf_dir):
    """M9: scaling parameters of the default model."""
    model, _ = default_model_result(spark, sf_dir)
    return AN.scale_table(spark, model)
