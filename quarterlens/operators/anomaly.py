"""Isolation-forest anomaly detection on Spark.

Spark layout of one fit:

* **sampling** - every train row gets, per tree, a priority from a seeded
  hash of its key (``mapInPandas``, vectorised).  A tree's sample is the
  psi valid rows with the smallest priorities: a uniform sample without
  replacement that does not depend on partitioning or task retries.  Rows
  are emitted only below a cut-off sized from the row count; if a tree ends
  up short the cut-off doubles and sampling reruns, so the sample is exact.
* **growing** - ``groupBy(tree).applyInPandas`` grows, for each tree index,
  that tree of every forest of the grid (feature subset x sample size) on
  its candidates; only a few hundred rows per group move.
* **scoring** - forests are packed into flat arrays, broadcast in groups of
  bounded bytes, and rows are scored where they are with NumPy.

Forests differing only in tree count share trees (the first T trees), and
contamination only moves the offset, so a grid of
subsets x {100,200,300} x {.01,.03,.05} x {auto,50,170} needs one forest per
(subset, sample size).  Algorithm: Liu, Ting and Zhou, "Isolation Forest", 2008.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions.materialize import cut
from ..functions.ranking import quantiles_bracketed, quantiles_long
from . import scale as SC

EULER_GAMMA = 0.5772156649015329


def compute_slots(spark, groups: int) -> int:
    """Partitions for a CPU-bound pandas stage: one per group up to 4 per core.

    The count is explicit so adaptive execution keeps it: the input of these
    stages is small in bytes (a few MB) but heavy in Python work, and a
    coalesced single partition would run every group in one task.
    """
    return max(1, min(groups, 4 * spark.sparkContext.defaultParallelism))
MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)
MODEL_BYTES = 64 << 20   # of forests broadcast at once
NODE_BYTES = 32
ROWS_IN_TASK = 2000      # rows that are worth a task of their own when a grid scores them


def avg_path_length(n):
    """c(n): average path length of an unsuccessful BST search (array-friendly)."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) & MASK64
        x = ((x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & MASK64
        x = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & MASK64
        return x ^ (x >> np.uint64(31))


def priorities(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Uniform [0, 1) priority of each row key hash for one tree."""
    base = _splitmix(np.array([(seed << 32) ^ (tree * 0x9E37 + 1)], dtype=np.uint64))[0]
    z = _splitmix(h.astype(np.int64).view(np.uint64) ^ base)
    return (z >> np.uint64(11)).astype(np.float64) * (1.0 / 9007199254740992.0)


# ----------------------------------------------------------------- specs
@dataclass(frozen=True)
class ForestSpec:
    forest: int
    features: tuple
    psi: int                 # effective sample size of every tree
    psi_setting: str         # 'auto' or the requested size, for reporting
    subset: int
    setting_index: int = 0   # position of the setting in the grid (tie-break order)


@dataclass
class ForestFit:
    specs: list
    nodes: DataFrame             # forest, tree, node, feature, threshold, left, right, size, depth
    scales: dict                 # subset -> {feature: (center, scale)}
    n_trees: int
    seed: int
    candidates: DataFrame | None = None  # (tree, prio, row) that the samples were drawn from


def _tree_depth_limit(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def grow_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree as flat arrays (feature -1 marks a leaf); x <= threshold goes left."""
    feats, thrs, lefts, rights, sizes, depths = [], [], [], [], [], []

    def new(size, depth):
        feats.append(-1), thrs.append(0.0), lefts.append(-1), rights.append(-1)
        sizes.append(size), depths.append(depth)
        return len(feats) - 1

    root = new(len(X), 0)
    stack = [(root, np.arange(len(X)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(usable[rng.integers(usable.size)])
        t = float(rng.uniform(lo[f], hi[f]))
        if t >= hi[f]:
            t = float(lo[f])
        go_left = sub[:, f] <= t
        li, ri = idx[go_left], idx[~go_left]
        feats[node], thrs[node] = f, t
        lnode, rnode = new(len(li), depth + 1), new(len(ri), depth + 1)
        lefts[node], rights[node] = lnode, rnode
        stack.append((lnode, li, depth + 1))
        stack.append((rnode, ri, depth + 1))
    return (np.array(feats, dtype=np.int32), np.array(thrs), np.array(lefts, dtype=np.int32),
            np.array(rights, dtype=np.int32), np.array(sizes, dtype=np.int64), np.array(depths, dtype=np.int32))


def path_lengths(X: np.ndarray, tree) -> np.ndarray:
    """Depth of the reached leaf plus c(leaf size), for every row."""
    feat, thr, left, right, size, depth = tree
    node = np.zeros(len(X), dtype=np.int64)
    rows = np.arange(len(X))
    for _ in range(int(depth.max()) + 1 if len(depth) else 1):
        f = feat[node]
        active = f >= 0
        if not active.any():
            break
        fa = np.where(active, f, 0)
        go_left = X[rows, fa] <= thr[node]
        nxt = np.where(go_left, left[node], right[node])
        node = np.where(active, nxt, node)
    return depth[node] + avg_path_length(size[node])


HEAP_DEPTH = 12   # trees up to this depth are scored as complete trees


def heap_tree(tree, depth: int):
    """The tree as a complete one of ``depth`` levels: (feature, threshold, leaf value) by position.

    A leaf above the last level goes on to the left, past thresholds of +inf.
    """
    feat, thr, left, right, size, at = tree
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    value = at + avg_path_length(size)
    stack = [(0, 0, 0)]
    while stack:
        node, pos, level = stack.pop()
        if feat[node] < 0 or level == depth:
            leaf[((pos + 1) << (depth - level)) - 1 - inner] = value[node]
            continue
        feature[pos], threshold[pos] = feat[node], thr[node]
        stack.append((left[node], 2 * pos + 1, level + 1))
        stack.append((right[node], 2 * pos + 2, level + 1))
    return feature, threshold, leaf


def heap_lengths(columns: np.ndarray, tree) -> np.ndarray:
    """``path_lengths`` on a complete tree; ``columns`` has a contiguous row per feature."""
    feature, threshold, leaf = tree
    n = columns.shape[1]
    flat, rows, start = columns.ravel(), np.arange(n), feature * n
    node, at = np.zeros(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    x, t, right = np.empty(n), np.empty(n), np.empty(n, dtype=bool)
    for _ in range(len(leaf).bit_length() - 1):
        np.take(start, node, out=at, mode="clip")
        np.add(at, rows, out=at)
        np.take(flat, at, out=x, mode="clip")
        np.take(threshold, node, out=t, mode="clip")
        np.greater(x, t, out=right)
        np.left_shift(node, 1, out=node)
        np.add(node, 1, out=node)
        np.add(node, right, out=node)
    return leaf[node - len(feature)]


NODE_SCHEMA = T.StructType([
    T.StructField("forest", T.IntegerType()), T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()), T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()), T.StructField("short", T.BooleanType()),
])


def _finite_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """+/-inf -> missing on the model features."""
    return df.withColumns({f: X.finite(F.col(f).cast("double")) for f in features})


def _key_hash(keys: Sequence[str]):
    return F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])


def fit_scales(train: DataFrame, subsets: Sequence[tuple], all_features: Sequence[str]) -> dict:
    """M1 per feature subset, fitted on the rows complete for that subset.

    One distributed quantile pass over (subset, feature, value); the result is
    bounded by (#subsets x #features) and comes back to the driver as the
    model's parameters.
    """
    items = []
    for s, feats in enumerate(subsets):
        ok = X.all_not_null(feats)
        for f in feats:
            items.append(F.struct(F.lit(s).alias("subset"), F.lit(f).alias("feature"),
                                  F.col(f).alias("value"), ok.alias("ok")))
    long = train.select(F.inline(F.array(*items))).where(F.col("ok")).drop("ok")
    q = quantiles_bracketed(long, "value", [0.25, 0.5, 0.75], ["subset", "feature"])
    rows = q.collect()
    stats: dict = {}
    for r in rows:
        stats.setdefault(r["subset"], {}).setdefault(r["feature"], {})[r["p"]] = r["q"]
    scales = {}
    for s, feats in enumerate(subsets):
        scales[s] = {}
        for f in feats:
            d = stats.get(s, {}).get(f)
            if d is None:
                raise ValueError(f"no complete training rows for features {feats}")
            iqr = d[0.75] - d[0.25]
            scales[s][f] = (d[0.5], 1.0 if abs(iqr) < SC.ZERO_SCALE else iqr)
    return scales


def fit_forests(train: DataFrame, keys: Sequence[str], subsets: Sequence[tuple],
                psi_settings: Sequence = ("auto",), n_trees: int = 100, seed: int = 42,
                min_train: int = 10) -> ForestFit:
    """M2 for a whole grid: one forest per (feature subset, sample-size setting)."""
    all_features = sorted({f for s in subsets for f in s})
    base = _finite_features(train, all_features).select(_key_hash(keys).alias("_h"), *all_features)
    base = cut(base)
    counts = base.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(X.all_not_null(s), 1)).alias(f"s{i}") for i, s in enumerate(subsets)]).first()
    n_valid = [counts[f"s{i}"] for i in range(len(subsets))]
    if min(n_valid) < min_train:
        raise ValueError(f"too few complete training rows: {min(n_valid)} < {min_train}")
    specs, seen = [], {}
    for s, feats in enumerate(subsets):
        for si, setting in enumerate(psi_settings):
            want = 256 if setting == "auto" else int(setting)
            psi = min(want, n_valid[s])
            specs.append(ForestSpec(len(specs), tuple(feats), psi, str(setting), s, si))
    scales = fit_scales(base, subsets, all_features)
    psi_max = max(sp.psi for sp in specs)
    # Per subset, so that a sparse feature does not send the whole table to every tree.
    tau = np.array([(psi_max + 10.0 * math.sqrt(psi_max) + 50.0) / max(1, n) for n in n_valid])
    feat_index = {f: i for i, f in enumerate(all_features)}
    spec_rows = [(sp.forest, sp.subset, sp.psi, [feat_index[f] for f in sp.features]) for sp in specs]
    subset_cols = {s: [feat_index[f] for f in feats] for s, feats in enumerate(subsets)}
    centers = {s: np.array([scales[s][f][0] for f in feats]) for s, feats in enumerate(subsets)}
    widths = {s: np.array([scales[s][f][1] for f in feats]) for s, feats in enumerate(subsets)}
    cand_schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("prio", T.DoubleType()),
                                T.StructField("_h", T.LongType())] +
                               [T.StructField(f, T.DoubleType()) for f in all_features])

    while True:
        def candidates(batches, tau=tau):
            for pdf in batches:
                h = pdf["_h"].to_numpy()
                known = ~np.isnan(pdf[all_features].to_numpy(dtype=np.float64))
                bound = np.max([np.where(known[:, cols].all(axis=1), tau[s], 0.0)
                                for s, cols in subset_cols.items()], axis=0)
                out = []
                for t in range(n_trees):
                    pr = priorities(h, seed, t)
                    sel = pr < bound
                    if sel.any():
                        part = pdf.loc[sel, all_features].copy()
                        part.insert(0, "_h", h[sel])
                        part.insert(0, "prio", pr[sel])
                        part.insert(0, "tree", np.int32(t))
                        out.append(part)
                if out:
                    yield pd.concat(out, ignore_index=True)

        def grow(key, pdf):
            t = int(key[0])
            pdf = pdf.sort_values(["prio", "_h"], kind="mergesort")
            Xall = pdf[all_features].to_numpy(dtype=np.float64)
            cols = {c: [] for c in ("forest", "node", "feature", "threshold", "left", "right", "size",
                                    "depth", "short")}
            for forest, subset, psi, fcols in spec_rows:
                sub = Xall[:, fcols]
                sample = sub[~np.isnan(sub).any(axis=1)][:psi]
                if len(sample) < psi:
                    tr = (np.array([-1]), np.array([0.0]), np.array([-1]), np.array([-1]),
                          np.array([0]), np.array([0]))
                    short = True
                else:
                    sample = (sample - centers[subset]) / widths[subset]
                    rng = np.random.default_rng([seed, subset, psi, t])
                    tr = grow_tree(sample, rng, _tree_depth_limit(psi))
                    short = False
                k = len(tr[0])
                cols["forest"].append(np.full(k, forest, dtype=np.int32))
                cols["node"].append(np.arange(k, dtype=np.int32))
                for name, arr in zip(("feature", "threshold", "left", "right", "size", "depth"), tr):
                    cols[name].append(arr)
                cols["short"].append(np.full(k, short, dtype=bool))
            out = {name: np.concatenate(parts) for name, parts in cols.items()}
            out["tree"] = np.full(len(out["forest"]), t, dtype=np.int32)
            return pd.DataFrame(out)[[f.name for f in NODE_SCHEMA.fields]]

        cands = base.mapInPandas(candidates, cand_schema)
        slots = compute_slots(cands.sparkSession, n_trees)
        nodes = cut(cands.repartition(slots, "tree").groupBy("tree").applyInPandas(grow, NODE_SCHEMA))
        short = nodes.where(F.col("short")).limit(1).count()
        if short == 0 or (tau >= 1.0).all():
            break
        tau = tau * 2.0
    return ForestFit(specs, nodes.drop("short"), scales, n_trees, seed, cands)


def _packed(fit: ForestFit, specs: Sequence[ForestSpec], n_trees: int) -> list[tuple]:
    """(spec, trees as arrays) of the given forests, brought to the driver to be broadcast.

    A forest has at most ``n_trees`` times ``2 psi - 1`` nodes, whatever the data.
    """
    pdf = (fit.nodes.where(F.col("forest").isin([sp.forest for sp in specs]) & (F.col("tree") < n_trees))
           .toPandas().sort_values(["forest", "tree", "node"]))
    of, tree = pdf["forest"].to_numpy(), pdf["tree"].to_numpy()
    columns = [pdf[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth")]
    cuts = [*np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (tree[1:] != tree[:-1])][:len(of)]), len(of)]
    trees: dict[int, list] = {sp.forest: [] for sp in specs}
    depths = {sp.forest: _tree_depth_limit(sp.psi) for sp in specs}
    for a, b in zip(cuts, cuts[1:]):
        flat, forest = tuple(c[a:b] for c in columns), int(of[a])
        trees[forest].append(heap_tree(flat, depths[forest]) if depths[forest] <= HEAP_DEPTH else flat)
    return [(sp, trees[sp.forest]) for sp in specs]


def _scorer(fit: ForestFit, specs: Sequence[ForestSpec], tree_counts: Sequence[int], spark):
    """Function (features frame) -> iterator of (forest, T, scores; NaN where a feature is missing)."""
    model = spark.sparkContext.broadcast(_packed(fit, specs, max(tree_counts)))
    scales = fit.scales

    def run(pdf: pd.DataFrame):
        for sp, trees in model.value:
            feats = list(sp.features)
            center = np.array([scales[sp.subset][f][0] for f in feats])
            width = np.array([scales[sp.subset][f][1] for f in feats])
            Xr = pdf[feats].to_numpy(dtype=np.float64)
            valid = ~np.isnan(Xr).any(axis=1)
            Xs = (Xr[valid] - center) / width
            total, c = np.zeros(len(Xs)), avg_path_length([sp.psi])[0]
            columns = np.ascontiguousarray(Xs.T)
            for t, tree in enumerate(trees, 1):
                total += heap_lengths(columns, tree) if len(tree) == 3 else path_lengths(Xs, tree)
                if t in tree_counts:
                    s = np.full(len(Xr), np.nan)
                    s[valid] = np.power(2.0, -(total / t) / c) if c > 0 else 0.5
                    yield sp.forest, t, s

    return run


def score_rows(rows: DataFrame, fit: ForestFit, keys: Sequence[str], forests: Sequence[int] | None = None,
               tree_counts: Sequence[int] | None = None) -> DataFrame:
    """M3 core: s = 2^(-E[h]/c(psi)) per row and forest, for the first T trees (each T).

    The forests are broadcast (in groups of at most MODEL_BYTES) and the rows
    stay where they are.  Rows missing a feature of the forest get no score.
    Returns (keys..., forest, T, s).
    """
    specs = [sp for sp in fit.specs if forests is None or sp.forest in set(forests)]
    tree_counts = sorted(tree_counts or [fit.n_trees])
    all_features = sorted({f for sp in specs for f in sp.features})
    rows = _finite_features(rows, all_features).select(*keys, *all_features)
    out_schema = T.StructType([f for f in rows.schema.fields if f.name in keys] + [
        T.StructField("forest", T.IntegerType()), T.StructField("T", T.IntegerType()),
        T.StructField("s", T.DoubleType())])

    def part(run) -> DataFrame:
        def score(batches):
            for pdf in batches:
                for forest, t, s in run(pdf):
                    known = ~np.isnan(s)
                    yield pdf.loc[known, list(keys)].assign(forest=np.int32(forest), T=np.int32(t), s=s[known])

        return rows.mapInPandas(score, out_schema)

    return reduce(DataFrame.union, [part(run) for run in _scorers(fit, specs, tree_counts, rows.sparkSession)])


def _scorers(fit: ForestFit, specs: Sequence[ForestSpec], tree_counts: Sequence[int], spark) -> list:
    """A ``_scorer`` per group of forests of at most MODEL_BYTES."""
    groups, held = [[]], 0
    for sp in specs:
        size = max(tree_counts) * 2 * sp.psi * NODE_BYTES
        if groups[-1] and held + size > MODEL_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(sp)
        held += size
    return [_scorer(fit, g, tree_counts, spark) for g in groups]


def grid_scores(rows: DataFrame, features: Sequence[str], scorers: Sequence) -> DataFrame:
    """``score_rows`` without keys: (forest, T, s), one row per scored row, forest and tree count.

    The features are written and dealt to as many tasks as the cores take, and
    a batch's scores of one forest leave Python as one array.
    """
    rows = cut(_finite_features(rows, features).select(*features))
    slots = compute_slots(rows.sparkSession, math.ceil(rows.count() / ROWS_IN_TASK))
    rows = rows.repartition(slots)

    def part(run) -> DataFrame:
        def score(batches):
            for pdf in batches:
                yield pd.DataFrame([(forest, t, s[~np.isnan(s)]) for forest, t, s in run(pdf)],
                                   columns=["forest", "T", "s"])

        return rows.mapInPandas(score, "forest int, T int, s array<double>")

    return reduce(DataFrame.union, [part(run) for run in scorers])


def offsets(train_scores: DataFrame, contaminations: Sequence[float]) -> DataFrame:
    """Offset per (forest, T, contamination): percentile of -s on the train rows."""
    neg = train_scores.select("forest", "T", (-F.col("s")).alias("v"))
    q = quantiles_bracketed(neg, "v", list(contaminations), ["forest", "T"])
    return q.select("forest", "T", F.col("p").alias("contamination"), F.col("q").alias("offset"))


# ------------------------------------------------------------------ grid
# fixed values: the reference's hyper-parameter grid and feature-subset sizes
GRID_N_ESTIMATORS = (100, 200, 300)
GRID_CONTAMINATION = (0.01, 0.03, 0.05)
GRID_MAX_SAMPLES = ("auto", 50, 170)
SUBSET_SIZES = (2, 3, 4, 5)


def feature_subsets(features: Sequence[str], sizes: Sequence[int] = SUBSET_SIZES) -> list:
    out = []
    for k in sizes:
        if k <= len(features):
            out.extend(itertools.combinations(features, k))
    return out


@dataclass
class GridResult:
    experiments: DataFrame     # one row per (subset, n_estimators, contamination, max_samples)
    best_per_subset: DataFrame
    best: dict
    fit: ForestFit


def _mean_exact(c):
    return F.sum(F.col(c).cast("decimal(38,18)")).cast("double") / F.count(F.lit(1))


def grid_search(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str],
                seed: int = 42, sizes: Sequence[int] = SUBSET_SIZES,
                n_estimators=GRID_N_ESTIMATORS, contaminations=GRID_CONTAMINATION,
                max_samples=GRID_MAX_SAMPLES) -> GridResult:
    """M5: every feature subset x parameter setting; score = mean test anomaly score.

    Ties resolve like the reference: first subset in size/combination order,
    then first setting in (contamination, max_samples, n_estimators) order.
    """
    subsets = feature_subsets(features, sizes)
    fit = fit_forests(train, keys, subsets, max_samples, max(n_estimators), seed)
    spark = train.sparkSession
    used = sorted({f for sp in fit.specs for f in sp.features})
    scorers = _scorers(fit, fit.specs, sorted(n_estimators), spark)
    each = lambda scored: scored.select("forest", "T", F.explode("s").alias("s"))
    off = offsets(each(cut(grid_scores(train, used, scorers))), contaminations)
    mean_s = each(grid_scores(test, used, scorers)).groupBy("forest", "T").agg(_mean_exact("s").alias("mean_s"))
    spec_df = spark.createDataFrame(
        [(sp.forest, sp.subset, ", ".join(sp.features), len(sp.features), sp.psi_setting, sp.psi,
          sp.setting_index) for sp in fit.specs],
        "forest int, subset int, features string, n_features int, max_samples string, psi int, ms_order int")
    exp = (mean_s.join(off, ["forest", "T"]).join(F.broadcast(spec_df), "forest")
           .select("subset", "features", "n_features", F.col("T").alias("n_estimators"), "contamination",
                   "max_samples", "psi", "ms_order", (F.col("mean_s") + F.col("offset")).alias("mean_score")))
    exp = cut(exp)  # a row per experiment
    grid_order = [F.col("contamination"), F.col("ms_order"), F.col("n_estimators")]
    w = Window.partitionBy("subset").orderBy(F.desc("mean_score"), *grid_order)
    best_sub = exp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    best_row = best_sub.orderBy(F.desc("mean_score"), F.asc("subset")).first()
    best = best_row.asDict()
    best["feature_list"] = list(subsets[best["subset"]])
    return GridResult(exp.drop("ms_order"), best_sub.drop("ms_order"), best, fit)


@dataclass
class AnomalyModel:
    features: list
    fit: ForestFit
    forest: int
    n_estimators: int
    contamination: float
    offset: float
    psi: int


def fit_model(train: DataFrame, keys: Sequence[str], features: Sequence[str], n_estimators: int = 100,
              contamination: float = 0.05, max_samples="auto", seed: int = 42) -> AnomalyModel:
    """M2 + M6: one forest and its decision offset from the train rows."""
    fit = fit_forests(train, keys, [tuple(features)], (max_samples,), n_estimators, seed)
    return model_from_fit(train, keys, fit, 0, n_estimators, contamination)


def model_from_fit(train: DataFrame, keys, fit: ForestFit, forest: int, n_estimators: int,
                   contamination: float) -> AnomalyModel:
    tr = cut(score_rows(train, fit, keys, [forest], [n_estimators]).select("forest", "T", "s"))
    off = offsets(tr, [contamination]).first()["offset"]
    sp = fit.specs[forest]
    return AnomalyModel(list(sp.features), fit, forest, n_estimators, contamination, float(off), sp.psi)


def best_model(grid: GridResult, train: DataFrame, keys: Sequence[str]) -> AnomalyModel:
    """The model of the grid's best experiment."""
    b = grid.best
    forest = next(sp.forest for sp in grid.fit.specs
                  if sp.subset == b["subset"] and sp.psi_setting == b["max_samples"])
    return model_from_fit(train, keys, grid.fit, forest, int(b["n_estimators"]), float(b["contamination"]))


def predict(test: DataFrame, model: AnomalyModel, keys: Sequence[str]) -> DataFrame:
    """M3: ``anomaly`` flag and ``anomaly_score`` (= s + offset, > 0 means anomaly).

    Rows with a missing (or infinite) feature keep anomaly = false and a
    missing score, as in the reference.
    """
    base = _finite_features(test, model.features)
    sp = model.fit.specs[model.forest]
    run, offset = _scorer(model.fit, [sp], [model.n_estimators], test.sparkSession), model.offset

    @F.pandas_udf("double")
    def judge(*cols: pd.Series) -> pd.Series:
        pdf = pd.DataFrame(dict(zip(sp.features, cols)))
        return next(pd.Series(s + offset) for _, _, s in run(pdf))

    # Scored in place: rows without a key, or with the same key, keep their own score.
    out = base.withColumn("anomaly_score", X.no_nan(judge(*[F.col(f).cast("double") for f in sp.features])))
    return out.withColumn("anomaly", F.coalesce(F.col("anomaly_score") > 0, F.lit(False)))


# ---------------------------------------------------------------- reports
def metrics(result: DataFrame) -> DataFrame:
    """Counts, percentages and score statistics over scored rows."""
    s = F.col("anomaly_score")
    agg = result.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(F.col("anomaly"), 1)).alias("anomalies_count"),
        F.min(s).alias("score_min"), F.max(s).alias("score_max"),
        (F.sum(s.cast("decimal(38,12)")).cast("double") / F.count(s)).alias("score_mean"),
        F.count(s).alias("_scored"))
    # Squared deviations are summed as decimals, so the spread does not depend on the order of rows.
    gap = s - F.col("_mean")
    spread = result.crossJoin(F.broadcast(agg.select(F.col("score_mean").alias("_mean")))).agg(
        F.sum((gap * gap).cast("decimal(38,12)")).cast("double").alias("_ss"))
    agg = agg.crossJoin(F.broadcast(spread)).withColumn("score_std", F.when(
        F.col("_scored") > 1, F.sqrt(X.ieee_div("_ss", F.col("_scored") - F.lit(1)))))
    med = quantiles_long(result.select(F.lit("s").alias("g"), s.alias("v")), "v", [0.5], ["g"])
    agg = agg.withColumn("_k", F.lit(1)).join(
        med.select(F.lit(1).alias("_k"), F.col("q").alias("score_median")), "_k", "left").drop("_k")
    return agg.select(
        "total_records", "anomalies_count",
        (F.col("total_records") - F.col("anomalies_count")).alias("normal_count"),
        X.ieee_div(F.col("anomalies_count") * F.lit(100.0), "total_records").alias("anomaly_percentage"),
        X.ieee_div((F.col("total_records") - F.col("anomalies_count")) * F.lit(100.0), "total_records")
        .alias("normal_percentage"),
        "score_min", "score_max", "score_mean", "score_median", "score_std")


def segmented(result: DataFrame, segment: str) -> DataFrame:
    """The A23 counts per segment value (a missing segment is its own group)."""
    s = F.col("anomaly_score")
    g = result.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(F.col("anomaly"), 1)).alias("anomalies_count"),
        F.min(s).alias("score_min"), F.max(s).alias("score_max"),
        (F.sum(s.cast("decimal(38,12)")).cast("double") / F.count(s)).alias("score_mean"))
    return g.select(
        F.lit(segment).alias("segment_column"), "segment", "total_records", "anomalies_count",
        (F.col("total_records") - F.col("anomalies_count")).alias("normal_count"),
        X.ieee_div(F.col("anomalies_count") * F.lit(100.0), "total_records").alias("anomaly_percentage"),
        "score_min", "score_max", "score_mean")


def score_histogram(result: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width right-closed bins, lowest edge widened by 0.1% of the range;
    p95 threshold and the count / share at or above it."""
    s = F.col("anomaly_score")
    scored = result.where(s.isNotNull())
    rng = scored.agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    p95 = quantiles_long(scored.select(F.lit("s").alias("g"), s.alias("v")), "v", [0.95], ["g"]) \
        .select(F.col("q").alias("threshold"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    idx = F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((s - F.col("_lo")) / width))))\
        .otherwise(F.lit(1)).cast("int")
    j = scored.crossJoin(F.broadcast(rng)).crossJoin(F.broadcast(p95))
    counted = j.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    high = j.agg(F.count(F.when(s >= F.col("threshold"), 1)).alias("high_score_count"))
    dim = rng.crossJoin(p95).crossJoin(high).crossJoin(
        result.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")))
    lo_edge = F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    lo_edge = F.when(F.col("bin") == 1, F.col("_lo") - (F.col("_hi") - F.col("_lo")) * F.lit(0.001)).otherwise(lo_edge)
    return dim.join(counted, "bin", "left").select(
        "bin", lo_edge.alias("bin_lo"),
        (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("bin_hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        "threshold", "high_score_count",
        X.ieee_div(F.col("high_score_count") * F.lit(100.0), "_n").alias("high_score_percentage"),
        F.col("_n").alias("total_scores"))


def explain(result: DataFrame, features: Sequence[str], id_columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """M4: per anomaly, each feature's value, the median of all rows and a status.

    Fences (A27) and medians come from every result row; statuses are
    'bajo' / 'alto' / 'normal' / 'N/A' and the text lists the outlying features.
    """
    from ..functions.ranking import stack_columns
    long = stack_columns(result, list(features)).withColumnRenamed("column", "feature").where(F.col("value").isNotNull())
    q = quantiles_long(long, "value", [0.25, 0.5, 0.75], ["feature"])   # one pass: fences and medians
    per = q.groupBy("feature").agg(*[F.max(F.when(F.col("p") == F.lit(p), F.col("q"))).alias(n)
                                     for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    iqr = F.col("q3") - F.col("q1")
    per = per.select("feature", "median", (F.col("q1") - F.lit(float(k)) * iqr).alias("lower"),
                     (F.col("q3") + F.lit(float(k)) * iqr).alias("upper"))
    params = per.agg(
        *[F.max(F.when(F.col("feature") == F.lit(f), F.col(c))).alias(f"_{c}_{f}")
          for f in features for c in ("lower", "upper", "median")])
    an = result.where(F.col("anomaly")).crossJoin(F.broadcast(params))
    cols = [*[F.col(c) for c in id_columns], F.col("anomaly_score")]
    statuses = []
    for f in features:
        v = F.col(f)
        st = (F.when(v.isNull(), F.lit("N/A")).when(v < F.col(f"_lower_{f}"), F.lit("bajo"))
              .when(v > F.col(f"_upper_{f}"), F.lit("alto")).otherwise(F.lit("normal")))
        statuses.append((f, st))
        cols += [v.alias(f), F.col(f"_median_{f}").alias(f"median_{f}"), st.alias(f"{f}_status")]
    out = an.select(*cols)
    is_out = [F.col(f"{f}_status").isin("bajo", "alto") for f, _ in statuses]
    names = F.array_compact(F.array(*[F.when(c, F.lit(f)) for (f, _), c in zip(statuses, is_out)]))
    out = out.withColumn("outlier_count", X.count_true(is_out))
    return out.withColumn("outlier_variables", F.when(
        F.col("outlier_count") > 0,
        F.concat(F.lit("outlier en "), F.col("outlier_count").cast("string"), F.lit(" variables: "),
                 F.array_join(names, ", "))).otherwise(F.lit("sin outliers claros")))


def explanation_text(features: Sequence[str], lower: str, upper: str) -> F.Column:
    """M4, one row as text: each value outside its fences (columns ``lower``/``upper`` + feature)."""
    # fixed values: the texts of the single-row explanation
    low, high, nothing = "%s: %.3f < %.3f (low)", "%s: %.3f > %.3f (high)", "No obvious outliers"
    three = lambda c: F.bround(c, 3)
    parts = []
    for f in features:
        v, lo, hi = F.col(f), F.col(f"{lower}{f}"), F.col(f"{upper}{f}")
        parts.append(F.when(v < lo, F.format_string(low, F.lit(f), three(v), three(lo)))
                     .when(v > hi, F.format_string(high, F.lit(f), three(v), three(hi))))
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(F.lit(nothing))


def explain_rows(result: DataFrame, features: Sequence[str], id_columns: Sequence[str],
                 k: float = 1.5) -> DataFrame:
    """M4 single-row form for every row: number of values outside the fences of all rows, and the text."""
    fences = SC.fence_columns(SC.iqr_fences(result, features, k), features)
    fenced = result.crossJoin(F.broadcast(fences))  # one row of fences
    outside = [(F.col(f) < F.col(f"_lo_{f}")) | (F.col(f) > F.col(f"_hi_{f}")) for f in features]
    return fenced.select(*id_columns, X.count_true(outside).alias("n_outlier_features"),
                         explanation_text(features, "_lo_", "_hi_").alias("explanation"))


def outlier_frequency(explanations: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often each feature is an outlier among the explained anomalies."""
    long = explanations.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_status").isin("bajo", "alto").alias("is_out"))
        for f in features])))
    return long.groupBy("feature").agg(F.count(F.when(F.col("is_out"), 1)).alias("n_anomalies_outlier"))


def summary_by_size(experiments: DataFrame) -> DataFrame:
    """Mean / max / count of the best score per subset size."""
    return experiments.groupBy("n_features").agg(
        _mean_exact("mean_score").alias("mean"), F.max("mean_score").alias("max"), F.count(F.lit(1)).alias("count"))


def top_feature_frequency(best_per_subset: DataFrame, top: int = 5) -> DataFrame:
    """How often each feature appears among the top subsets."""
    topn = best_per_subset.orderBy(F.desc("mean_score"), F.asc("subset")).limit(top)
    return (topn.select(F.explode(F.split("features", ", ")).alias("feature"))
            .groupBy("feature").agg(F.count(F.lit(1)).alias("count")))


def anomaly_summary(result: DataFrame, features: Sequence[str], id_columns: Sequence[str],
                    national: DataFrame | None = None) -> DataFrame:
    """M7 summary: anomalous rows with id columns, features, score and national_<feature>."""
    out = result.where(F.col("anomaly")).select(*id_columns, *features, "anomaly_score")
    if national is not None:
        nat = national.select(*[F.col(f).alias(f"national_{f}") for f in features if f in national.columns])
        out = out.crossJoin(F.broadcast(nat.limit(1)))
    return out


@dataclass
class CompleteAnalysis:
    grid: GridResult | None
    model: AnomalyModel
    predictions: DataFrame
    metrics: DataFrame
    explanations: DataFrame
    segments: dict
    summary: DataFrame


def complete_analysis(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str],
                      segments: Sequence[str] = (), national: DataFrame | None = None,
                      optimize: bool = True) -> CompleteAnalysis:
    """M7 in one call: check the inputs, fit (by grid search or with the defaults), score, report, explain."""
    validate_inputs(train, test, features)
    grid = grid_search(train, test, keys, features) if optimize else None
    model = best_model(grid, train, keys) if grid else fit_model(train, keys, features)
    scored = cut(predict(test, model, keys))
    return CompleteAnalysis(
        grid, model, scored, metrics(scored), explain(scored, model.features, keys),
        {c: segmented(scored, c) for c in segments if c in scored.columns},
        anomaly_summary(scored, model.features, keys, national))


def ranked_experiments(best_per_subset: DataFrame, top: int = 10) -> DataFrame:
    """M8: the best subsets ranked by mean score (a top-k report over <= #subsets rows)."""
    topn = best_per_subset.orderBy(F.desc("mean_score"), F.asc("subset")).limit(top)
    w = Window.orderBy(F.desc("mean_score"), F.asc("subset"))
    return topn.select(F.row_number().over(w).alias("rank"), F.col("features").alias("features_selected"),
                       "n_features", "contamination", "n_estimators", "max_samples",
                       F.bround("mean_score", 4).alias("mean_score"))


def grid_statistics(best_per_subset: DataFrame) -> DataFrame:
    """M8 statistics: combinations evaluated, feature range, best / mean / std score."""
    return best_per_subset.agg(
        F.count(F.lit(1)).alias("total_combinations_evaluated"),
        F.concat(F.min("n_features").cast("string"), F.lit("-"), F.max("n_features").cast("string"))
        .alias("feature_range"),
        F.max("mean_score").alias("best_mean_score"),
        F.bround(F.avg("mean_score"), 4).alias("mean_mean_score"),
        F.bround(F.stddev_samp("mean_score"), 4).alias("std_mean_score"))


def validate_inputs(train: DataFrame, test: DataFrame, features: Sequence[str],
                    min_train: int = 10, min_test: int = 3) -> None:
    """Required feature columns present, at least ``min_train`` / ``min_test`` rows."""
    for name, df in (("train", train), ("test", test)):
        missing = [f for f in features if f not in df.columns]
        if missing:
            raise ValueError(f"{name} table lacks features {missing}")
    if train.limit(min_train).count() < min_train:
        raise ValueError(f"fewer than {min_train} training rows")
    if test.limit(min_test).count() < min_test:
        raise ValueError(f"fewer than {min_test} test rows")


def scale_table(spark, model: AnomalyModel) -> DataFrame:
    """M9: the robust-scaling parameters of a fitted model (one row per feature)."""
    sp = model.fit.specs[model.forest]
    rows = [(f, float(model.fit.scales[sp.subset][f][0]), float(model.fit.scales[sp.subset][f][1]))
            for f in sp.features]
    return spark.createDataFrame(rows, "feature string, center double, scale double")


def combined_report(result: DataFrame, explanations: DataFrame, features: Sequence[str]) -> DataFrame:
    """A23 metrics with the explanation statistics (one row)."""
    ex = explanations.agg(F.count(F.lit(1)).alias("explained_anomalies"),
                          F.avg("outlier_count").alias("avg_outlier_count"),
                          F.max("outlier_count").alias("max_outlier_count"))
    freq = outlier_frequency(explanations, features)
    top = freq.orderBy(F.desc("n_anomalies_outlier"), F.asc("feature")).limit(1).select(
        F.lit(1).alias("_k"), F.col("feature").alias("top_outlier_feature"),
        F.col("n_anomalies_outlier").alias("top_outlier_count"))
    out = metrics(result).crossJoin(ex).withColumn("_k", F.lit(1))
    return out.join(top, "_k", "left").drop("_k")
