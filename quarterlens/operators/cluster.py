"""Hierarchical clustering with feature selection.

Two levels, so no task ever holds the n x n distance matrix:

* **micro-clusters** - MLlib ``KMeans`` (distributed) summarises the rows into
  at most ``m`` weighted centroids, on the same path for any number of rows.
* **linkage** - Lance-Williams agglomeration (ward / complete / average;
  euclidean / cosine / correlation) on the <= m weighted points.  Ward with
  weights is exact over micro-clusters (their initial distances are the ward
  merge costs); the other pairs are approximations.

Every candidate of a grid or of a selection step is one task of one Spark job
(the micro table, bounded by m, travels with the closure).  Selection scores
use the weighted silhouette of the micro points; the reported silhouette of
a labelled table (C3) is exact over all rows, computed block against block
with ``cogroup`` so each task holds two bounded blocks, or follows from the
clusters' moments on squared distances (``silhouette_squared``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions.materialize import cut
from . import scale as SC

# fixed values: the valid (method, metric) pairs of the reference grid
LINKAGE_PAIRS = [
    ("ward", "euclidean"), ("complete", "euclidean"), ("complete", "cosine"),
    ("complete", "correlation"), ("average", "euclidean"), ("average", "cosine"),
    ("average", "correlation"),
]
MICRO = 500  # weighted centroids that a table is summarised by
SILHOUETTE_BLOCK = 4000      # rows of a block that need not be cut for more tasks
SILHOUETTE_VALUES = 1 << 21  # numbers of a block, and sums that it takes from another
SILHOUETTE_PAIRS = 1 << 17   # distances that a task holds at once
SILHOUETTE_COLUMNS = 1024    # of them, in one row
SILHOUETTE_CLOSE = 1e-6      # squared, against the squares of both rows: below it pairs are measured by differences
LABEL_BLOCK = 1024   # clusters in one broadcast row


# ------------------------------------------------------------ numpy core
def pairwise(Xm: np.ndarray, metric: str) -> np.ndarray:
    """Full distance matrix (euclidean via the Gram matrix, clipped at 0)."""
    if metric == "correlation":
        Xm = Xm - Xm.mean(axis=1, keepdims=True)
    elif metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    if metric == "euclidean":
        sq = (Xm * Xm).sum(axis=1)
        D = sq[:, None] + sq[None, :] - 2.0 * (Xm @ Xm.T)
        np.maximum(D, 0.0, out=D)
        np.sqrt(D, out=D)
        np.fill_diagonal(D, 0.0)
        return D
    norms = np.sqrt((Xm * Xm).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = (Xm @ Xm.T) / (norms[:, None] * norms[None, :])
    D = 1.0 - sim
    np.fill_diagonal(D, 0.0)
    return np.maximum(D, 0.0)


def linkage(Xm: np.ndarray, weights: np.ndarray, method: str, metric: str,
            distances: np.ndarray | None = None) -> np.ndarray:
    """Merges (a, b, distance, size) of an agglomeration of weighted points, sorted by distance.

    Nearest-neighbour chain with Lance-Williams updates: O(m^2) work for the
    reducible linkages used here (ward, complete, average).  ``a`` and ``b``
    are point indices that represent the two merged clusters.
    """
    if method == "ward" and metric != "euclidean":
        raise ValueError("ward needs the euclidean metric")
    m = len(Xm)
    D = pairwise(Xm, metric) if distances is None else distances.copy()
    if np.isnan(D).any():
        raise ValueError("undefined distances (constant rows)")
    w = weights.astype(np.float64).copy()
    if method == "ward":
        D = np.sqrt(2.0 * np.outer(w, w) / (w[:, None] + w[None, :])) * D
    np.fill_diagonal(D, np.inf)
    active = np.ones(m, dtype=bool)
    merges = []
    chain: list = []
    remaining = m
    while remaining > 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        a = chain[-1]
        row = D[a]
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain.pop(), chain.pop()
            dab = D[a, b]
            da, db = D[a].copy(), D[b].copy()
            if method == "complete":
                new = np.maximum(da, db)
            elif method == "average":
                new = (w[a] * da + w[b] * db) / (w[a] + w[b])
            else:
                new = np.sqrt(np.maximum(((w + w[a]) * da * da + (w + w[b]) * db * db - w * dab * dab)
                                         / (w[a] + w[b] + w), 0.0))
            keep, drop = min(a, b), max(a, b)
            merges.append((keep, drop, dab, w[a] + w[b]))
            w[keep] = w[a] + w[b]
            new[~active] = np.inf
            D[keep, :] = new
            D[:, keep] = new
            D[keep, keep] = np.inf
            D[drop, :] = np.inf
            D[:, drop] = np.inf
            active[drop] = False
            remaining -= 1
        else:
            chain.append(b)
    out = np.array(merges, dtype=np.float64).reshape(-1, 4)
    order = np.argsort(out[:, 2], kind="stable")
    return out[order]


def cut_maxclust(merges: np.ndarray, m: int, k: int) -> np.ndarray:
    """Labels 1..k after the m-k lowest merges, numbered by first member."""
    parent = list(range(m))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for step in range(max(0, m - k)):
        a, b = find(int(merges[step, 0])), find(int(merges[step, 1]))
        if a != b:
            parent[max(a, b)] = min(a, b)
    order, labels = {}, np.zeros(m, dtype=np.int64)
    for p in range(m):
        r = find(p)
        if r not in order:
            order[r] = len(order) + 1
        labels[p] = order[r]
    return labels


def weighted_silhouette(Xm: np.ndarray, weights: np.ndarray, labels: np.ndarray,
                        distances: np.ndarray | None = None) -> float:
    """Mean silhouette (euclidean) of the points the weighted centroids stand for."""
    uniq = np.unique(labels)
    if len(uniq) < 2:
        return float("nan")
    D = pairwise(Xm, "euclidean") if distances is None else distances
    W = weights.astype(np.float64)
    onehot = (labels[:, None] == uniq[None, :]).astype(np.float64) * W[:, None]
    sums = D @ onehot
    sizes = onehot.sum(axis=0)
    own = np.searchsorted(uniq, labels)
    own_size = sizes[own]
    idx = np.arange(len(Xm))
    a = np.where(own_size > 1, sums[idx, own] / np.maximum(own_size - 1, 1), 0.0)
    others = sums / sizes[None, :]
    others[idx, own] = np.inf
    b = others.min(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where(own_size > 1, (b - a) / np.maximum(a, b), 0.0)
    s = np.nan_to_num(s, nan=0.0)
    return float((s * W).sum() / W.sum())


# ------------------------------------------------------------ Spark side
@dataclass
class MicroClusters:
    table: pd.DataFrame        # micro, weight, <features> (scaled): at most m rows
    assignment: DataFrame      # keys..., micro


def micro_clusters(scaled: DataFrame, keys: Sequence[str], features: Sequence[str],
                   m: int = MICRO, seed: int = 42) -> MicroClusters:
    """Rows -> at most m weighted centroids, by distributed k-means whatever the number of rows.

    With fewer distinct rows than m the centroids are (nearly) the rows
    themselves; m bounds what the linkage tasks hold.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=list(features), outputCol="_vec").transform(scaled)
    model = KMeans(k=m, seed=seed, initSteps=5, featuresCol="_vec", predictionCol="micro").fit(vec)
    assign = cut(model.transform(vec).select(*keys, "micro"))
    sizes = assign.groupBy("micro").agg(F.count(F.lit(1)).alias("weight")).toPandas()  # at most m rows
    centers = np.array(model.clusterCenters())
    table = pd.DataFrame(centers, columns=list(features))
    table.insert(0, "micro", np.arange(len(centers)))
    table = table.merge(sizes, on="micro", how="inner").sort_values([*features, "micro"], ignore_index=True)
    return MicroClusters(table[["micro", "weight", *features]], assign)


RESULT_SCHEMA = T.StructType([
    T.StructField("task", T.IntegerType()), T.StructField("silhouette", T.DoubleType()),
])


def evaluate_tasks(spark, micro: MicroClusters, tasks: list) -> dict:
    """Run (method, metric, k, features) tasks as one Spark job; task -> silhouette."""
    if not tasks:
        return {}
    table = micro.table
    # order tasks by feature set and cut the order into ranges: tasks sharing
    # a feature set mostly land in the same partition (distance-matrix reuse)
    # while the ranges spread over every core
    groups = {feats: g for g, feats in enumerate(dict.fromkeys(t[3] for t in tasks))}
    order = sorted(range(len(tasks)), key=lambda i: (groups[tasks[i][3]], i))
    parts = max(1, min(len(tasks), 2 * spark.sparkContext.defaultParallelism))
    tdf = spark.createDataFrame([(t, pos) for pos, t in enumerate(order)], "task int, pos int")
    tdf = tdf.repartitionByRange(parts, "pos").select("task")

    def run(batches):
        cache: dict = {}
        trees: dict = {}
        w = table["weight"].to_numpy(dtype=np.float64)
        for pdf in batches:
            out = []
            for t in pdf["task"].tolist():
                method, metric, k, feats = tasks[t]
                Xm = table[list(feats)].to_numpy(dtype=np.float64)
                if feats not in cache:
                    cache.clear()
                    trees.clear()
                    cache[feats] = pairwise(Xm, "euclidean")
                De = cache[feats]
                try:
                    # One linkage serves every k.
                    if (method, metric) not in trees:
                        trees[method, metric] = linkage(Xm, w, method, metric, De if metric == "euclidean" else None)
                    labels = cut_maxclust(trees[method, metric], len(Xm), k)
                    s = weighted_silhouette(Xm, w, labels, De)
                except (ValueError, FloatingPointError):
                    s = float("nan")
                out.append((t, s))
            yield pd.DataFrame(out, columns=["task", "silhouette"])

    rows = tdf.mapInPandas(run, RESULT_SCHEMA).collect()
    return {r["task"]: (None if r["silhouette"] is None or math.isnan(r["silhouette"]) else r["silhouette"])
            for r in rows}


def _better(a, b) -> bool:
    return a is not None and (b is None or a > b)


def select_features(spark, micro: MicroClusters, cells: list, selectable: Sequence[str],
                    required: Sequence[str], n_select: int, direction: str) -> list:
    """C5 / C6 by intent: greedy forward / backward selection by silhouette.

    ``cells`` are (method, metric, k); every step evaluates all candidates
    of all cells in one job.  Ties keep the first candidate in column order.
    """
    state = {c: (list(required), []) if direction == "forward" else (list(required), list(selectable))
             for c in cells}
    best_score = {c: None for c in cells}
    steps = n_select if direction == "forward" else max(0, len(selectable) - n_select)
    for _ in range(steps):
        tasks, owners = [], []
        for c in cells:
            req, chosen = state[c]
            if direction == "forward":
                cands = [f for f in selectable if f not in chosen]
                options = [(f, req + chosen + [f]) for f in cands]
            else:
                options = [(f, req + [g for g in chosen if g != f]) for f in chosen]
            for f, feats in options:
                tasks.append((c[0], c[1], c[2], tuple(feats)))
                owners.append((c, f))
        scores = evaluate_tasks(spark, micro, tasks)
        picked = {}
        for t, (c, f) in enumerate(owners):
            s = scores.get(t)
            if c not in picked or _better(s, picked[c][1]):
                picked[c] = (f, s)
        for c, (f, s) in picked.items():
            req, chosen = state[c]
            chosen = chosen + [f] if direction == "forward" else [g for g in chosen if g != f]
            state[c] = (req, chosen)
            best_score[c] = s
    if not steps:  # nothing to add or drop: the set as it is
        whole = [(*c, tuple(state[c][0] + state[c][1])) for c in cells]
        scores = evaluate_tasks(spark, micro, whole)
        best_score = {c: scores.get(t) for t, c in enumerate(cells)}
    out = []
    for c in cells:
        req, chosen = state[c]
        feats = req + [f for f in selectable if f in chosen]
        out.append((c, feats, best_score[c]))
    return out


@dataclass
class ClusterResult:
    grid: DataFrame            # one row per experiment
    params: DataFrame          # C4: all features, every pair x k
    best: dict
    labels: DataFrame          # keys..., cluster
    clean: DataFrame           # P18 output (unscaled)
    scaled: DataFrame
    features: list
    winners: DataFrame         # C7 / C8: best of each selection, of all features, and the winner
    micro: MicroClusters


def full_analysis(data: DataFrame, keys: Sequence[str], features: Sequence[str],
                  k_range: Sequence[int] = (5, 6), required: Sequence[str] = ("SCORE",),
                  min_features: int = 4, exclude_outliers: Sequence[str] = ("SCORE",),
                  iqr_k: float = 1.5, threshold: int = 1, m: int = MICRO) -> ClusterResult:
    """P18 -> M1 -> C4 -> C7 (SFS and RFE per cell) -> C9."""
    spark = data.sparkSession
    data = cut(data.select(*keys, *features))
    clean = SC.iqr_filter(data, list(features), iqr_k, threshold, exclude_outliers).kept
    scales = SC.robust_fit(clean, list(features))
    scaled = cut(SC.robust_transform(clean, scales, list(features)).select(*keys, *features))
    micro = micro_clusters(scaled, keys, features, m)
    cells = [(meth, met, k) for meth, met in LINKAGE_PAIRS for k in k_range]
    # C4: all features
    p_tasks = [(meth, met, k, tuple(features)) for meth, met, k in cells]
    p_scores = evaluate_tasks(spark, micro, p_tasks)
    params = spark.createDataFrame(
        [(meth, met, int(k), p_scores.get(i)) for i, (meth, met, k) in enumerate(cells)],
        "method string, metric string, n_clusters int, silhouette double")
    required = [r for r in required if r in features]
    selectable = [f for f in features if f not in required]
    n_select = min(max(min_features - len(required), 1), len(selectable))
    rows = []
    for direction, tag in (("forward", "sfs"), ("backward", "rfe")):
        for (meth, met, k), feats, s in select_features(spark, micro, cells, selectable, required,
                                                          n_select, direction):
            rows.append((len(rows), meth, met, int(k), tag, ", ".join(feats), len(feats), s))
    grid = spark.createDataFrame(rows, "experiment int, method string, metric string, n_clusters int, "
                                       "selection string, features string, n_features int, silhouette double")
    plain = [(None, meth, met, int(k), "all", ", ".join(features), len(features), p_scores.get(i))
             for i, (meth, met, k) in enumerate(cells)]

    def first(candidates):
        scored = [r for r in candidates if r[7] is not None]
        return max(scored, key=lambda r: r[7]) if scored else None  # ties: the first

    bests = {tag: first([r for r in rows if r[4] == tag]) for tag in ("sfs", "rfe")} | {"all": first(plain)}
    # The better of the two selections; all features only where neither has a score.
    b = first([r for r in (bests["sfs"], bests["rfe"]) if r]) or bests["all"]
    if b is None:
        raise ValueError("no clustering configuration produced a silhouette")
    winners = spark.createDataFrame([(*r, r is b) for r in bests.values() if r], (
        "experiment int, method string, metric string, n_clusters int, selection string, features string, "
        "n_features int, silhouette double, winner boolean"))
    best = {"experiment": b[0], "method": b[1], "metric": b[2], "n_clusters": b[3], "selection": b[4],
            "features": b[5].split(", "), "silhouette": b[7]}
    labels = final_labels(spark, micro, best)
    return ClusterResult(grid, params, best, labels, clean, scaled, list(features), winners, micro)


def _in_one_task(spark, micro: MicroClusters, best: dict, run, schema: str) -> DataFrame:
    """``run(points, weights, micro ids)`` over the centroids (at most m rows) in a task."""
    feats = list(best["features"])
    table = spark.createDataFrame(micro.table[["micro", "weight", *feats]])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*feats, "micro"], ignore_index=True)
        return run(pdf[feats].to_numpy(np.float64), pdf["weight"].to_numpy(np.float64), pdf["micro"].to_numpy())

    return table.groupBy().applyInPandas(task, schema)


def final_labels(spark, micro: MicroClusters, best: dict) -> DataFrame:
    """Cut the tuned linkage and label every row through its micro-cluster."""

    def run(Xm, w, ids):
        labels = cut_maxclust(linkage(Xm, w, best["method"], best["metric"]), len(Xm), best["n_clusters"])
        return pd.DataFrame({"micro": ids, "cluster": labels})

    lab = cut(_in_one_task(spark, micro, best, run, "micro int, cluster long"))
    return micro.assignment.join(F.broadcast(lab), "micro").drop("micro")  # at most m rows


def centroids(clean: DataFrame, labels: DataFrame, keys: Sequence[str], features: Sequence[str],
              digits: int = 4) -> DataFrame:
    """Unscaled feature means and size per cluster."""
    j = clean.join(labels, list(keys))
    return j.groupBy("cluster").agg(*[F.bround(F.avg(f), digits).alias(f) for f in features],
                                    F.count(F.lit(1)).alias("size"))


def _pair_distances(A: np.ndarray, B: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Distances of rows A to rows B, by products around ``center`` (a point near B).

    Pairs that lie close for their distance from the center, where products
    lose digits, and all that isn't finite are measured by differences.
    """
    a, b = A - center, B - center
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d = np.column_stack([-2.0 * a, aa, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), bb]).T
    least = SILHOUETTE_CLOSE * (aa + bb[np.isfinite(bb)].max(initial=0.0))
    far = d > least[:, None]
    if not far.all():
        i, j = np.nonzero(~far)
        step = max(1, SILHOUETTE_PAIRS // max(1, A.shape[1]))
        for s in range(0, len(i), step):
            gap = A[i[s:s + step]] - B[j[s:s + step]]
            d[i[s:s + step], j[s:s + step]] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(d, out=d)


def _block_sums(A, ida, la, bad_a, B, idb, lb, bad_b, same_block: bool):
    """Sums and counts of the distances of two blocks, both sorted by label.

    Yields (ids, labels, to, sums, counts) per row and label of the other
    block; each pair of rows is measured once for both of its rows.  Within
    one block only A's side is given, and a row doesn't meet its own id.
    ``bad_a`` and ``bad_b`` are the ids of rows with a missing or infinite
    value: a row that meets one has no sums in this pair of blocks.
    """
    spoiled_a = np.full(len(A), len(bad_b) > 0)
    if same_block and len(bad_b):
        own = pd.Series(ida).map(pd.Series(bad_b).value_counts()).fillna(0).to_numpy()
        spoiled_a = len(bad_b) > own
    labels_a, starts_a = np.unique(la, return_index=True)
    labels_b, starts_b = np.unique(lb, return_index=True)
    back = np.zeros((len(labels_a), len(B)))
    for label, lo, hi in zip(labels_b, starts_b, np.r_[starts_b[1:], len(lb)]):
        usable = B[lo:hi][np.isfinite(B[lo:hi]).all(axis=1)]
        center = usable.mean(axis=0) if len(usable) else np.zeros(B.shape[1])
        cols = min(hi - lo, SILHOUETTE_COLUMNS)
        rows = max(1, SILHOUETTE_PAIRS // cols)
        total, count = np.zeros(len(A)), np.full(len(A), hi - lo, dtype=np.int64)
        for r in range(0, len(A), rows):
            part = slice(r, min(r + rows, len(A)))
            first = np.searchsorted(starts_a, r, side="right") - 1
            cuts = np.r_[r, starts_a[(starts_a > r) & (starts_a < part.stop)]] - r
            for c in range(lo, hi, cols):
                to = slice(c, min(c + cols, hi))
                d = _pair_distances(A[part], B[to], center)
                if same_block:
                    same = ida[part][:, None] == idb[to][None, :]
                    d[same] = 0.0
                    count[part] -= same.sum(axis=1)
                else:
                    back[first:first + len(cuts), to] += np.add.reduceat(d, cuts, axis=0)
                total[part] += d.sum(axis=1)
        total[spoiled_a] = np.nan
        yield ida, la, np.full(len(A), label, dtype=np.int64), total, count
    if not same_block:
        for k, (label, size) in enumerate(zip(labels_a, np.diff(np.r_[starts_a, len(la)]))):
            sums = back[k] if not len(bad_a) else np.full(len(B), np.nan)
            yield idb, lb, np.full(len(B), label, dtype=np.int64), sums, np.full(len(B), size, dtype=np.int64)


def silhouette(df: DataFrame, id_col: str, label_col: str, features: Sequence[str],
               block: int | None = None) -> DataFrame:
    """Exact mean silhouette (plain euclidean) of a labelled table.

    Rows are split into B hash blocks of at most SILHOUETTE_VALUES numbers;
    ``cogroup`` pairs every block with itself and with those behind it, and
    each task returns, per row of both blocks, the sum and count of distances
    to each label of the other one.  Tasks hold two blocks and
    SILHOUETTE_PAIRS distances at most; the shuffle carries n x (B + 1) rows
    and n x B x k partial sums.  Rows without a label count as 0.
    """
    n, labels = df.agg(F.count(F.lit(1)), F.count_distinct(label_col)).first()
    if block is None:
        # Neither a block's numbers nor its sums, one per row and label, grow beyond bounds.
        largest = min(SILHOUETTE_VALUES // max(1, len(features)),
                      max(SILHOUETTE_VALUES // max(1, labels), math.isqrt(SILHOUETTE_VALUES)))
        # Blocks enough for every core, unless they come out small.
        spread = math.ceil(math.sqrt(6 * df.sparkSession.sparkContext.defaultParallelism))
        nb = max(1, math.ceil(n / max(1, largest)), min(spread, math.ceil(n / SILHOUETTE_BLOCK)))
    else:
        nb = max(1, math.ceil(n / block))
    xs = [f"_x{i}" for i in range(len(features))]
    pts = df.select(F.col(id_col).alias("_id"), F.col(label_col).cast("long").alias("_label"),
                    *[F.col(f).cast("double").alias(x) for x, f in zip(xs, features)],
                    F.pmod(F.xxhash64(F.col(id_col)), F.lit(nb)).cast("int").alias("_blk"))
    usable = reduce(and_, (F.coalesce(F.abs(x) < F.lit(X.INF), F.lit(False)) for x in xs), F.lit(True))
    met = pts.select("*", usable.alias("_usable")).where(F.col("_label").isNotNull() | ~F.col("_usable"))
    met = met.select("_blk", "_id", F.col("_label").isNull().alias("_lost"), F.coalesce("_label", F.lit(0)).alias("_label"),
                     "_usable", *xs)
    cols = [c for c in met.columns if c != "_blk"]
    left = met.select(F.col("_blk").alias("_bi"), F.explode(F.sequence("_blk", F.lit(nb - 1))).alias("_bj"), *cols)
    right = met.select(F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_bi"), F.col("_blk").alias("_bj"), *cols)
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType),
                           T.StructField("_label", T.LongType()), T.StructField("_to", T.LongType()),
                           T.StructField("_sum", T.DoubleType()), T.StructField("_cnt", T.LongType())])

    def partial(key, lp, rp):
        sides = []
        for side in (lp, rp):
            bad = side["_id"][~side["_usable"]].to_numpy()
            side = side[~side["_lost"]]
            labels = side["_label"].to_numpy()
            order = np.argsort(labels, kind="stable")
            # The rows lie one after the other, whatever pandas keeps.
            sides += [np.ascontiguousarray(side[xs].to_numpy(dtype=np.float64)[order]),
                      side["_id"].to_numpy()[order], labels[order], bad]
        with np.errstate(all="ignore"):
            parts = list(_block_sums(*sides, same_block=key[0] == key[1]))
        if not parts:
            return pd.DataFrame({"_id": pd.Series(dtype=lp["_id"].dtype if not lp.empty else "int64"),
                                 "_label": pd.Series(dtype="int64"), "_to": pd.Series(dtype="int64"),
                                 "_sum": pd.Series(dtype="float64"), "_cnt": pd.Series(dtype="int64")})
        ids, own, to, sums, counts = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame({"_id": ids, "_label": own, "_to": to, "_sum": sums, "_cnt": counts})

    # Four slots to a pair, so that few pairs share a task.
    slots = max(1, min(2 * nb * (nb + 1), 64 * df.sparkSession.sparkContext.defaultParallelism))
    left = left.repartition(slots, "_bi", "_bj")
    right = right.repartition(slots, "_bi", "_bj")
    sums = (left.groupBy("_bi", "_bj").cogroup(right.groupBy("_bi", "_bj"))
            .applyInPandas(partial, schema))
    per = sums.groupBy("_id", "_label", "_to").agg(F.sum("_sum").alias("s"), F.sum("_cnt").alias("c"))
    # Both means in one pass, as every read of the sums would measure all pairs again.  An id may come with several labels.
    mean, mine = F.when(F.col("c") > 0, F.col("s") / F.col("c")), F.col("_label") == F.col("_to")
    both = per.groupBy("_id").agg(F.collect_list(F.when(mine, F.struct(mean.alias("a"), F.col("c").alias("own")))).alias("_own"),
                                  F.min(F.when(~mine, mean)).alias("b"))
    ids = pts.select("_id", "_label")
    s = ids.join(both, "_id", "left").select("_label", "b", F.explode_outer("_own").alias("_own")).select("_label", "b", "_own.*")
    sil = F.when((F.coalesce(F.col("own"), F.lit(0)) == 0) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b")))
    return s.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("_label").alias("n_clusters"),
                 F.bround(F.avg(sil), 6).alias("silhouette"))


def silhouette_squared(df: DataFrame, label_col: str, features: Sequence[str]) -> DataFrame:
    """C3 on squared euclidean distances, in O(rows x labels) instead of O(rows squared).

    A row's summed squared distance to a cluster follows from the cluster's
    count, sum vector and sum of squares, so the rows are read twice and never
    shuffled.  The clusters travel in blocks of at most LABEL_BLOCK, one
    broadcast row each.  Rows with a missing value or label are left out; a row
    alone in its cluster, or without another cluster, counts as 0.
    """
    names = [f"_x{i}" for i in range(len(features))]
    pts = df.select(F.col(label_col).cast("long").alias("_label"),
                    *[F.col(f).cast("double").alias(x) for x, f in zip(names, features)]).dropna()
    # Around the common mean (one number per feature) the sums stay small and lose no digits.
    means = pts.agg(*[F.avg(x).alias(x) for x in names]).first()
    pts = cut(pts.select("_label", *[(F.col(x) - F.lit(means[x] or 0.0)).alias(x) for x in names]))
    squares = sum((F.col(x) * F.col(x) for x in names[1:]), F.col(names[0]) * F.col(names[0]))
    clusters = cut(pts.groupBy("_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(squares).alias("q"), F.array(*[F.sum(x) for x in names]).alias("s")))
    blocks = max(1, math.ceil(clusters.count() / LABEL_BLOCK))
    a, b, own = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0).cast("long")
    pts = pts.select("_label", F.array(*names).alias("_v"), squares.alias("_vv"))
    for i in range(blocks):
        part = clusters.where(F.pmod(F.xxhash64("_label"), F.lit(blocks)) == i)
        one = part.agg(F.collect_list(F.struct("_label", "n", "q", "s")).alias("_c"))
        summed = lambda c: (c["n"] * F.col("_vv") + c["q"] - F.lit(2.0) * F.aggregate(
            F.zip_with("_v", c["s"], lambda x, y: x * y), F.lit(0.0), lambda t, z: t + z))
        pts = pts.crossJoin(F.broadcast(one)).withColumn("_d", F.transform("_c", lambda c: F.struct(
            (c["_label"] == F.col("_label")).alias("own"), c["n"].alias("n"), summed(c).alias("d"))))
        mine = F.get(F.filter("_d", lambda c: c["own"]), F.lit(0))
        others = F.array_min(F.transform(F.filter("_d", lambda c: ~c["own"]), lambda c: c["d"] / c["n"]))
        pts = pts.select("_label", "_v", "_vv", *[c for c in (f"_a{i - 1}", f"_b{i - 1}", f"_n{i - 1}") if i],
                         F.coalesce(mine["d"], a).alias(f"_a{i}"), F.coalesce(mine["n"], own).alias(f"_n{i}"),
                         F.least(b, others).alias(f"_b{i}"))
        pts = pts.drop(*[f"_{c}{i - 1}" for c in "abn"])
        a, b, own = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_n{i}")
    a = F.greatest(F.lit(0.0), a) / (F.greatest(own, F.lit(2)) - 1)
    sil = F.when((own < 2) | b.isNull(), F.lit(0.0)).otherwise(X.ieee_div(b - a, F.greatest(a, b)))
    return pts.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("_label").alias("n_clusters"),
                   F.bround(F.avg(F.coalesce(sil, F.lit(0.0))), 6).alias("silhouette"))


def linkage_table(spark, result: ClusterResult) -> DataFrame:
    """(step, left, right, distance, size) of the tuned model's linkage over the centroids that the
    labels came from, plus the colour threshold, the (m - k + 1)-th smallest merge distance."""
    best = result.best

    def run(Xm, w, ids):
        merges = linkage(Xm, w, best["method"], best["metric"])
        idx = min(max(len(Xm) - best["n_clusters"] + 1, 0), len(merges) - 1)
        return pd.DataFrame({"step": np.arange(len(merges), dtype=np.int64), "left": merges[:, 0].astype(np.int64),
                             "right": merges[:, 1].astype(np.int64), "distance": merges[:, 2], "size": merges[:, 3],
                             "color_threshold": float(merges[idx, 2]) if len(merges) else np.nan})

    return _in_one_task(spark, result.micro, best, run,
                        "step long, left long, right long, distance double, size double, color_threshold double")


def top_experiment_counts(grid: DataFrame, top: int = 10) -> DataFrame:
    """How often each method and metric appears among the top experiments."""
    topn = grid.where(F.col("silhouette").isNotNull()).orderBy(F.desc("silhouette"), F.asc("experiment")).limit(top)
    long = topn.select(F.inline(F.array(
        F.struct(F.lit("method").alias("kind"), F.col("method").alias("value")),
        F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("value")))))
    counted = long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("count"))
    total = topn.agg(F.count(F.lit(1)).alias("_n"))
    return counted.crossJoin(F.broadcast(total)).select(
        "kind", "value", "count", F.bround(F.col("count") * F.lit(100.0) / F.col("_n"), 1).alias("pct"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Rows per cluster and their share."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    total = labels.agg(F.count(F.lit(1)).alias("_n"))
    return sizes.crossJoin(F.broadcast(total)).select(
        "cluster", "size", F.bround(F.col("size") * F.lit(100.0) / F.col("_n"), 1).alias("pct"))
