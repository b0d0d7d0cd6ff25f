"""Forests scored as complete trees, quantiles from brackets, silhouette in bounded memory."""

import math

import numpy as np
from pyspark.sql import functions as F

from quarterlens.functions.ranking import quantiles_bracketed, quantiles_long
from quarterlens.operators import anomaly as AN
from quarterlens.operators import cluster as CL


def test_complete_trees_give_the_same_lengths():
    rng = np.random.default_rng(3)
    for psi, d in ((256, 3), (50, 2), (2, 1), (1, 1), (40, 2)):
        sample = np.round(rng.normal(size=(psi, d)), 1)
        depth = AN._tree_depth_limit(psi)
        tree = AN.grow_tree(sample, rng, depth)
        X = np.vstack([rng.normal(size=(500, d)), sample, np.full((1, d), np.inf), np.full((1, d), -np.inf)])
        assert (AN.path_lengths(X, tree) == AN.heap_lengths(np.ascontiguousarray(X.T), AN.heap_tree(tree, depth))).all()


def test_bracketed_quantiles_are_exact(spark):
    df = spark.range(30000).select((F.col("id") % 3).cast("int").alias("g"), F.when(
        F.col("id") % 3 == 2, F.lit(7.0)).otherwise((F.col("id") * 7919 % 10007) / 3.0).alias("v"))
    df = df.union(spark.createDataFrame([(9, 1.0), (9, 2.0), (9, None), (8, None)], df.schema))
    probs = [0.0, 0.01, 0.05, 0.5, 1.0]
    rows = lambda q: sorted(map(tuple, q.select("g", "p", "q").collect()))
    assert rows(quantiles_bracketed(df, "v", probs, ["g"])) == rows(quantiles_long(df, "v", probs, ["g"]))


def test_grid_scores_are_those_of_the_rows(spark):
    rng = np.random.default_rng(5)
    data = [(str(i), *map(float, rng.normal(size=2))) for i in range(120)] + [(None, None, 1.0), ("0", 3.0, 3.0)]
    df = spark.createDataFrame(data, "k string, a double, b double")
    fit = AN.fit_forests(df, ["k"], [("a", "b")], ("auto", 20), 12)
    long = AN.score_rows(df, fit, ["k"], tree_counts=[5, 12]).select("forest", "T", "s")
    grid = AN.grid_scores(df, ["a", "b"], AN._scorers(fit, fit.specs, [5, 12], spark))
    assert "k" not in grid.columns
    assert sorted(map(tuple, grid.select("forest", "T", F.explode("s")).collect())) == sorted(map(tuple, long.collect()))


def _plain_silhouette(X, labels):
    D, s = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2)), []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(X)) != i)
        if not mine.any():
            s.append(0.0)
            continue
        a, b = D[i, mine].mean(), min(D[i, labels == c].mean() for c in set(labels) if c != own)
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_over_several_blocks(spark):
    rng = np.random.default_rng(7)
    X, labels = rng.normal(size=(150, 4)), np.r_[rng.integers(0, 4, 149), 9]
    df = spark.createDataFrame([(i, int(c), *map(float, x)) for i, (x, c) in enumerate(zip(X, labels))],
                               "id long, label int, a double, b double, c double, d double")
    r = CL.silhouette(df, "id", "label", ["a", "b", "c", "d"], block=40).first()
    assert (r["n_points"], r["n_clusters"]) == (150, 5) and math.isclose(r["silhouette"], _plain_silhouette(X, labels), abs_tol=2e-6)


def test_silhouette_block_stays_small():
    """The distances of two blocks with many features never stand in memory at once."""
    import inspect
    assert "[:, None, :]" not in inspect.getsource(CL.silhouette)
    assert CL.SILHOUETTE_PAIRS * 8 * 4 < 8 << 20


def test_distances_by_products_keep_their_digits():
    """Tight clusters far from each other and from zero, equal rows, extreme and missing values."""
    rng = np.random.default_rng(3)
    far = np.r_[rng.normal(size=(60, 5)) * 1e-3 + 1e6, rng.normal(size=(60, 5)) * 1e-3 - 1e6, np.full((9, 5), 3.0)]
    for X in (far, far * 1e-200, far * 1e200, np.r_[far, [[np.nan, 1, 1, 1, 1], [np.inf, 1, 1, 1, 1]]]):
        with np.errstate(all="ignore"):
            got, gaps = CL._pair_distances(X, X, X[0]), [x - X for x in X]
            np.testing.assert_allclose(got, [np.sqrt((g * g).sum(axis=1)) for g in gaps], rtol=1e-7)


def test_block_sums_serve_both_blocks(monkeypatch):
    monkeypatch.setattr(CL, "SILHOUETTE_PAIRS", 60)
    monkeypatch.setattr(CL, "SILHOUETTE_COLUMNS", 7)
    rng = np.random.default_rng(5)
    A, la, B, lb = rng.normal(size=(31, 3)), np.sort(rng.integers(0, 4, 31)), rng.normal(size=(40, 3)), np.sort(rng.integers(2, 6, 40))
    ida, idb = np.arange(31), 100 + np.arange(40)
    ida[4] = ida[3]  # an id that comes twice doesn't meet itself

    def found(parts):
        return {(i, p, c): (round(s, 9), n) for ids, _, to, sums, counts in parts
                for p, (i, c, s, n) in enumerate(zip(ids.tolist(), to.tolist(), sums.tolist(), counts.tolist()))}

    def want(X, ids, Y, idy, ly):
        D, out = np.sqrt(((X[:, None] - Y[None]) ** 2).sum(axis=2)), {}
        for p, i in enumerate(ids.tolist()):
            for c in set(ly.tolist()):
                other = (ly == c) & (idy != i)
                out[i, p, c] = (round(float(D[p, other].sum()), 9), int(other.sum()))
        return out

    close = lambda x, y: x.keys() == y.keys() and all(abs(x[k][0] - y[k][0]) < 1e-8 and x[k][1] == y[k][1] for k in x)
    none = ida[:0]
    assert close(found(CL._block_sums(A, ida, la, none, A, ida, la, none, True)), want(A, ida, A, ida, la))
    assert close(found(CL._block_sums(A, ida, la, none, B, idb, lb, none, False)),
                 want(A, ida, B, idb, lb) | want(B, idb, A, ida, la))


def test_silhouette_with_missing_values(spark):
    """A missing value leaves all that meet it without sums, with a label or without; rows without a label alone do not."""
    rows = [(1, 0, 0.0), (2, 0, 1.0), (3, 1, 5.0), (4, 1, 6.0)]
    schema = "id long, label int, x double"
    whole = CL.silhouette(spark.createDataFrame([*rows, (5, None, 2.0)], schema), "id", "label", ["x"]).first()
    assert whole["n_points"] == 5 and whole["n_clusters"] == 2 and whole["silhouette"] > 0.6
    for bad in ((5, 1, None), (5, None, None), (5, None, float("nan"))):
        got = CL.silhouette(spark.createDataFrame([*rows, bad], schema), "id", "label", ["x"]).first()
        assert (got["n_points"], got["n_clusters"], got["silhouette"]) == (5, 2, 0.0)


def test_silhouette_measures_each_pair_once(spark):
    """The sums over pairs stand once in the plan, each pair of blocks in one task; ids may repeat, labels be missing."""
    rows = [(1, 0, 0.0), (1, 0, 0.5), (2, 0, 1.0), (3, 1, 5.0), (4, 1, 6.0), (5, None, 9.0), (6, 2, 2.0), (4, 0, 0.2)]
    df = spark.createDataFrame(rows, "id long, label int, x double")
    one = CL.silhouette(df, "id", "label", ["x"], block=3)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1

    pairs = {}  # per (id, label): all its rows' distances to other ids, by label
    for i, own, x in rows:
        for j, c, y in rows:
            if i != j and own is not None and c is not None:
                pairs.setdefault((i, own), {}).setdefault(c, []).append(abs(x - y))
    want = []
    for i, _, _ in rows:
        mine = [(own, to) for (k, own), to in pairs.items() if k == i]
        b = min((float(np.mean(d)) for own, to in mine for c, d in to.items() if c != own), default=None)
        want += [0.0 if own not in to or b is None else (b - np.mean(to[own])) / max(b, np.mean(to[own]))
                 for own, to in mine] or [0.0]
    r = one.first()
    assert r["n_points"] == len(want) and math.isclose(r["silhouette"], float(np.mean(want)), abs_tol=2e-6)
