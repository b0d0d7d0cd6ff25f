"""Properties of the isolation forest and of the clustering."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarterlens.operators import anomaly as AN
from quarterlens.operators import cluster as CL


def _blobs(spark, n_out=5, seed=0):
    rng = np.random.default_rng(seed)
    normal = rng.normal(0, 1, size=(300, 3))
    outliers = rng.normal(0, 1, size=(n_out, 3)) + 12.0
    X = np.vstack([normal, outliers])
    pdf = pd.DataFrame(X, columns=["f1", "f2", "f3"])
    pdf.insert(0, "key", [f"k{i}" for i in range(len(X))])
    return spark.createDataFrame(pdf)


def test_forest_flags_planted_outliers(spark):
    df = _blobs(spark)
    model = AN.fit_model(df, ["key"], ["f1", "f2", "f3"], n_estimators=60, contamination=0.05)
    res = AN.predict(df, model, ["key"]).toPandas()
    top = res.sort_values("anomaly_score", ascending=False).head(5)["key"].tolist()
    assert set(top) == {f"k{i}" for i in range(300, 305)}
    share = res["anomaly"].mean()
    assert 0.03 <= share <= 0.07
    again = AN.predict(df, AN.fit_model(df, ["key"], ["f1", "f2", "f3"], n_estimators=60), ["key"]).toPandas()
    assert np.allclose(res.sort_values("key")["anomaly_score"], again.sort_values("key")["anomaly_score"])


def test_path_length_on_hand_tree():
    tree = (np.array([0, -1, -1]), np.array([0.5, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]),
            np.array([4, 1, 3]), np.array([0, 1, 1]))
    h = AN.path_lengths(np.array([[0.0], [1.0]]), tree)
    assert h[0] == 1.0 and np.isclose(h[1], 1.0 + AN.avg_path_length([3])[0])


def test_clustering_recovers_separated_blobs():
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0], [10, 0], [0, 10]])
    X = np.vstack([c + rng.normal(0, 0.5, size=(20, 2)) for c in centers])
    for method, metric in [("ward", "euclidean"), ("average", "euclidean"), ("complete", "euclidean")]:
        labels = CL.cut_maxclust(CL.linkage(X, np.ones(len(X)), method, metric), len(X), 3)
        for g in range(3):
            assert len(set(labels[g * 20:(g + 1) * 20])) == 1
        assert len(set(labels)) == 3


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 2))
    lab = (X[:, 0] > 0).astype(int)
    pdf = pd.DataFrame({"id": range(40), "label": lab, "x0": X[:, 0], "x1": X[:, 1]})
    got = CL.silhouette(spark.createDataFrame(pdf), "id", "label", ["x0", "x1"], block=15).first()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    s = []
    for i in range(40):
        same = (lab == lab[i]); same[i] = False
        a = D[i, same].mean()
        b = D[i, lab != lab[i]].mean()
        s.append((b - a) / max(a, b))
    assert abs(got.silhouette - round(float(np.mean(s)), 6)) < 1e-9
    assert CL.weighted_silhouette(X, np.ones(40), lab + 1) == np.float64(np.mean(s)) or \
        abs(CL.weighted_silhouette(X, np.ones(40), lab + 1) - np.mean(s)) < 1e-12


def test_squared_silhouette_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    X, lab = rng.normal(size=(60, 3)) + 7, rng.integers(0, 5, 60)
    lab[0] = 9                                     # a cluster of one row
    rows = [(int(l), *map(float, x)) for l, x in zip(lab, X)] + [(None, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "label int, x0 double, x1 double, x2 double")
    D = ((X[:, None] - X[None]) ** 2).sum(2)
    s = [0.0]
    for i in range(1, 60):
        own = lab == lab[i]
        own[i] = False
        a, b = D[i, own].mean(), min(D[i, lab == k].mean() for k in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    for block in (CL.LABEL_BLOCK, 2):
        monkeypatch.setattr(CL, "LABEL_BLOCK", block)
        got = CL.silhouette_squared(df, "label", ["x0", "x1", "x2"]).first()
        assert (got.n_points, got.n_clusters) == (60, len(set(lab)))
        assert abs(got.silhouette - np.mean(s)) < 1e-6
    assert CL.silhouette_squared(df.where("label > 99"), "label", ["x0"]).first().n_points == 0


def test_kendall_matches_brute_force(spark):
    from quarterlens.operators import explore as EX
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=80).astype(float)
    y = (x + rng.integers(0, 4, size=80)).astype(float)
    z = rng.normal(size=80)
    x[:30] = 2.0                                   # a hot x value
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    got = {r.variable: r for r in EX.correlation(spark.createDataFrame(pdf), ["x", "y", "z"], "kendall").collect()}

    def tau(u, v):
        du = np.sign(u[:, None] - u[None, :])
        dv = np.sign(v[:, None] - v[None, :])
        iu = np.triu_indices(len(u), 1)
        s = (du * dv)[iu].sum()
        n0 = len(iu[0])
        n1 = (du[iu] == 0).sum()
        n2 = (dv[iu] == 0).sum()
        return s / np.sqrt((n0 - n1) * (n0 - n2))

    for a in ["x", "y", "z"]:
        for b in ["x", "y", "z"]:
            want = 1.0 if a == b else tau(pdf[a].to_numpy(), pdf[b].to_numpy())
            assert abs(got[a][b] - round(float(want), 3)) < 1e-9, (a, b, got[a][b], want)


def test_kendall_counts_across_stretches_and_ties(spark):
    from quarterlens.operators import kendall as KD
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    x[:100], y[50:150] = 7, 3                      # a third of all rows share a value
    rows = [(0, float(a), float(b)) for a, b in zip(x, y)] + [(1, 1.0, 2.0)] * 5 + [(2, float(a), float(-a)) for a in x]
    df = spark.createDataFrame(rows, "pair long, x double, y double")
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    want = (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())
    for bits in (2, KD.STRETCH_BITS):
        got = {r.pair: r.tau for r in KD.tau_b(df, bits).collect()}
        assert abs(got[0] - want) < 1e-12 and got[1] is None and got[2] == -1.0
    assert KD.tau_b(df.where("pair > 9")).count() == 0
