"""Local covariance and distances against plain numpy."""

import numpy as np
import pytest

from quernal.functions import comparisons
from quernal.operators import clusters, distances


def brute_cov(x):
    x = x - np.nanmean(x, 1, keepdims=True)
    d = x.shape[1]
    out = np.empty((d, d))
    for i in range(d):
        for j in range(d):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            out[i, j] = np.cov(x[both, i], x[both, j])[0, 1]
    return out


def windows(spark):
    rng = np.random.default_rng(3)
    x = {w: np.where(rng.random((40, 5)) < 0.1, np.nan, rng.integers(0, 3, (40, 5))) for w in range(4)}
    rows = [(w, [None if np.isnan(v) else float(v) for v in r]) for w, m in x.items() for r in m] + [(9, [1.0, None, 0.0, 2.0, 1.0]), (None, [1.0] * 5), (1, None)]
    return x, spark.createDataFrame(rows, "w long, v array<double>").repartition(3)


def test_window_eigen_and_local_distance(spark, monkeypatch):
    x, df = windows(spark)
    got = distances.window_eigen(df, "w", "v")
    by = {r.w: r for r in got.collect()}
    assert by[9].lam is None and by[9].sites == 1 and set(by) == {0, 1, 2, 3, 9}
    low = {}
    for w, m in x.items():
        cov = brute_cov(m)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        assert by[w].lam == pytest.approx(values[:2]) and by[w].total == pytest.approx((cov**2).sum())
        assert by[w].shares == pytest.approx(values[:2] / values[values > 0].sum())
        scaled = values[:2] / np.abs(values[:2]).sum()
        low[w] = (vectors[:, :2] * scaled) @ vectors[:, :2].T
    monkeypatch.setattr(distances, "ROWS", 2)
    from pyspark.sql import functions as F

    pairs = {(r.a, r.b): r.distance for r in distances.local_structure_distance(got.withColumn("k", F.lit(1)), "k", "w").collect()}
    assert len(pairs) == 10 and all(pairs[a, 9] is None for a in range(4))
    for a in range(4):
        for b in range(a + 1, 4):
            assert pairs[a, b] == pytest.approx(np.linalg.norm(low[a] - low[b]), abs=1e-9)


def test_dosage_distance(spark):
    df = spark.createDataFrame([("g", 1, [0.0, 2.0, None]), ("g", 2, [1.0, 2.0, 2.0]), ("g", 2, [1.0, 2.0, 2.0]), ("g", 3, None), ("h", 4, [1.0])], "k string, s int, v array<double>")
    assert sorted((r.a, r.b, round(r.distance, 9)) for r in distances.dosage_distance(df, "k", "s", "v").collect()) == [(1, 2, round(2 / 3, 9))] * 2
    assert distances.dosage_distance(df.where("s > 9"), "k", "s", "v").count() == 0


def test_pairwise_rank_tests(spark):
    """Two small groups without ties are exact: 3 against 3, all apart, has p = 2 / 20; equal values leave z and p null."""
    rows = [("k", g, float(v)) for g, vs in {"a": [1, 2, 3], "b": [4, 5, 6], "c": [4, 5, 6]}.items() for v in vs] + [("k", None, 1.0), ("k", "a", None), ("m", "a", 1.0), ("m", "b", 1.0)]
    got = {(r.key, r.a, r.b): r for r in comparisons.pairwise_ranks(spark.createDataFrame(rows, "key string, g string, v double"), ["key"], "g", "v").collect()}
    assert got["k", "a", "b"].u == 0 and got["k", "a", "b"].p == pytest.approx(0.1) and got["k", "a", "b"].q == pytest.approx(0.15)
    assert got["k", "b", "c"].p == pytest.approx(1.0)
    assert got["m", "a", "b"].p is None and got["m", "a", "b"].q is None


def test_co_association(spark):
    rows = [("k", 2.0, [0, 1, 1], [2, 3]), ("k", 1.0, [2], [0, 3, None]), ("k", 0.0, [0, 3], []), ("k", 1.0, None, [2, 3]), ("k", 4.0, [], None)]
    df = spark.createDataFrame(rows, "k string, w double, i array<int>, o array<int>")
    got = lambda rule=None: {(r.a, r.b): (r.together, r.apart) for r in comparisons.co_association(df, ["k"], "w", "i", "o", rule).collect()}
    plain = {(0, 1): (2, 0), (0, 2): (0, 3), (0, 3): (1, 2), (1, 2): (0, 2), (1, 3): (0, 2), (2, 3): (3, 1)}
    assert got() == plain
    assert got(lambda a, b: (a == 2) & (b == 3)) == plain | {(2, 3): (0, 4)}
    assert comparisons.co_association(df.where("w > 9"), ["k"], "w", "i", "o").count() == 0


def test_trajectory_clusters_against_merge_costs(spark):
    """On one line Ward's distance is the cost of a merge by sizes and means; three equal places triple it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=14)
    sets = [[i] for i in range(14)]
    while len(sets) > 4:
        cost = lambda p, q: len(p) * len(q) / (len(p) + len(q)) * (x[p].mean() - x[q].mean()) ** 2
        i, j = min(((i, j) for i in range(len(sets)) for j in range(i)), key=lambda ij: cost(sets[ij[0]], sets[ij[1]]))
        sets[j] += sets.pop(i)
    rows = [("a", i, [float(v)] * 3 + [None]) for i, v in enumerate(x)] + [("b", i, [0.0, 1.0, 2.0]) for i in range(3)] + [("c", i, [1.0, None, 2.0]) for i in range(5)] + [("a", 99, None), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, "g string, s int, v array<double>")
    got = {}
    for r in clusters.trajectory_clusters(df, "g", "s", "v", k=4).collect():
        got.setdefault(r.g, {})[r.s] = r.cluster
    assert {frozenset(i for i in got["a"] if got["a"][i] == c) for c in range(4)} == {frozenset(s) for s in sets}
    assert got["a"][0] == 0 and 99 not in got["a"] and set(got["b"].values()) == {None} and set(got["c"].values()) == {None}
