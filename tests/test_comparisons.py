"""Rank tests, clusterings and annotation readers against brute force and small files."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernal.functions import comparisons
from quernal.operators import clusters
from quernal.sources import annotation


def test_chi_square_tail(spark):
    got = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (9.487729036781154, 4), (0.0, 2), (1.0, 0)], "x double, k int").select(comparisons.chi_square_survival("x", "k").alias("p")).collect()
    assert [r.p is None for r in got] == [False] * 5 + [True]
    assert [round(r.p, 9) for r in got[:5]] == [0.05, 0.05, 0.05, 0.05, 1.0]


def test_mann_whitney_counts_pairs(spark):
    rows = [("a", True, 3.0), ("a", True, 5.0), ("a", False, 3.0), ("a", False, 1.0), ("b", True, 2.0), ("b", True, None), ("c", True, 1.0), ("c", False, 1.0)]
    got = {r.k: r for r in comparisons.mann_whitney(spark.createDataFrame(rows, "k string, g boolean, v double"), ["k"], "g", "v").collect()}
    assert got["a"].u == 3.5 and got["a"].n1 == got["a"].n0 == 2
    assert got["b"].u == 0 and got["b"].z is None and got["c"].z is None


def test_pairs_within_reach_are_each_found_once(spark):
    at = [0, 0, 4, 5, 9, 10, 11, 25]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "id int, at int")
    got = sorted((r.a_id, r.b_id) for r in comparisons.pairs_within(df, [], "at", "id", 5, []).collect())
    assert got == sorted((i, j) for i, j in itertools.combinations(range(len(at)), 2) if at[j] - at[i] <= 5)


def test_linkage_with_missing_and_constant(spark):
    v = [[0.0, 1.0, 2.0, 1.0], [0.0, 1.0, 2.0, None], [1.0, 1.0, 1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(v)), "id int, v array<double>")
    got = {(r.a, r.b): r for r in comparisons.linkage_r2(df, [], "id", "id", "v", 2).collect()}
    z0 = (np.array(v[0]) - 1) / np.std(v[0])
    z1 = np.append((np.array(v[1][:3]) - 1) / np.std(v[1][:3]), 0)
    assert got[0, 1].r2 == pytest.approx((z0 @ z1 / 4) ** 2) and got[0, 2].r2 == 0
    assert got[0, 1].r2_byte == math.floor(got[0, 1].r2 * 255 + 0.5)


def test_silhouette_against_pairs():
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=40), rng.integers(0, 3, 40)
    want = []
    for i in range(40):
        mean = [np.abs(x[i] - x[(label == c) & (np.arange(40) != i)]).mean() for c in range(3)]
        other = min(m for c, m in enumerate(mean) if c != label[i])
        want.append((other - mean[label[i]]) / max(other, mean[label[i]]))
    assert clusters.silhouette_1d(x, label, 3) == pytest.approx(np.mean(want))


def test_assignment_against_all_orders():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 5):
        for _ in range(20):
            m = rng.integers(0, 4, (k, k))
            best = max(itertools.permutations(range(k)), key=lambda p: (sum(m[i, c] for i, c in enumerate(p)), [-c for c in p]))
            assert clusters.best_assignment(m) == list(best)


def test_set_partitions_are_bell_numbers():
    assert [len(clusters.set_partitions(n)) for n in range(6)] == [1, 1, 2, 5, 15, 52]
    assert clusters.set_partitions(9) is None


def test_clusterings_find_planted_groups(spark):
    x = [0.0, 0.1, 0.2, 0.3, 10.0, 10.1, 10.2, 10.3, 20.0, 20.1, 20.2, 20.3]
    df = spark.createDataFrame([("k", i, v, 0.0) for i, v in enumerate(x)] + [("one", 0, 1.0, 0.0), ("one", 1, None, 0.0)], "k string, id int, v double, w double")
    planted = [0] * 4 + [1] * 4 + [2] * 4
    for out, c in ((clusters.adaptive_k(df, "k", "id", "v"), "cluster"), (clusters.gaussian_mixture_1d(df, "k", "id", "v"), "component"), (clusters.kmeans_2d(df, "k", "id", "v", "w"), "cluster"), (clusters.average_linkage(df, "k", "id", "v", 3), "cluster")):
        got = [r[c] for r in out.where("k = 'k'").orderBy("id").collect()]
        assert got == planted
        assert out.where("k = 'one'").count() == 1
    r = clusters.theil_sen(spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 90.0), ("b", 1.0, 1.0)], "k string, x double, y double"), "k", "x", "y")
    got = {x.k: x.slope for x in r.collect()}
    assert 2 <= got["a"] <= 30 and got["b"] is None


def test_density_clusters_against_all_pairs():
    """As by the whole matrix of distances, with copies, ties and chains; a large group in bounded memory."""

    def brute(v, neighbours):
        n = len(v)
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
        k = min(neighbours, n - 1)
        eps = 0.8 * float(np.median(np.sort(d, 1)[:, k])) if k > 0 else 0.0
        eps = eps if eps > 0 else 0.5
        close = d <= eps
        core = close.sum(1) >= max(3, int(np.ceil(0.08 * n)))
        label, count = np.full(n, -1), 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                label[i], queue = count, [i]
                while queue:
                    for j in np.flatnonzero(close[queue.pop()] & (label < 0)):
                        label[j] = count
                        queue += [j] * bool(core[j])
                count += 1
        return label, eps

    rng = np.random.default_rng(4)
    found = set()
    for trial in range(120):
        n = int(rng.integers(1, 70)) if trial % 10 else 900
        v = [rng.normal(size=(n, 2)), rng.integers(0, 6, (n, 2)) / 4, rng.integers(0, 3, (n, 1)) * 5 + rng.normal(size=(n, 2)) * [1, 0], np.repeat(rng.normal(size=(-(-n // 7), 2)), 7, 0)[:n]][trial % 4].astype(float)
        if trial % 12 == 5:
            v[rng.integers(n), rng.integers(2)] = [np.nan, np.inf][trial % 24 > 12]
        v = v[np.lexsort((v[:, 1], v[:, 0]))]
        with np.errstate(invalid="ignore"):
            got, want = clusters.dbscan(v, 5), brute(v, 5)
        assert (got[0] == want[0]).all() and got[1] == want[1]
        found.add(int(want[0].max()))
    assert max(found) > 0
    v = np.sort(rng.normal(size=(20_000, 2)), 0)
    tracemalloc.start()
    label, eps = clusters.dbscan(v, 5)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and len(label) == len(v) and eps > 0
    tracemalloc.stop()


def test_median_slope_against_all_pairs():
    """As by all pairs at once, with copies, ties and one flat line; a large group in bounded memory."""

    def brute(a, b):
        i, j = np.triu_indices(len(a), 1)
        step = a[j] - a[i]
        use = step != 0
        return float(np.median((b[j] - b[i])[use] / step[use])) if use.any() else None

    rng = np.random.default_rng(6)
    for trial in range(200):
        n = int(rng.integers(1, 60))
        a = [rng.normal(size=n), rng.integers(0, 9, n), rng.integers(0, 50, n), np.repeat(rng.normal(size=-(-n // 5)), 5)[:n]][trial % 4].astype(float)
        b = [rng.normal(size=n) * 1e3, rng.integers(0, 1000, n) / 10 + 900, np.full(n, 3.3), a * 0.1, np.repeat(rng.normal(size=-(-n // 5)), 5)[:n]][trial % 5].astype(float)
        if trial % 20 == 7:
            b[rng.integers(n)] = np.inf
        if trial % 20 == 13:
            [a, b][trial % 40 > 20][rng.integers(n)] = np.nan
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        with np.errstate(invalid="ignore"):
            want = brute(a, b)
        for listed in (1 << 22, 40, 3):
            got = clusters.median_slope(a, b, listed)
            assert got == want or np.isnan(got) and np.isnan(want), (trial, listed)
    a, b = np.sort(rng.normal(size=20_000)), rng.normal(size=20_000)
    tracemalloc.start()
    slope = clusters.median_slope(a, b, 1 << 18)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    i, step = rng.integers(0, len(a) // 2, (2, 400_000))
    j = i + step + 1
    assert np.mean((b[j] - b[i]) / (a[j] - a[i]) < slope) == pytest.approx(0.5, abs=0.01)


def test_local_ancestry_moves_to_the_right_component():
    f = np.array([[0.99, 0.01]] * 20)
    like = np.zeros((20, 12, 3))
    like[:, :6, 2] = 1
    like[:, 6:, 0] = 1
    q = clusters.local_ancestry(like, f, np.full((12, 2), 0.5))
    assert np.allclose(q.sum(1), 1) and np.isfinite(q).all()
    assert (q[:6, 0] > 0.9).all() and (q[6:, 1] > 0.9).all()
    assert (clusters.local_ancestry(like[:4], f[:4], np.full((12, 2), 0.5)) == 0.5).all()


def test_repeat_and_alignment_files(spark, tmp_path):
    out = tmp_path / "x.out"
    out.write_text("   SW  perc perc\nscore  div. del.\n\n  463 1.3 0.6 1.7 chr1 10001 10468 (99) + AAT Simple/Low 1 463 0 1\n 12 1 1 1 chr2 5 9 (1) C Alu SINE 1 2 3 4\n 7 short\n")
    got = [tuple(r) for r in annotation.repeatmasker(spark, str(out)).orderBy("chrom").collect()]
    assert got == [("chr1", 10000, 10468, "AAT", "463", "+", "Simple", "Low"), ("chr2", 4, 9, "Alu", "12", "-", "SINE", "NA")]
    assert annotation.sniff_format(spark, str(out)) == "repeatmasker_out" and annotation.sniff_format(spark, "a/b.TEanno.gff3.gz") == "edta_anno" and annotation.sniff_format(spark, "x.txt") == "unknown"
    p = tmp_path / "x.paf"
    line = lambda *x: "\t".join(map(str, x))
    p.write_text("\n".join([line("q", 9, 0, 9, "+", "t1", 9, 5, 8, 3, 4, 60), line("q", 9, 0, 9, "-", "t1", 9, 1, 4, 1, 4, 60), line("q", 9, 0, 9, "-", "t2", 9, 0, 2, 2, 2, 60), line("q", 1), line("q", 9, 0, 9, "+", "t3", 9, "x", 2, 2, 2, 60)]))
    targets, whole = annotation.alignment_classes(annotation.paf(spark, str(p)))
    assert sorted(map(tuple, targets.collect())) == [("q", "t1", 1, 8, "?", 2), ("q", "t2", 0, 2, "-", 1)]
    assert [(r["class"], r.n_blocks, round(r.identity, 6)) for r in whole.collect()] == [("1-2", 3, round(200 / 3, 6))]


def test_likelihood_files(spark, tmp_path):
    b = tmp_path / "x.beagle"
    b.write_text("marker allele1 allele2 Ind0 Ind0 Ind0 Ind1 Ind1 Ind1\nC_gar_LG01_77 0 1 0.1 0.2 0.7 1 0 0\nchr1:9_A 2 3 0 1 0 0 0 1\n")
    got = {r.marker: r for r in annotation.beagle(spark, str(b)).collect()}
    assert got["C_gar_LG01_77"].chrom == "C_gar_LG01" and got["C_gar_LG01_77"].pos == 77 and (got["chr1:9_A"].chrom, got["chr1:9_A"].pos) == ("chr1", 9)
    assert [tuple(x) for x in got["C_gar_LG01_77"].likelihoods] == [(0.1, 0.2, 0.7), (1.0, 0.0, 0.0)]
    b.write_text("marker allele1 allele2 Ind0 Ind0 Ind1\n")
    with pytest.raises(ValueError):
        annotation.beagle(spark, str(b))
    t = tmp_path / "s1.win.pestPG"
    t.write_text("#h\n" + "\t".join(["(0,1)", "c", "50", "1", "4.0", *["0"] * 8, "8"]) + "\n" + "\t".join(["(0,1)", "c", "60", "1", "4.0", *["0"] * 8, "0"]) + "\n")
    assert [tuple(r) for r in annotation.window_theta(spark, str(t)).orderBy("center").collect()] == [("s1", "c", 50, 0.5, 8), ("s1", "c", 60, None, 0)]


def test_runs_join_across_lines(spark):
    rows = [("c", 0, "NNac"), ("c", 4, "gtAC"), ("c", 8, "GTnn"), ("d", 0, "AC")]
    got = sorted(map(tuple, annotation.sequence_runs(spark.createDataFrame(rows, "chrom string, offset long, bases string")).collect()))
    assert got == [("c", 0, 2, "hard"), ("c", 2, 6, "soft"), ("c", 6, 10, "plain"), ("c", 10, 12, "hard"), ("d", 0, 2, "plain")]


def test_layers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "k1", 1, [1.5]), ("c2", "k2", None, [])], "chrom string, candidate string, n int, v array<double>")
    path = str(tmp_path / "layers")
    annotation.write_layers(df, path, ["chrom", "candidate"], "sv_evidence_v1")
    back = annotation.read_layers(spark, path, "chrom string, candidate string, format_version string, payload struct<n:int,v:array<double>>")
    assert sorted((r.chrom, r.candidate, r.payload.n, r.payload.v) for r in back.collect()) == [("c1", "k1", 1, [1.5]), ("c2", "k2", None, [])]
    with pytest.raises(ValueError):
        annotation.write_layers(df, path + "2", ["chrom"], "nonsense")
