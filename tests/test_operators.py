"""Boundary and structure tests of operators that queries alone do not pin down."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quernal.functions import scalars, stats
from quernal.operators import graph, intervals, kernels, rules, windows
from quernal.plans.registry_plane import ResultRegistry
from quernal.sources import genomic
from quernal.streaming import events


def test_genotype_and_variant_classes(spark):
    rows = [("0/0", "HOM_REF"), ("1|1", "HOM_VAR"), ("2/2", "HOM_VAR"), ("0/1", "HET"), ("1|2", "HET"), ("./.", "OTHER"), ("0/.", "OTHER"), (None, "OTHER")]
    df = spark.createDataFrame(rows, "gt string, want string")
    assert df.where(~rules.genotype_class(F.col("gt")).eqNullSafe(F.col("want"))).count() == 0
    v = spark.createDataFrame([("A", "T", "SNP"), ("A", "AT", "INS"), ("AT", "A", "DEL"), ("AT", "GC", "OTHER")], "r string, a string, want string")
    assert v.where(rules.variant_type(F.col("r"), F.col("a")) != F.col("want")).count() == 0


def test_ladders_take_the_bound_itself_and_nulls_fail(spark):
    df = spark.createDataFrame([(0.69,), (0.70,), (None,)], "x double")
    assert [r[0] for r in df.select(rules.ladder(F.col("x"), [(0.70, "high")], "low")).collect()] == ["low", "high", "low"]
    kept = df.where(rules.only_if_present(F.col("x"), F.col("x") >= 0.7))
    assert kept.count() == 2


def test_gate_demotes_first(spark):
    order = ["NONE", "UNCERTAIN", "SUPPORTED", "VALIDATED"]
    df = spark.createDataFrame([("UNCERTAIN", 0.049, 5.1, False), ("UNCERTAIN", 0.051, 5.1, False), ("VALIDATED", 0.001, 9.0, True)], "level string, p double, odds double, bad boolean")
    gate = rules.capped_gate(F.col("level"), [((F.col("p") < 0.05) & (F.col("odds") > 5), "VALIDATED")], order, F.col("bad"))
    assert [r[0] for r in df.select(gate).collect()] == ["VALIDATED", "UNCERTAIN", "SUSPECT"]


def test_intervals_touching_do_not_overlap(spark):
    a = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 10, 20), ("c", 3, 5, 5)], "key string, id long, start long, end long")
    assert intervals.overlap_join(a, a, ["key"], 4).where("l_id < r_id").count() == 0
    assert {r.island for r in intervals.islands(a.where("id < 3"), ["key"]).collect()} == {1}


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [("k", i, s := rng.randrange(500), s + rng.randrange(1, 90)) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, id long, start long, end long")
    want = {(a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in rows for b in rows if a[2] < b[3] and b[2] < a[3]}
    for width in (7, 64, 1000):
        got = intervals.overlap_join(df, df, ["key"], width).select("l_id", "r_id", "overlap").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_fisher_against_enumeration(spark):
    tables = [(3, 1, 1, 3), (10, 0, 2, 8), (0, 0, 5, 5), (7, 7, 7, 7)]

    def exact(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        if r in (0, n) or k in (0, n):
            return 1.0
        p = {x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r) for x in range(max(0, r - n + k), min(r, k) + 1)}
        return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-9)))

    got = stats.fisher_exact(spark.createDataFrame(tables, "a long, b long, c long, d long"), "a", "b", "c", "d", 40).collect()
    assert all(abs(r.p - exact(r.a, r.b, r.c, r.d)) < 1e-9 for r in got)


def test_fisher_of_large_tables(spark):
    tables = [(5000, 5000, 5000, 5000), (9000, 9300, 9500, 9100), (300, 40_000, 200, 60_000), (0, 30_000, 12, 20_000)]
    rows = [(*t, k) for k, t in enumerate(tables)]
    got = {r.k: r.p for r in stats.fisher_exact(spark.createDataFrame(rows, "a long, b long, c long, d long, k long"), "a", "b", "c", "d").collect()}
    for k, (a, b, c, d) in enumerate(tables):
        r1, c1, n = a + b, a + c, a + b + c + d
        log = {x: sum(map(math.lgamma, (r1 + 1, n - r1 + 1, c1 + 1, n - c1 + 1))) - sum(map(math.lgamma, (n + 1, x + 1, r1 - x + 1, c1 - x + 1, n - r1 - c1 + x + 1))) for x in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
        assert math.isclose(got[k], min(1.0, sum(math.exp(v) for v in log.values() if v <= log[a] + 1e-7)), rel_tol=1e-6)


def test_components_of_chains_rings_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 299)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and got[102] == 100 and got[200] == 200 and got[300] == 299


def test_pruning_leaves_no_edge(spark):
    rng = random.Random(1)
    edges = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(40)) if a < b]
    gone = {r.node for r in graph.prune_by_degree(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(a in gone or b in gone for a, b in edges)


def test_degree_pruning_takes_every_edge(spark, tmp_path):
    from quernal.plans import kernel_queries

    rng = random.Random(2)
    lines = [(p, rng.randrange(12), float(rng.choice((10, 49, 50)))) for p in range(60) for _ in range(4)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    by_part: dict = {}
    for p, s, q in lines:
        if q >= 49:
            by_part.setdefault(p, set()).add(s)
    near: dict = {}
    for a, b in (s for s in by_part.values() if len(s) == 2):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    while any(near.values()):
        worst = min(near, key=lambda n: (-len(near[n]), n))
        want.add(worst)
        for other in near.pop(worst):
            near[other].discard(worst)
    assert {r.node for r in kernel_queries.degree_pruning(spark, str(tmp_path)).collect()} == want


def test_kernels(spark):
    rows = [("g", i, [float(i), 2.0 * i + (i % 3) * 0.01], float(i // 10 * 100 + i % 10)) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, id long, v array<double>, x double")
    assert all(r.shares[0] > 0.99 for r in kernels.pca(df, "key", "id", "v").collect())
    assert {r.id // 10: r.cluster for r in kernels.kmeans_1d(df, "key", "id", "x").collect()} == {0: 0, 1: 1, 2: 2}
    points = {r.id: r.point for r in kernels.classical_mds(df, "key", "id", "v").collect()}
    assert abs(math.dist(points[0], points[29]) - math.dist(rows[0][2], rows[29][2])) < 1e-6


def test_scalars(spark):
    df = spark.createDataFrame([("ACGT", "GTAA", " a; b;;a ")], "l string, r string, t string")
    r = df.select(scalars.microhomology(F.col("l"), F.col("r"), 3).alias("m"), scalars.terms(F.col("t")).alias("t"), scalars.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("z"), scalars.safe_log2(F.lit(-1.0)).alias("g")).first()
    assert (r.m, r.t, r.z, r.g) == (2, ["a", "b"], None, None)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\nchr1\t5\t9\tte\t0\t+\tLINE\nchr2\tbad\t7\n")
    assert [tuple(r)[:4] for r in genomic.bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 9, "te")]
    (tmp_path / "a.gff3").write_text("##gff\nchr1\tsrc\trepeat\t1\t10\t.\t+\t.\tID=r1;Name=x\n")
    g = genomic.gff3(spark, str(tmp_path / "a.gff3")).first()
    assert (g.start, g.end, g.attributes["ID"]) == (0, 10, "r1")
    (tmp_path / "a.vcf").write_text("##v\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nc\t7\t.\tA\tT,G\t9.5\t\tSVTYPE=DEL;X\tGT:DP\t0/1:3\t./.:0\n")
    v = genomic.vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (v.pos, v.id, v.alt, v.filter, v.info["SVTYPE"], v.genotypes) == (7, "c:7:DEL", "T", "PASS", "DEL", {"S1": "0/1", "S2": "./."})
    picked = genomic.pick_columns(spark.createDataFrame([(1,)], "position long"), {"pos": ["pos", "position"], "chrom": ["chr"]}).first()
    assert (picked.pos, picked.chrom) == (1, None)


def test_registry_refuses_unknown_groups(spark):
    groups = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s2")], "group_id string, sample_id string")
    manifest = spark.createDataFrame([("pair", "c1", "a", "b", "fst")], "kind string, chrom string, group_1 string, group_2 string, stat string")
    r = ResultRegistry(manifest, groups)
    assert r.ask(who="b", what="fst").count() == 1 and r.ask(where="c2").count() == 0
    assert r.overlap("a", "b").first().jaccard == 0.5
    with pytest.raises(ValueError):
        r.append(manifest.withColumn("group_1", F.lit("zzz")))
    assert r.append(manifest).manifest.count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    for _ in range(240):
        if not q.isActive:
            break
        time.sleep(0.5)
    assert not q.isActive
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert spark.table("windowed").count() == want.count()


def test_adjusted_p_is_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, 1.0])], "id long, p double")
    got = [r.q for r in windows.benjamini_hochberg(df, "p").orderBy("id").collect()]
    assert [round(q, 6) for q in got] == [0.05, 0.066667, 0.066667, 0.625, 1.0]
