"""Region requests, and readers and writers of tables, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quernal.plans import region_plane as rp
from quernal.sources import tabular as tb


@pytest.fixture(scope="module")
def store(spark):
    rows = [("LG1", p, p // 10, *[None if (p + s) % 11 == 0 else float((p // 10 * (s + 1)) % 3) for s in range(6)]) for p in range(0, 1000, 10)]
    return spark.createDataFrame(rows + [("LG2", 5, 999, *[0.0] * 6)], "chrom string, pos long, id long, " + ", ".join(f"s{i} double" for i in range(6)))


def test_region_modes(store):
    for mode in ("even", "random", "variance", "hybrid"):
        got = [r.pos for r in rp.sites(store, rp.Region("LG1", 0, 995, mode, 12)).collect()]
        assert got == sorted(set(got)) and 8 <= len(got) <= 12
    assert rp.sites(store, rp.Region("LG1", 0, 95, "raw", 10)).count() == 10
    with pytest.raises(rp.BadRequest) as e:
        rp.sites(store, rp.Region("LG1", 0, 995, "raw", 10))
    assert e.value.kind == "cap"
    for bad, kind in ((rp.Region("LG1", 5, 5), "range"), (rp.Region("LG1", 0, 9, "x"), "mode"), (rp.Region("LG1", 0, 9, "raw", 0), "sites"), (rp.Region("LG1", 0, 10**9), "span")):
        with pytest.raises(rp.BadRequest) as e:
            rp.sites(store, bad)
        assert e.value.kind == kind


def test_bins_leave_out_missing_values(store):
    got = rp.bins(store, rp.Region("LG1", 0, 2000, "aggregate"), 4).collect()
    rows = [r for r in store.collect() if r.chrom == "LG1"]
    for r in got:
        inside = [x.s1 for x in rows if r.bin * 500 <= x.pos < (r.bin + 1) * 500 and x.s1 is not None]
        assert r.s1 == pytest.approx(sum(inside) / len(inside)) if inside else r.s1 is None
    assert [r.centre for r in got] == [250, 750, 1250, 1750]


def test_linkage_against_numpy(store):
    import numpy as np

    ids = [f"s{i}" for i in range(6)]
    request = rp.LinkageRequest("LG1", 0, 95, {"all": ids}, 10)
    got = {(r.a, r.b): r.r2 for r in rp.linkage(store, request).collect()}
    rows = {r.pos: np.array([np.nan if r[s] is None else r[s] for s in ids]) for r in store.collect() if r.chrom == "LG1" and r.pos <= 95}
    for (a, b), r2 in got.items():
        ok = ~np.isnan(rows[a]) & ~np.isnan(rows[b])
        x, y = rows[a][ok], rows[b][ok]
        if x.std() and y.std():
            assert r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
        else:
            assert r2 is None
    assert request.key("1") == rp.LinkageRequest("LG1", 0, 95, {"all": ids[::-1]}, 10).key("1") != request.key("2")
    with pytest.raises(rp.BadRequest):
        rp.linkage(store, rp.LinkageRequest("LG1", 0, 95, {"few": ids[:2]}, 10))


def test_store_round_trip_and_cache(spark, store, tmp_path):
    path = f"file://{tmp_path}/store"
    tb.write_store(store.withColumn("maf", F.lit(0.1)), path, ["maf"])
    assert tb.read_range(spark, path, "sites", "LG1", 100, 200).count() == 11
    assert tb.at_positions(spark, path, "LG1", spark.createDataFrame([(10,), (15,), (10,)], "pos long")).count() == 1
    cache, built = rp.ResultCache(spark, f"file://{tmp_path}/cache"), []
    for _ in range(2):
        assert cache.get("k", path, lambda: built.append(1) or spark.range(3)).count() == 3
    assert len(built) == 1
    w = json.loads(rp.windows_json(store.where("chrom = 'LG1'"), 10, 5).first().json)
    assert w["n_windows"] == 19 and w["windows"][1]["snp_positions"][0] == 50


def test_variants_of_a_vcf(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB", "c1\t10\t.\tA\tAT,G\t30\tPASS\tP;END=20\tGT:GQ:DP:AD\t0/1:9:12:5,7,0\t./.", "c1\t15\t.\tACG\tA\t.\t.\t.\tGT:PL\t1/1:40,3,0\t0/0:0,3,40"]
    (tmp_path / "x.vcf").write_text("\n".join(lines) + "\n")
    got = {(r.pos, r["sample"]): r for r in tb.variants(spark, str(tmp_path / "x.vcf")).collect()}
    a = got[10, "A"]
    assert (a.end, a.var_type, a.gt_class, a.gq, a.dp, a.ad, a.ad_alt, a.ad_sum, a.n_alt, a.info["P"]) == (20, "INS", "HET", 9.0, 12, [5, 7, 0], 7, 12, 2, "true")
    assert got[10, "B"].gt_class == "OTHER" and got[10, "B"].ad is None
    b = got[15, "A"]
    assert (b.end, b.var_type, b.indel_len, b["filter"], b.pl, b.gt_class) == (17, "DEL", -2, "PASS", [40, 3, 0], "HOM_VAR")


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "k.tsv").write_text("sample_id\tlabel\na\thomo_1\nb\tHET\nc\todd\n")
    assert {(r.sample_id, r.grp) for r in tb.karyotypes(spark, str(tmp_path / "k.tsv")).collect()} == {("a", "H1/H1"), ("b", "H1/H2")}
    (tmp_path / "t.dat").write_text("Sequence: LG1\n\n1 12 3 4.0 3 100 0 24 50 0 25 25 1.5 ACG ACGACGACGACG\nSequence: LG2\n5 9 1 5.0 1 100 0 10 100 0 0 0 0.0 A AAAAA\n")
    assert [(r.chrom, r.start, r.end, r.motif) for r in tb.tandem_repeats(spark, str(tmp_path / "t.dat")).orderBy("chrom").collect()] == [("LG1", 0, 12, "ACG"), ("LG2", 4, 9, "A")]
    (tmp_path / "c9.keys.tsv").write_text("q7_tier\t2\nother\tNA\nq7_tier\t1\n")
    keys = tb.flat_keys(spark, str(tmp_path / "c9.keys.tsv"))
    assert [(r.candidate_id, r.tier) for r in rp.last_tiers(keys).collect()] == [("c9", "1")]
    path = f"file://{tmp_path}/rows"
    for k in range(2):
        tb.append_rows(spark.createDataFrame([(k, "x")], "a int, b string").coalesce(1), path)
    assert spark.read.option("sep", "\t").option("header", True).csv(path).count() == 2
    with pytest.raises(ValueError):
        tb.append_rows(spark.createDataFrame([(1,)], "other int"), path)
    for v in (1, 2):
        tb.write_json_atomic(spark, f"file://{tmp_path}/j.json", {"v": v})
    assert json.loads((tmp_path / "j.json").read_text()) == {"v": 2}
    rows = [bytes(r.row) for r in tb.pair_triangle(spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (1, 2, None)], "i int, j int, r2 double"), 3).collect()]
    assert rows == [bytes([255, 128]), bytes([0])]
    levels = spark.createDataFrame([("a", "SUSPECT"), ("b", "SUPPORTED"), ("c", "odd"), ("d", None)], "candidate_id string, level string")
    assert [r.candidate_id for r in rp.reaches_rank(levels, "SUPPORTED").collect()] == ["b"]
