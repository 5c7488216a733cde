"""Scalars over sequences and records, windows and draws, on small rows with nulls."""

import pytest
from pyspark.sql import functions as F

from quernal.functions import sequences as sq
from quernal.functions import stats
from quernal.operators import sampling as sp
from quernal.operators import sets
from quernal.operators import windows as wn


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return frame.select(column).first()[0]


def test_sequence_scalars(spark):
    c = F.col
    assert one(spark, sq.target_site_duplication(c("l"), c("r")), l="AAACGTACG", r="ttACGTACGaa") == 7
    assert one(spark, sq.target_site_duplication(c("l"), c("r")), l="AC", r="AC") == 0
    assert one(spark, sq.target_site_duplication(c("l"), c("r")), l=None, r="AC") == 0
    assert one(spark, sq.flank(c("s"), F.lit(-3), F.lit(2)), s="acgt") == "AC"
    assert one(spark, sq.flank(c("s"), F.lit(3), F.lit(99)), s="acgt") == "T"
    assert one(spark, sq.indel_motif(F.lit("INS"), c("a"), c("b")), a="A", b="ACC") == "ACC"
    assert [one(spark, sq.chromosome(c("x")), x=x) for x in ("chr01", "LG12", "7", "chrX", "scaffold_03", "ctg9")] == ["LG1", "LG12", "LG7", "X", "LG3", "ctg9"]
    assert one(spark, sq.decode_bytes(c("x")), x="AP+A") == [0, 255, 128]
    assert one(spark, sq.decode_bytes(c("x")), x="") == []
    assert [one(spark, sq.bin_label(c("x")), x=x) for x in (999, 25_000, 1_000_000)] == ["0kb", "25kb", "1Mb"]
    assert one(spark, sq.attribute(c("x"), "Name"), x="ID=a;Name=b;Flag") == "b"
    assert one(spark, sq.info_map(c("x")), x="P;AF=0.5") == {"P": "true", "AF": "0.5"}


@pytest.mark.parametrize(("names", "values", "want"), [("GT:DR:DV:RR:RV", "0/1:5:2:7:3", (5, 12)), ("GT:PR:SR", "0/1:10,4:3,1", (5, 13)), ("GT:PR", "0/0:10", (0, 0)), ("GT", "./.", (0, 0)), ("DR:DV", "x:1", (0, 0))])
def test_read_support(spark, names, values, want):
    assert tuple(one(spark, sq.read_support(sq.sample_map(F.col("n"), F.col("v"))), n=names, v=values)) == want


def test_one_sided_fisher_sums_to_one(spark):
    from math import comb

    tables = [(3, 1, 2, 6), (0, 5, 4, 0), (5, 0, 0, 5), (1, 0, 0, 0), (40, 60, 70, 30)]
    got = stats.fisher_greater(spark.createDataFrame(tables, "a long, b long, c long, d long"), "a", "b", "c", "d").collect()
    for r in got:
        n, r1, c1 = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        want = sum(comb(c1, x) * comb(n - c1, r1 - x) for x in range(r.a, min(r1, c1) + 1)) / comb(n, r1)
        assert r.p_greater == pytest.approx(want)


def test_sets(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("d", 9), ("d", None), (None, 1), ("a", 1)]
    got = {(r.a, r.b): (r.relation, r.shared) for r in sets.compare_all(spark.createDataFrame(rows, "s string, m long"), "s", "m", 10).collect()}
    assert got == {("a", "b"): ("IDENTICAL", 2), ("a", "c"): ("NESTED", 1), ("b", "c"): ("NESTED", 1), ("a", "d"): ("DISJOINT", 0), ("b", "d"): ("DISJOINT", 0), ("c", "d"): ("DISJOINT", 0)}


def test_sign_flips_and_runs(spark):
    rows = [("a", i, v) for i, v in enumerate([0.0, 1.0, 0.0, -1.0, None, -2.0, 3.0])] + [("b", 0, None), ("c", 0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    assert {r.k: (r.n, r.flips, r.upward) for r in wn.sign_flips(frame, ["k"], ["i"], "v").collect()} == {"a": (6, 2, 1), "c": (1, 0, 0)}
    flags = frame.withColumn("f", F.col("v") < 0)
    assert {r.k: r.longest for r in wn.longest_run(flags, ["k"], ["i"], "f").collect()} == {"a": 1, "b": 0, "c": 0}


def test_draws(spark):
    frame = spark.createDataFrame([("a" if i % 3 else None, i, float(i)) for i in range(50)], "k string, id long, v double")
    a, b = (sorted(r.id for r in sp.draw(frame.repartition(n), ["k"], "id", 5, 3).collect()) for n in (1, 7))
    assert a == b and len(a) == 10
    assert sp.draw(frame.limit(0), ["k"], "id", 5, 3).count() == 0
    numbered = {r.id: r.row for r in sp.number_rows(frame, ["v"], "id", 8).collect()}
    assert numbered == {i: i for i in range(50)}
    assert sp.bootstrap(frame.limit(0), "id", ["v"], 3, 4, 1).count() == 0
    edges = {(r.u, r.v) for r in sp.nearest_edges(frame.where("k is not null"), ["k"], "v", "id", 1).collect()}
    assert all(v - u <= 2 for u, v in edges) and len(edges) >= 16
