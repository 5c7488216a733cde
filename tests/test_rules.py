"""Rule tables at their boundaries, with missing values."""

import pytest
from pyspark.sql import functions as F

from quernal.operators import evidence_rules as ev
from quernal.operators import variant_rules as vr


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(column).collect()]


def cs(names):
    return [F.col(n) for n in names.split()]


def test_calls(spark):
    calls = ["0/0", "0|1", "1/1", "2/2", "./1", ".", None, "", "0", "0/1/1", "a/b"]
    rows = [(g,) for g in calls]
    assert values(spark, rows, "g string", vr.genotype_code(F.col("g"))) == ["AA", "AB", "BB", "AB", "miss", "miss", "miss", "miss", "miss", "miss", "miss"]
    assert values(spark, rows, "g string", vr.call_dosage(F.col("g"))) == [0, 1, 2, None, None, None, None, None, None, None, None]
    assert values(spark, rows, "g string", vr.call_presence(F.col("g"))) == [0, 1, 1, None, None, None, None, None, None, None, None]


def test_rescue_at_its_bounds(spark):
    schema = "t string, s string, g string, q double, d int, a double, n int, gq double"
    rows = [
        ("DEL", "FILTERED", "HOM_REF", 8.0, 4, 0.25, 2, None),
        ("DEL", "FILTERED", "HOM_REF", 8.0, 4, 0.25, 2, 4.9),
        ("INS", "FILTERED", "HET", 5.0, 3, 0.15, 1, 0.0),
        ("SNP", "FILTERED", "HET", 12.0, 3, 0.15, 1, None),
        ("SNP", "FILTERED", "HET", 11.9, 3, 0.15, 1, None),
        ("SNP", "PASS", None, None, None, None, None, None),
        ("INS", "FILTERED", "HET", None, 3, 0.15, 1, 0.0),
        (None, None, None, None, None, None, None, None),
    ]
    got = values(spark, rows, schema, vr.rescue(*cs("t s g q d a n gq"))["reason"])
    assert got == ["strong_indel", "none", "relaxed_indel", "strong_snp_q12", "none", "pass", "none", "none"]


def test_severity_takes_the_worst_term(spark):
    rows = [("missense_variant&stop_gained", "x"), ("synonymous_variant|intron_variant", "x"), ("", "CDS"), (None, "intron"), ("unknown_term", "CDS"), (None, None), (" stop_lost ,x", "y")]
    assert values(spark, rows, "c string, x string", vr.small_severity(*cs("c x"))) == ["very_high", "low", "moderate", "low", "minimal", "minimal", "high"]


def test_scores_take_given_weights(spark):
    rows = [("frameshift",), ("MISSENSE",), (None,)]
    assert values(spark, rows, "a string", vr.consequence_score(F.col("a"), {"stop_gained": 20})) == [20.0, 4.0, 0.0]
    rows = [("splice_branch", "splice_donor", "A"), (None, "splice_region", "B"), ("x", None, None)]
    assert values(spark, rows, "e string, s string, p string", vr.splice_score(*cs("e s p"), {"class_A": 9})) == [5.0, 2.0, 0.0]


def test_zones(spark):
    rows = [(0,), (99,), (100,), (600_099,), (600_100,), (1_400_000,), (2_500_000,)]
    zones = {"left_flank": (F.lit(0), F.lit(99)), "inversion_body": (F.lit(100), F.lit(100))}
    assert values(spark, rows, "p int", ev.zone_of_position(F.col("p"), F.lit(100_100), F.lit(1_500_000), zones))[:4] == ["left_flank", "left_flank", "inversion_body", "left_boundary"]
    assert values(spark, [(0,), (20,), (50,), (80,), (101,), (-1,)], "p int", ev.zone_of_midpoint(F.col("p"), F.lit(0), F.lit(100))) == ["left_edge", "left_edge", "center", "right_edge", "right_flank", "left_flank"]
    assert values(spark, [(-5, 0, 10), (5, 0, 10), (20, 0, 10), (1, 1, 1)], "p int, a int, b int", ev.relative_position(*cs("p a b"))) == [0.0, 0.5, 1.0, 0.5]


# Level before, concordance, jackknife, largest change, Fisher's p and odds ratio, level after.
GATE = [
    (None, None, None, None, None, None, "UNCERTAIN"),
    ("NONE", 0.70, "robust", None, None, None, "SUPPORTED"),
    ("NONE", 0.69, "robust", None, None, None, "NONE"),
    ("SUPPORTED", None, None, 0.3, 0.049, 5.1, "VALIDATED"),
    ("SUPPORTED", None, None, 0.31, 0.049, 5.1, "SUSPECT"),
    ("VALIDATED", None, "fragile", None, None, None, "SUSPECT"),
    ("SUPPORTED", None, None, None, 0.05, 50.0, "SUPPORTED"),
    ("SUSPECT", None, None, None, 0.01, 6.0, "VALIDATED"),
]


def test_validation_gate(spark):
    schema = "c string, t double, j string, d double, p double, o double"
    assert values(spark, [r[:6] for r in GATE], schema, ev.validation_level(*cs("c t j d p o"))) == [r[6] for r in GATE]


def test_caps_limit_promotion(spark):
    schema = "c string, t double, j string, d double, p double, o double, cap string"
    rows = [("NONE", None, "few_family", None, 0.01, 9.0, None), ("NONE", None, "robust_multi_family", None, 0.01, 9.0, "UNCERTAIN"), ("NONE", None, None, 0.4, 0.01, 9.0, None), ("VALIDATED", None, "PCA_family_driven", None, None, None, None), (None, 0.9, "single_family_fragile", None, None, None, None)]
    got = values(spark, rows, schema, ev.capped_validation(*cs("c t j d p o cap")))
    assert [(r.level, r.flags, r.linkage) for r in got] == [("SUPPORTED", "restricted_family_spread", "few_family"), ("UNCERTAIN", "normal", "multi_family"), ("SUPPORTED", "high_jackknife_delta_no_verdict", "uncertain"), ("SUSPECT", "pca_groups_family_confounded", "pca_family_confounded"), ("SUPPORTED", "family_specific_polymorphism", "single_family")]


@pytest.mark.parametrize(("inverted", "other", "call"), [(3, 3, "SPLIT"), (3, 2, "INV_INV"), (None, 3, "INV_nonINV"), (2, None, "UNINFORMATIVE")])
def test_interval_calls(spark, inverted, other, call):
    assert values(spark, [(inverted, other)], "a int, b int", ev.interval_call(*cs("a b"))) == [call]


def test_filters(spark):
    rows = [("DEL", "PASS", 30), ("DEL", "LowQual", 30), ("DUP", "PASS", 30), ("DEL", "PASS", 5), (None, None, None)]
    assert values(spark, rows, "t string, f string, q int", vr.holds(ev.strict_filter(F.col("t"), "DEL", F.col("f"), "q >= 20"))) == [True, False, False, False, False]
    assert values(spark, [(["0/0", None],), (["0/0", "0/2"],), ([],), (None,)], "g array<string>", ev.is_polymorphic(F.col("g"))) == [False, True, False, False]
