"""Range lookups spread over buckets, and matching of ranges, on small rows with nulls and ties."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernal.operators import intervals as iv
from quernal.operators import sampling


def rows_of(frame, *names):
    return sorted(frame.select(*names).collect(), key=str)


def ranges(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, start long, end long")


def test_islands_are_the_same_for_any_bucket_width(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else None, i, s := rng.randrange(2000), s + rng.randrange(1, 40)) for i in range(300)]
    frame = ranges(spark, rows)
    for rule in ("running_max", "last_member", "start_gap"):
        wide, narrow = (rows_of(iv.islands(frame, ["key"], 3, rule, width=w), "key", "id", "island") for w in (1 << 30, 16))
        assert wide == narrow and len(wide) == 300
    points = frame.select("key", F.col("id").alias("p"), (F.col("start") + 7).alias("at"))
    assert rows_of(iv.last_started(points, frame, ["key"], "at", 1 << 30), "p", "range_id") == rows_of(iv.last_started(points, frame, ["key"], "at", 8), "p", "range_id")
    marks = frame.where("id % 7 = 0").select("key", F.col("end").alias("mark"))
    a, b = (rows_of(iv.nearest(points, marks, ["key"], "at", "mark", 90, w), "p", "nearest", "distance") for w in (1 << 30, 8))
    assert a == b
    lengths = spark.createDataFrame([("a", 3000)], "key string, length long")
    merged = iv.merge(frame.where("key is not null"), ["key"])
    assert rows_of(iv.complement(merged, ["key"], lengths, 16), "start", "end") == rows_of(iv.complement(merged, ["key"], lengths), "start", "end")


def test_one_key_is_spread_over_tasks(spark):
    frame = ranges(spark, [("a", i, i * 100, i * 100 + 50) for i in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = iv.islands(frame, ["key"], width=1000).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_points_in_overlapping_ranges(spark):
    r = ranges(spark, [("a", 1, 0, 100), ("a", 2, 10, 20), ("b", 3, 5, 6)])
    p = spark.createDataFrame([("a", 1, 50), ("a", 2, 100), ("a", 3, 101), ("b", 4, 50), (None, 5, 5)], "key string, p long, at long")
    assert [tuple(x) for x in rows_of(iv.points_in_any(p, r, ["key"], "at", "p", 16), "p", "inside")] == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    assert iv.points_in_any(p, r, ["key"], "at", "p", 16, 1000).where("inside").count() == 0


def test_straddling_takes_either_order(spark):
    c = ranges(spark, [("a", 1, 1000, 5000)])
    pairs = spark.createDataFrame([("a", 1, 990, 1005, 4990, 5001), ("a", 2, 5005, 5010, 1001, 1002), ("a", 3, 990, 1005, 3000, 3001), ("b", 4, 990, 1005, 4990, 5001)], "key string, id long, start1 long, end1 long, start2 long, end2 long")
    assert [tuple(r) for r in rows_of(iv.straddling(c, pairs, ["key"], 64, 10), "id", "pair")] == [(1, 1), (1, 2)]


def test_descendants_of_a_deep_tree_and_a_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(None, 3)], "parent long, child long")
    got = {(r.ancestor, r.node): r.depth for r in iv.descendants(chain).collect()}
    assert got == {(a, b): b - a for a in range(13) for b in range(a + 1, 13)}
    ring = spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long")
    assert {(r.ancestor, r.node, r.depth) for r in iv.descendants(ring).collect()} == {(1, 2, 1), (2, 1, 1), (1, 1, 2), (2, 2, 2)}


def test_empty_tables(spark):
    none = ranges(spark, [])
    assert iv.islands(none, ["key"]).count() == iv.clipped(none, none, ["key"], 8).count() == iv.best_scored(none, none, ["key"], 8, 5).count() == 0
    assert iv.descendants(spark.createDataFrame([], "parent long, child long")).count() == 0


def test_pair_hashes_are_md5():
    rng = np.random.default_rng(0)
    for high in (9, 10**6, 10**18, None):
        names = [str(x) for x in rng.integers(0, high, 60)] if high else ["é" * int(k) for k in rng.integers(0, 40, 60)]
        for size in {len(x.encode()) for x in names}:
            first, second = [f"5:{x}:".encode() for x in names if len(x.encode()) == size], [x.encode() for x in names]
            i, j = rng.integers(0, len(first), 500), rng.integers(0, 60, 500)
            want = [int(hashlib.md5(first[x] + second[y]).hexdigest()[:8], 16) for x, y in zip(i, j, strict=True)]
            assert sampling._PairHash(first, second)(i, j).tolist() == want


@pytest.mark.parametrize("parts", [None, (1 << 10, 16)])
def test_matched_draws_against_all_pairs(spark, monkeypatch, parts):
    """Also where a bin's targets and pool are dealt over parts; ids are texts, lengths and densities may be null."""
    if parts:
        monkeypatch.setattr(sampling, "_TASK_PAIRS", parts[0])
        monkeypatch.setattr(sampling, "_POOL_ROWS", parts[1])
        monkeypatch.setattr(sampling, "_LANES", 64)
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(rng.integers(0, 20)) // 9], f"r{k}" * (1 + k % 2), float(rng.integers(0, 40)), float(rng.integers(1, 9)) if k % 17 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, id string, l double, d double")
    got = {(r.k, r.target, r["rank"]): r.match for r in sampling.matched_draws(df, df, ["k"], "l", "d", 3, 5).collect()}
    want = {}
    for k, a, l, d in rows:
        if k is not None and d is not None:
            hits = [x[1] for x in rows if x[0] == k and x[1] != a and x[3] is not None and abs(x[2] - l) <= 0.5 * l and abs(x[3] - d) <= 0.5 * d]
            for rank, m in enumerate(sorted(hits, key=lambda m: (hashlib.md5(f"5:{a}:{m}".encode()).hexdigest()[:8], m))[:3], 1):
                want[k, a, rank] = m
    assert got == want and len(want) > 900
