"""Interval and point operators over half-open [start, end) ranges of integers.

No operator here compares all pairs of a key: joins deal both sides to bins of
a fixed width and compare within a bin, so a key with a third of all rows is
spread over its bins; running lookups (islands, gaps, nearest, last started) run
within buckets of a key and carry one summary row a bucket to the others.

Rows with a null position match nothing and are in no island; empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import BUCKET, WIDTH, bucketed, carry, within
from .graph import keep


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, names=("l_", "r_")) -> DataFrame:
    """All pairs of rows with equal keys whose ranges share a position, once each.

    `left` and `right` have the keys, start and end; other columns and the
    ranges come out prefixed.  A pair is emitted in the one bin that holds the
    later of the two starts.  Empty ranges (end <= start) match nothing.
    """
    a = left.where("start < end").select(*keys, *[F.col(c).alias(names[0] + c) for c in left.columns if c not in keys])
    b = right.where("start < end").select(*keys, *[F.col(c).alias(names[1] + c) for c in right.columns if c not in keys])
    ls, le, rs, re = (F.col(n + c) for n in names for c in ("start", "end"))
    a = a.withColumn("_bin", F.explode(_bins(ls, le, width)))
    b = b.withColumn("_bin", F.explode(_bins(rs, re, width)))
    hit = a.join(b, [*keys, "_bin"]).where((ls < re) & (rs < le) & (F.floor(F.greatest(ls, rs) / width) == F.col("_bin")))
    return hit.withColumn("overlap", F.least(le, re) - F.greatest(ls, rs)).drop("_bin")


def covered_by_one(left: DataFrame, right: DataFrame, keys: list[str], ident: str, fraction: float, width: int, keep: bool) -> DataFrame:
    """Rows of left of which one right range covers at least `fraction` (or, keep=False, none does)."""
    hit = overlap_join(left, right, keys, width).where(F.col("overlap") >= fraction * (F.col("l_end") - F.col("l_start")))
    return left.join(hit.select(*keys, F.col("l_" + ident).alias(ident)).distinct(), [*keys, ident], "left_semi" if keep else "left_anti")


def islands(df: DataFrame, keys: list[str], slack: int = 0, rule: str = "running_max", ident: str = "id", width: int = WIDTH) -> DataFrame:
    """Number runs of ranges per key.

    A new island begins where start > reach + slack; the reach is the largest
    end so far (running_max), the end of the row before (last_member), or the
    start of the row before (start_gap).
    """
    rows = bucketed(df, F.col("start"), width)
    order = within(keys).orderBy("start", "end", ident)
    last = F.struct("start", "end", F.col(ident).alias("ident"))
    rows = carry(rows, keys, {"_end": (F.max, F.col("end")), "_last": (F.max, last)})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = {
        "running_max": F.greatest(F.max("end").over(before), F.col("_end")),
        "last_member": F.coalesce(F.lag("end").over(order), F.col("_last.end")),
        "start_gap": F.coalesce(F.lag("start").over(order), F.col("_last.start")),
    }[rule]
    new = F.when(reach.isNull() | (F.col("start") > reach + slack), 1).otherwise(0)
    rows = carry(rows.withColumn("_new", new), keys, {"_before": (F.sum, F.col("_new"))})
    return rows.withColumn("island", F.coalesce("_before", F.lit(0)) + F.sum("_new").over(order)).drop("_new", "_before", "_end", "_last", BUCKET)


def merge(df: DataFrame, keys: list[str], slack: int = 0, ident: str = "id") -> DataFrame:
    """Union of ranges per key: one row per island."""
    return islands(df, keys, slack, "running_max", ident).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def complement(merged: DataFrame, keys: list[str], lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """Gaps between merged ranges, from 0 to each key's length."""
    edge = lengths.select(*keys, F.col("length").alias("start"), F.col("length").alias("end"))
    rows = bucketed(merged.select(*keys, "start", "end").unionByName(edge), F.col("start"), width)
    rows = carry(rows, keys, {"_end": (F.max, F.col("end"))})
    gap = rows.withColumn("from", F.coalesce(F.lag("end").over(within(keys).orderBy("start")), F.col("_end"), F.lit(0)))
    return gap.where(F.col("from") < F.col("start")).select(*keys, F.col("from").alias("start"), F.col("start").alias("end"))


def subtract(left: DataFrame, right: DataFrame, keys: list[str], ident: str, width: int) -> DataFrame:
    """What is left of each left range after the union of the right ranges is taken out."""
    cut = overlap_join(left, merge(right, keys), keys, width)
    order = Window.partitionBy(*keys, ident).orderBy("s")
    pieces = cut.select(*keys, F.col("l_" + ident).alias(ident), F.greatest("l_start", "r_start").alias("s"), F.least("l_end", "r_end").alias("e"))
    stops = pieces.unionByName(left.where("start < end").select(*keys, ident, F.col("end").alias("s"), F.col("end").alias("e")))
    begins = left.select(*keys, ident, F.col("start").alias("_start"))
    gaps = stops.withColumn("from", F.lag("e").over(order)).join(begins, [*keys, ident])
    gaps = gaps.withColumn("from", F.coalesce("from", "_start"))
    return gaps.where("from < s").select(*keys, ident, F.col("from").alias("start"), F.col("s").alias("end"))


def coverage(left: DataFrame, right: DataFrame, keys: list[str], ident: str, width: int, mode: str = "union") -> DataFrame:
    """Positions of each left range under the right ranges: their union, or their sum."""
    other = merge(right, keys) if mode == "union" else right
    hit = overlap_join(left, other, keys, width).groupBy(*keys, F.col("l_" + ident).alias(ident)).agg(F.sum("overlap").alias("covered"))
    return left.join(hit, [*keys, ident], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def last_started(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, width: int = WIDTH) -> DataFrame:
    """For each point the range that started last at or before it, if the point is still inside.

    With overlapping ranges this is the last one only; it is not a range join.
    """
    rows = ranges.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("start", "end", F.col("id").alias("range_id")).alias("_r"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in keys])
    probes = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"), *[c for c in points.columns if c not in keys])
    both = bucketed(rows.unionByName(probes), F.col("_at"), width)
    both = carry(both, keys, {"_earlier": (F.max, F.col("_r"))})
    order = within(keys).orderBy("_at", "_kind", F.col("_r.end"), F.col("_r.range_id")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.coalesce(F.last("_r", True).over(order), F.col("_earlier"))).where("_kind = 1")
    inside = F.col("_r.end") > F.col("_at")
    return found.withColumn("range_id", F.when(inside, F.col("_r.range_id"))).drop("_at", "_kind", "_r", "_earlier", BUCKET)


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, tolerance: int | None = None, width: int = WIDTH) -> DataFrame:
    """Each point with the nearest mark of its key (the earlier one on a tie) and the distance."""
    extra = [c for c in points.columns if c not in keys]
    m = marks.select(*keys, F.col(mark).cast("long").alias("_at"), F.lit(0).alias("_kind"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra]).distinct()
    p = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), *extra)
    value = F.when(F.col("_kind") == 0, F.col("_at"))
    both = carry(bucketed(m.unionByName(p), F.col("_at"), width), keys, {"_earlier": (F.max, value)}, {"_later": (F.min, value)})
    up = within(keys).orderBy("_at", "_kind")
    both = both.withColumn("_before", F.coalesce(F.last(value, True).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier")))
    both = both.withColumn("_after", F.coalesce(F.first(value, True).over(up.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"))).where("_kind = 1")
    best = F.when(F.col("_after").isNull() | (F.col("_at") - F.col("_before") <= F.col("_after") - F.col("_at")), F.col("_before")).otherwise(F.col("_after"))
    out = both.withColumn("nearest", best).withColumn("distance", F.abs(F.col("_at") - F.col("nearest")))
    if tolerance is not None:
        out = out.withColumn("nearest", F.when(F.col("distance") <= tolerance, F.col("nearest"))).withColumn("distance", F.when(F.col("nearest").isNotNull(), F.col("distance")))
    return out.drop("_at", "_kind", "_before", "_after", "_earlier", "_later", BUCKET)


def smallest_enclosing(inner: DataFrame, outer: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The shortest outer range that contains each inner one (not itself); ties to the smaller id."""
    hit = overlap_join(inner, outer, keys, width).where("r_start <= l_start and r_end >= l_end and r_id <> l_id")
    return hit.groupBy(*keys, F.col("l_id").alias("id")).agg(F.min(F.struct((F.col("r_end") - F.col("r_start")).alias("size"), F.col("r_id").alias("parent"))).alias("b")).select(*keys, "id", "b.parent", "b.size")


def reciprocal_matches(a: DataFrame, b: DataFrame, keys: list[str], fraction: float, width: int, both: bool = True) -> DataFrame:
    """Best match per left row among those that overlap it by `fraction` of both (or of either) lengths."""
    hit = overlap_join(a, b, keys, width)
    x, y = F.col("overlap") / (F.col("l_end") - F.col("l_start")), F.col("overlap") / (F.col("r_end") - F.col("r_start"))
    hit = hit.where((F.least(x, y) if both else F.greatest(x, y)) >= fraction)
    return hit.groupBy(*keys, F.col("l_id").alias("id")).agg(F.max(F.struct("overlap", (-F.col("r_id")).alias("r"))).alias("b")).select(*keys, "id", (-F.col("b.r")).alias("match"), F.col("b.overlap").alias("overlap"))


def sliding_windows(df: DataFrame, keys: list[str], order: list[str], size: int, step: int) -> DataFrame:
    """Rows repeated for every full window of `size` rows, begun each `step` rows, that holds them."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    first = F.greatest(F.lit(0), F.ceil((F.col("_r") - size + 1) / F.lit(float(step)))).cast("long")
    last = F.least(F.floor(F.col("_r") / F.lit(float(step))), F.floor((F.col("_n") - size) / F.lit(float(step)))).cast("long")
    return r.where((F.col("_n") >= size) & (first <= last)).withColumn("window_id", F.explode(F.sequence(first, last))).drop("_r", "_n")


def relation(s1, e1, s2, e2) -> Column:
    s1, e1, s2, e2 = map(F.col, (s1, e1, s2, e2))
    return (
        F.when((s1 == s2) & (e1 == e2), "equal")
        .when((s1 >= s2) & (e1 <= e2), "nested_1_in_2")
        .when((s2 >= s1) & (e2 <= e1), "nested_2_in_1")
        .when((s1 < e2) & (s2 < e1), "partial_overlap")
        .otherwise("disjoint")
    )


def closed_overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """`overlap_join` of ranges whose ends are positions within them."""
    whole = lambda d: d.withColumn("end", F.col("end") + 1)
    hit = overlap_join(whole(left), whole(right), keys, width)
    return hit.withColumns({"l_end": F.col("l_end") - 1, "r_end": F.col("r_end") - 1})


def clipped(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The shared part of every overlapping pair."""
    hit = overlap_join(left, right, keys, width)
    return hit.withColumns({"start": F.greatest("l_start", "r_start"), "end": F.least("l_end", "r_end")})


def overlap_counts(left: DataFrame, right: DataFrame, keys: list[str], ident: str, width: int) -> DataFrame:
    """Each left range with how many right ranges overlap it, and whether any does."""
    n = overlap_join(left, right, keys, width).groupBy(*keys, F.col("l_" + ident).alias(ident)).agg(F.count(F.lit(1)).alias("n_overlaps"))
    out = left.join(n, [*keys, ident], "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)))
    return out.withColumn("any_overlap", F.col("n_overlaps") > 0)


def class_coverage(left: DataFrame, right: DataFrame, keys: list[str], ident: str, kind: str, width: int) -> DataFrame:
    """Overlapped positions of each left range by class of the right ranges, and their share of its length."""
    hit = overlap_join(left, right, keys, width)
    out = hit.groupBy(*keys, F.col("l_" + ident).alias(ident), F.col("r_" + kind).alias(kind)).agg(F.sum("overlap").alias("covered"), F.max(F.col("l_end") - F.col("l_start")).alias("length"))
    return out.withColumn("share", F.col("covered") / F.col("length")).drop("length")


def points_in_any(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, ident: str, width: int, least_length: int = 0) -> DataFrame:
    """Points with whether any range (ends included) of at least a length holds them; ranges may overlap."""
    probes = points.select(*keys, F.col(ident).alias("id"), F.col(at).alias("start"), (F.col(at) + 1).alias("end"))
    kept = ranges.where(F.col("end") - F.col("start") >= least_length).select(*keys, "start", (F.col("end") + 1).alias("end"))
    hit = overlap_join(probes, kept, keys, width).select(*keys, F.col("l_id").alias(ident)).distinct().withColumn("_hit", F.lit(True))
    return points.join(hit, [*keys, ident], "left").withColumn("inside", F.coalesce("_hit", F.lit(False))).drop("_hit")


def best_scored(left: DataFrame, right: DataFrame, keys: list[str], width: int, reach: int) -> DataFrame:
    """For each left range the right range of the best score among those within `reach`.

    Score: overlap in percent of the left range, less a tenth per kb between
    the starts and the ends, plus 20 for equal spans; the smaller id wins a tie.
    """
    wide = left.select(*keys, "id", F.col("start").alias("s"), F.col("end").alias("e"), (F.col("start") - reach).alias("start"), (F.col("end") + reach + 1).alias("end"))
    hit = overlap_join(wide, right, keys, width)
    span, other = F.col("l_e") - F.col("l_s"), F.col("r_end") - F.col("r_start")
    shared = F.greatest(F.lit(0), F.least("l_e", "r_end") - F.greatest("l_s", "r_start"))
    apart = (F.abs(F.col("r_start") - F.col("l_s")) + F.abs(F.col("r_end") - F.col("l_e"))) / 1000
    score = shared / span * 100 - apart * 0.1 + (1 - F.abs(1 - other / span)) * 20
    best = F.max(F.struct(F.round(score, 6).alias("score"), (-F.col("r_id")).alias("r")))
    return hit.groupBy(*keys, F.col("l_id").alias("id")).agg(best.alias("b"), F.count(F.lit(1)).alias("n_near")).select(*keys, "id", (-F.col("b.r")).alias("match"), "b.score", "n_near")


def both_ends_near(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Each left range with the first right range (by start, end, id) whose two ends lie within the tolerance; null if none."""
    cell = max(1, tolerance)
    a = left.select(*keys, F.col("id").alias("l_id"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor((F.col("start") - tolerance) / cell), F.floor((F.col("start") + tolerance) / cell))).alias("_cell"))
    b = right.select(*keys, F.struct("start", "end", "id").alias("r"), F.floor(F.col("start") / cell).alias("_cell"))
    hit = a.join(b, [*keys, "_cell"]).where((F.abs(F.col("r.start") - F.col("s")) <= tolerance) & (F.abs(F.col("r.end") - F.col("e")) <= tolerance))
    first = hit.groupBy(*keys, F.col("l_id").alias("id")).agg(F.min("r").alias("r")).select(*keys, "id", F.col("r.id").alias("match"))
    return left.join(first, [*keys, "id"], "left")


def straddling(candidates: DataFrame, pairs: DataFrame, keys: list[str], width: int, flank: int) -> DataFrame:
    """Candidates with pairs (start1, end1, start2, end2) of which one copy lies near the left end, the other near the right, either way round."""
    zone = lambda at: candidates.select(*keys, "id", (F.col(at) - flank).alias("start"), (F.col(at) + flank).alias("end"))
    copy = lambda k: pairs.select(*keys, F.col("id").alias("id"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"))
    near = lambda at, k: closed_overlap_join(zone(at), copy(k), keys, width).select(*keys, F.col("l_id").alias("id"), F.col("r_id").alias("pair"))
    return near("start", 1).join(near("end", 2), [*keys, "id", "pair"]).unionByName(near("start", 2).join(near("end", 1), [*keys, "id", "pair"])).distinct()


def near_boundary_counts(marks: DataFrame, candidates: DataFrame, keys: list[str], at: str, kind: str, kinds: list[str], width: int, reach: int) -> DataFrame:
    """Marks of each kind within reach of a candidate's start and of its end, 0 where none."""
    points = marks.select(*keys, F.col(kind).alias("kind"), F.col(at).alias("start"), F.col(at).alias("end"))
    out = candidates
    for side in ("start", "end"):
        zone = candidates.select(*keys, "id", (F.col(side) - reach).alias("start"), (F.col(side) + reach).alias("end"))
        n = closed_overlap_join(zone, points, keys, width).groupBy(*keys, F.col("l_id").alias("id")).agg(*[F.count_if(F.col("r_kind") == k).alias(f"{side}_{k}") for k in kinds])
        out = out.join(n, [*keys, "id"], "left")
    return out.fillna(0, [f"{side}_{k}" for side in ("start", "end") for k in kinds])


def overlap_and_flanks(candidates: DataFrame, genes: DataFrame, keys: list[str], width: int, share: float = 0.2, least: int = 50_000) -> DataFrame:
    """Genes within a candidate and in either flank (`share` of its length, `least` at least), and the first five names."""
    flank = F.greatest(F.ceil((F.col("end") - F.col("start")) * share), F.lit(least))
    sides = {"inside": (F.col("start"), F.col("end")), "left": (F.col("start") - flank, F.col("start") - 1), "right": (F.col("end") + 1, F.col("end") + flank)}
    out = candidates
    for name, (a, b) in sides.items():
        zone = candidates.select(*keys, "id", a.alias("start"), b.alias("end"))
        hit = closed_overlap_join(zone, genes, keys, width).groupBy(*keys, F.col("l_id").alias("id"))
        names = [F.array_join(F.slice(F.array_sort(F.collect_set("r_name")), 1, 5), ",").alias("names")] if name == "inside" else []
        out = out.join(hit.agg(F.count(F.lit(1)).alias(f"n_{name}"), *names), [*keys, "id"], "left")
    return out.fillna(0, [f"n_{s}" for s in sides])


def exact_or_lower(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, width: int = WIDTH) -> DataFrame:
    """Each point with the mark at its position, else the last one below it."""
    m = marks.select(*keys, F.col(mark).alias("start"), F.lit(1 << 62).cast("long").alias("end"), F.col(mark).alias("id"))
    found = last_started(points, m, keys, at, width)
    return found.withColumnRenamed("range_id", "mark").withColumn("exact", F.col("mark") == F.col(at))


def descendants(edges: DataFrame, most: int = 64) -> DataFrame:
    """(ancestor, node, depth) for all pairs of a parent-child relation (parent, child), level by level until none is new.

    A cycle's nodes are found once, at their least depth.
    """
    step = edges.where("parent is not null and child is not null").select("parent", "child").distinct()
    found = step.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth"))
    front = found
    for depth in range(2, most + 1):
        next_ = front.join(step, front["node"] == step["parent"]).select("ancestor", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = keep(next_.join(found.select("ancestor", "node"), ["ancestor", "node"], "left_anti"), "level")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise ValueError(f"more than {most} levels")
