"""Rank tests, pairs within reach, label comparisons and leave-one-out divergence.

Rank tests first count rows per distinct value, so repeated values combine
before the shuffle and only distinct values of a key are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalars import hudson_terms


@F.pandas_udf(DoubleType())  # a type, not its name: names need a session to parse
def chi_square_survival(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail for a whole number of degrees of freedom; null without a value or with none."""

    def tail(v, k):
        if pd.isna(v) or pd.isna(k) or k < 1:
            return None
        if v <= 0:
            return 1.0
        k, half = int(k), v / 2
        total = math.erfc(math.sqrt(half)) if k % 2 else math.exp(-half)
        for j in range(3 if k % 2 else 4, k + 1, 2):
            total += math.exp((j / 2 - 1) * math.log(half) - half - math.lgamma(j / 2))
        return min(1.0, total)

    return pd.Series([tail(v, k) for v, k in zip(x, df, strict=True)], dtype="float64")


def _tied(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key and distinct value: rows with it (t), rows before it and the mean rank."""
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    t = cells.groupBy(*keys, value).agg(F.sum("_n").alias("_t"))
    return t.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).withColumn("_mid", F.col("_before") + (F.col("_t") + 1) / 2)


def _rank_sums(df: DataFrame, keys: list[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Per key and group: n and the sum of ranks.  Per key: n and the tie term.  Rows with a null are left out."""
    whole = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    cells = whole.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("_n"))
    tied = _tied(cells, keys, value)
    sums = cells.join(tied, [*keys, value]).groupBy(*keys, group).agg(F.sum("_n").alias("_g"), F.sum(F.col("_n") * F.col("_mid")).alias("_r"))
    t = F.col("_t").cast("double")
    return sums, tied.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(t * t * t - t).alias("_ties"))


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """U of the rows whose boolean `group` is true, and z with ties and continuity corrected.

    z is null where a side is empty or all values are equal.
    """
    sums, whole = _rank_sums(df, keys, group, value)
    one = sums.groupBy(*keys).agg(F.sum(F.when(F.col(group), F.col("_g")).otherwise(0)).alias("n1"), F.sum(F.when(F.col(group), F.col("_r")).otherwise(0.0)).alias("_r1"))
    t = one.join(whole, keys).withColumn("u", F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n0 = F.col("n") - F.col("n1")
    away = F.col("u") - F.col("n1") * n0 / 2
    variance = F.col("n1") * n0 / 12 * (F.col("n") + 1 - F.try_divide(F.col("_ties"), F.col("n") * (F.col("n") - 1)))
    return t.select(*keys, "n1", n0.alias("n0"), "u", F.when(variance > 0, (away - F.signum(away) * 0.5) / F.sqrt(variance)).alias("z"))


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """H over any number of groups, corrected for ties, and its degrees of freedom; null where all values are equal."""
    sums, whole = _rank_sums(df, keys, group, value)
    t = sums.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_g")).alias("_s"), (F.count(F.lit(1)) - 1).alias("freedom")).join(whole, keys)
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    return t.select(*keys, "n", "freedom", F.when(F.col("freedom") > 0, F.try_divide(h, 1 - F.try_divide(F.col("_ties"), n * n * n - n))).alias("h"))


def ecdf_deviation(df: DataFrame, keys: list[str], value: str, least: int = 10) -> DataFrame:
    """Largest gap between the ECDF and a straight line, and 2 exp(-2 n gap^2) as a p-like score.

    Below `least` rows, or with one distinct value, the score is 1.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(*keys)
    tied = _tied(cells, keys, value).withColumn("n", F.sum("_t").over(all_)).withColumn("_lo", F.min(value).over(all_)).withColumn("_hi", F.max(value).over(all_))
    line = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    gap = F.greatest(F.abs((F.col("_before") + 1) / F.col("n") - line), F.abs((F.col("_before") + F.col("_t")) / F.col("n") - line))
    t = tied.groupBy(*keys).agg(F.max("n").alias("n"), F.max(gap).alias("gap"))
    return t.withColumn("score", F.when((F.col("n") < least) | F.col("gap").isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("gap") * F.col("gap") * F.col("n")))))


def gap_count(df: DataFrame, keys: list[str], value: str, factor: float = 2.0, most: int = 5) -> DataFrame:
    """Clusters suggested by gaps over `factor` times the median gap, at most `most`; one where there is no gap."""
    gap = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
    gaps = df.where(F.col(value).isNotNull()).select(*keys, gap.alias("_gap"))
    middle = gaps.groupBy(*keys).agg(F.median("_gap").alias("_m"))
    return gaps.join(middle, keys).groupBy(*keys).agg(F.least(F.lit(most), 1 + F.count_if(F.col("_gap") > factor * F.col("_m"))).cast("int").alias("n_clusters"))


def pairs_within(df: DataFrame, keys: list[str], at: str, ident: str, reach: int, columns: list[str]) -> DataFrame:
    """Each pair of a key's rows at most `reach` apart, once: by position, then id.

    A row is joined with its own and the next bin only, so work follows the
    number of pairs that the reach asks for.
    """
    bin_ = F.floor(F.col(at) / reach).cast("long")
    side = lambda p: [F.col(c).alias(f"{p}{c}") for c in dict.fromkeys([at, ident, *columns])]
    a = df.select(*keys, *side("a_"), F.explode(F.array(bin_, bin_ + 1)).alias("_bin"))
    b = df.select(*keys, *side("b_"), bin_.alias("_bin"))
    gap = F.col(f"b_{at}") - F.col(f"a_{at}")
    later = (gap > 0) | ((gap == 0) & (F.col(f"a_{ident}") < F.col(f"b_{ident}")))
    return a.join(b, [*keys, "_bin"]).where(later & (gap <= reach)).drop("_bin")


def standardised(values: Column) -> Column:
    """Zero mean, unit population variance; missing entries become 0, constant vectors all 0."""
    x = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))

    # Mean and spread reach the inner functions as bound values, so a vector is walked three times in all.
    def by_mean(mean):
        return F.aggregate(x, F.lit(0.0), lambda q, v: q + (v - mean) * (v - mean), lambda q: by_sd(mean, F.sqrt(F.try_divide(q, F.size(x)))))

    def by_sd(mean, sd):
        one = F.array(F.struct(mean.alias("m"), sd.alias("d")))
        return F.flatten(F.transform(one, lambda c: F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v) | ~(F.coalesce(c["d"], F.lit(0.0)) > 0), 0.0).otherwise((v - c["m"]) / c["d"]))))

    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v, lambda s: F.array(F.try_divide(s, F.size(x))))
    return F.flatten(F.transform(total, by_mean))


def linkage_r2(df: DataFrame, keys: list[str], at: str, ident: str, vector: str, reach: int) -> DataFrame:
    """Squared correlation of every pair of vectors within reach, and its 8-bit form."""
    z = df.withColumn("_z", standardised(F.col(vector).cast("array<double>")))
    p = pairs_within(z, keys, at, ident, reach, ["_z"])
    dot = F.aggregate(F.zip_with("a__z", "b__z", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    r = F.try_divide(dot, F.size("a__z"))
    return p.select(*keys, F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b"), (r * r).alias("r2")).withColumn("r2_byte", F.floor(F.col("r2") * 255 + 0.5).cast("int"))


def dosage_similarity(df: DataFrame, keys: list[str], at: str, ident: str, vector: str, reach: int) -> DataFrame:
    """1 - mean |difference| / 2 over entries present in both; null without any."""
    p = pairs_within(df.withColumn("_v", F.col(vector).cast("array<double>")), keys, at, ident, reach, ["_v"])
    d = F.filter(F.zip_with("a__v", "b__v", lambda x, y: F.abs(x - y)), lambda v: v.isNotNull())
    return p.select(*keys, F.col(f"a_{ident}").alias("a"), F.col(f"b_{ident}").alias("b"), (1 - F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, v: s + v), F.size(d)) / 2).alias("similarity"))


def mutual_information(df: DataFrame, keys: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """In bits, over rows with both values; null below `least` rows."""
    t = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"))
    over = lambda *c: F.sum("_n").over(Window.partitionBy(*keys, *c))
    t = t.withColumn("_x", over(x)).withColumn("_y", over(y)).withColumn("n", over())
    term = F.col("_n") / F.col("n") * F.log2(F.col("_n") * F.col("n") / (F.col("_x") * F.col("_y")))
    return t.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(term).alias("_mi")).select(*keys, "n", F.when(F.col("n") >= least, F.col("_mi")).alias("bits"))


def _shares(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    t = df.where(F.col(fine).isNotNull() & F.col(coarse).isNotNull()).groupBy(fine, coarse).agg(F.count(F.lit(1)).alias("_n"))
    return t.withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy(fine)))


def fuse_events(df: DataFrame, fine: str, coarse: str, share: float = 0.8, least: int = 2) -> DataFrame:
    """Coarse labels that take in at least `least` fine labels, each with at least `share` of its rows."""
    inside = _shares(df, fine, coarse).where(F.col("_share") >= share)
    return inside.groupBy(coarse).agg(F.count(F.lit(1)).alias("n_fine")).where(F.col("n_fine") >= least)


def plurality_parent(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """The coarse label that most rows of each fine label have (ties to the lowest), and whether others share it."""
    best = _shares(df, fine, coarse).groupBy(fine).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(coarse).alias("c"))).alias("_b"))
    out = best.select(fine, F.col("_b.c").alias("parent"))
    return out.withColumn("merges", F.count(F.lit(1)).over(Window.partitionBy("parent")) > 1)


def leave_one_out_fst(df: DataFrame, site: str, band: str, group: str, alt: str, total: str, least: int = 2) -> DataFrame:
    """Hudson FST between band 0 and band 1 without each group in turn; group null is all of them.

    Counts are summed per site, band and group once; leaving a group out is a
    subtraction, so no row is copied per group.  Sites with under `least`
    alleles in a band are left out.
    """
    parts = df.groupBy(site, band, group).agg(F.sum(alt).alias("_a"), F.sum(total).alias("_t"))
    wide = lambda d, *by: d.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(band) == b, F.col(c))), F.lit(0)).alias(f"{c}{b}") for b in (0, 1) for c in ("_a", "_t")])
    names = ["_a0", "_t0", "_a1", "_t1"]
    whole = wide(parts, site).select(site, *[F.col(c).alias(f"w{c}") for c in names])
    every = parts.select(group).where(F.col(group).isNotNull()).distinct()
    cells = whole.join(every).join(wide(parts, site, group), [site, group], "left")  # one row for each site and group
    minus = cells.select(group, *[(F.col(f"w{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names])
    rows = minus.unionByName(whole.select(F.lit(None).cast(df.schema[group].dataType).alias(group), *[F.col(f"w{c}").alias(c) for c in names])).where((F.col("_t0") >= least) & (F.col("_t1") >= least))
    num, den = hudson_terms(F.col("_a0") / F.col("_t0"), F.col("_t0"), F.col("_a1") / F.col("_t1"), F.col("_t1"))
    return rows.groupBy(group).agg(F.try_divide(F.sum(num), F.sum(den)).alias("fst"))


@lru_cache(maxsize=4096)
def _rank_sum_counts(n1: int, n0: int) -> tuple[int, ...]:
    """How many of the orders of n1 and n0 rows have each U, as the Gaussian binomial's coefficients."""
    out = [1] + [0] * (n1 * n0)
    for i in range(1, n1 + 1):
        for at in range(len(out) - 1, n0 + i - 1, -1):
            out[at] -= out[at - n0 - i]
        for at in range(i, len(out)):
            out[at] += out[at - i]
    return tuple(out)


@F.pandas_udf(DoubleType())
def exact_rank_p(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    """Two-sided p of U without ties; null where a side is empty."""

    def p(u, n1, n0):
        if pd.isna(u) or n1 < 1 or n0 < 1:
            return None
        counts = _rank_sum_counts(int(n1), int(n0))
        return min(1.0, 2 * sum(counts[: int(min(u, n1 * n0 - u)) + 1]) / sum(counts))

    return pd.Series([p(*x) for x in zip(u, n1, n0, strict=True)], dtype="float64")


def pairwise_ranks(df: DataFrame, keys: list[str], group: str, value: str, exact_below: int = 50) -> DataFrame:
    """Rank test of each pair a < b of a key's groups: U of a, z, p, and q adjusted over the key's pairs.

    p is exact where both sides have fewer than `exact_below` rows and no
    value repeats, and normal with ties and continuity corrected elsewhere.
    Rows with a null group or value are left out; where all values are equal
    z, p and q are null, and the pair does not count in the adjustment.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(group).alias("_group"), F.col(value).alias("_value"))
    known = rows.select(*keys, "_group").distinct()
    pairs = known.withColumnRenamed("_group", "a").join(known.withColumnRenamed("_group", "b"), keys).where("a < b")
    sided = pairs.withColumn("_side", F.explode(F.array("a", "b"))).withColumnRenamed("_side", "_group")
    both = rows.join(sided, [*keys, "_group"]).withColumn("_first", F.col("_group") == F.col("a"))
    by = [*keys, "a", "b"]
    ties = both.groupBy(*by, "_value").count().groupBy(*by).agg((F.max("count") > 1).alias("_tied"))
    t = mann_whitney(both, by, "_first", "_value").join(ties, by)
    small = ~F.col("_tied") & (F.col("n1") < exact_below) & (F.col("n0") < exact_below)
    p = F.when(F.col("z").isNull(), None).when(small, exact_rank_p("u", "n1", "n0")).otherwise(chi_square_survival(F.col("z") * F.col("z"), F.lit(1)))
    t = t.withColumn("p", p)
    late = Window.partitionBy(*keys).orderBy(F.desc("p"))
    place = F.sum(F.when(F.col("p").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(F.col("p").asc_nulls_last()))
    m = F.count("p").over(Window.partitionBy(*keys))
    t = t.withColumn("_q", F.col("p") * m / place)
    return t.select(*by, "n1", "n0", "u", "z", "p", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.min("_q").over(late))).alias("q"))


def co_association(votes: DataFrame, keys: list[str], weight: str, visited: str, excluded: str, alternatives: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Per pair of bands a < b that some vote mentions: weight together, apart, and the share together.

    A vote puts two bands together that it visits both, or excludes both unless
    they are `alternatives` of one another; one visited and one excluded are
    apart.  A band counts once a vote.  Votes without a positive weight take no
    part, null lists are empty, null bands are passed over; pairs that no vote
    mentions are left out.
    """
    kind = votes.schema[visited].dataType
    lists = votes.where(F.col(weight) > 0).select(*keys, F.col(weight).alias("_w"), *[F.coalesce(F.col(c), F.array().cast(kind)).alias(n) for c, n in ((visited, "_in"), (excluded, "_out"))])
    pairs = lists.withColumn("_all", F.array_union("_in", "_out")).withColumn("a", F.explode("_all")).withColumn("b", F.explode("_all")).where("a < b")
    both = lambda c: F.array_contains(c, F.col("a")) & F.array_contains(c, F.col("b"))
    apart = F.lit(False) if alternatives is None else F.coalesce(alternatives(F.col("a"), F.col("b")), F.lit(False))
    joined = both("_in") | (both("_out") & ~apart)
    t = pairs.withColumn("_with", F.coalesce(joined, F.lit(False))).groupBy(*keys, "a", "b").agg(F.sum(F.when(F.col("_with"), F.col("_w")).otherwise(0)).alias("together"), F.sum(F.when(F.col("_with"), 0).otherwise(F.col("_w"))).alias("apart"))
    return t.withColumn("share", F.col("together") / (F.col("together") + F.col("apart")))
