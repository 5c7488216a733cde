"""Exact statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str, largest: int | None = None) -> DataFrame:
    """Two-sided p of a 2x2 table: all tables no likelier than the one seen.  A margin of 0 gives 1.

    Likelihoods are relative to the mode's, by the ratio of neighbouring tables
    from the mode outward.  Tables of more than `largest`, if given, give null.
    """
    a_, b_, c_, d_ = (F.col(x).cast("long") for x in (a, b, c, d))
    t = df.withColumn("_a", a_).withColumn("_r1", a_ + b_).withColumn("_c1", a_ + c_).withColumn("_n", a_ + b_ + c_ + d_)
    seen, r1, c1, n = F.col("_a"), F.col("_r1"), F.col("_c1"), F.col("_n")
    t = t.withColumn("_lo", F.greatest(F.lit(0), r1 + c1 - n)).withColumn("_hi", F.least(r1, c1))
    lo, hi = F.col("_lo"), F.col("_hi")
    # (r1 + 1) (c1 + 1) may pass 2^63; a mode that is off by rounding only changes what likelihoods are relative to.
    mode = F.floor((r1 + 1).cast("double") * (c1 + 1) / (n + 2)).cast("long")
    t = t.withColumn("_mode", F.greatest(lo, F.least(hi, mode)))
    mode = F.col("_mode")

    def up(x):
        """Likelihood of x against x - 1."""
        return (r1 - x + 1).cast("double") * (c1 - x + 1) / (x.cast("double") * (n - r1 - c1 + x))

    def down(x):
        """Likelihood of x against x + 1."""
        return 1 / up(x + 1)

    def walk(first, last, step: int, ratio, start, merge):
        some = F.when(first <= last if step > 0 else first >= last, F.sequence(first, last, F.lit(step).cast("long")))
        return F.aggregate(F.coalesce(some, F.array().cast("array<long>")), start, lambda s, x: merge(s, ratio(x)))

    one = lambda s, r: s * r
    t = t.withColumn("_seen", walk(mode + 1, seen, 1, up, F.lit(1.0), one) * walk(mode - 1, seen, -1, down, F.lit(1.0), one))
    most = F.col("_seen") * (1 + 1e-12 + 1e-15 * (hi - lo))  # ties, within the rounding of so many products

    def sums(s, r):
        w = s["w"] * r
        return F.struct(w.alias("w"), (s["total"] + w).alias("total"), (s["tail"] + F.when(w <= most, w).otherwise(0.0)).alias("tail"))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("total"), F.lit(0.0).alias("tail"))
    t = t.withColumn("_up", walk(mode + 1, hi, 1, up, zero, sums)).withColumn("_down", walk(mode - 1, lo, -1, down, zero, sums))
    tail = F.col("_up.tail") + F.col("_down.tail") + F.when(most >= 1, 1.0).otherwise(0.0)
    p = F.when((r1 == 0) | (c1 == 0) | (r1 == n) | (c1 == n), 1.0).otherwise(F.least(F.lit(1.0), tail / (F.col("_up.total") + F.col("_down.total") + 1)))
    if largest is not None:
        p = F.when(n <= largest, p)
    return t.withColumn("p", p).drop("_a", "_r1", "_c1", "_n", "_lo", "_hi", "_mode", "_seen", "_up", "_down")


def odds_ratio(a: str, b: str, c: str, d: str, haldane: bool = False) -> Column:
    h = 0.5 if haldane else 0.0
    a_, b_, c_, d_ = (F.col(x) + F.lit(h) for x in (a, b, c, d))
    return F.try_divide(a_ * d_, b_ * c_)


def woolf_interval(a: str, b: str, c: str, d: str, z: float = 1.959963984540054) -> Column:
    """Odds ratio with half added to every cell, and its interval by the logarithm's standard error."""
    cells = [F.col(x) + F.lit(0.5) for x in (a, b, c, d)]
    log = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    error = F.sqrt(sum((1 / x for x in cells[1:]), 1 / cells[0]))
    return F.struct(F.exp(log).alias("odds"), F.exp(log - z * error).alias("lower"), F.exp(log + z * error).alias("upper"))


def fisher_greater(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds p_greater: the chance of a table with at least as many in the first cell.  A margin of 0 gives 1.

    The likelihoods of the tables above are those of the seen table times ratios
    of neighbours; below likewise, so nothing overflows.
    """
    a_, b_, c_, d_ = (F.col(x).cast("double") for x in (a, b, c, d))
    up = F.least(F.col(b), F.col(c)).cast("long")
    down = F.least(F.col(a), F.col(d)).cast("long")
    more = lambda k: (b_ - k + 1) * (c_ - k + 1) / ((a_ + k) * (d_ + k))
    fewer = lambda k: (a_ - k + 1) * (d_ - k + 1) / ((b_ + k) * (c_ + k))

    def walk(last, ratio):
        steps = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        add = lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["s"] + s["w"] * ratio(k)).alias("s"))
        return F.aggregate(F.coalesce(steps, F.array().cast("array<long>")), start, add)["s"]

    t = df.withColumn("_up", walk(up, more)).withColumn("_down", walk(down, fewer))
    return t.withColumn("p_greater", F.least(F.lit(1.0), (1 + F.col("_up")) / (1 + F.col("_up") + F.col("_down")))).drop("_up", "_down")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information and Cramer's V of two labelings."""
    t = contingency(df, x, y)
    pairs = lambda c: c * (c - 1) / 2
    xs, ys = t.groupBy(x).agg(F.sum("n").alias("nx")), t.groupBy(y).agg(F.sum("n").alias("ny"))
    n = t.agg(F.sum("n").alias("total"))
    cells = t.join(xs, x).join(ys, y).crossJoin(F.broadcast(n))  # n is one row
    e = F.col("nx") * F.col("ny") / F.col("total")
    cell = cells.agg(
        F.sum(pairs(F.col("n"))).alias("s"),
        F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"),
        F.sum(F.col("n") * F.col("n") / e).alias("q"),
        F.max("total").alias("total"),
    )
    side = lambda s, c, k: s.crossJoin(F.broadcast(n)).agg(F.sum(pairs(F.col(c))).alias(f"s{k}"), F.sum(-F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))).alias(f"h{k}"), F.count(F.lit(1)).alias(f"k{k}"))
    one = cell.crossJoin(side(xs, "nx", 1)).crossJoin(side(ys, "ny", 2))
    expected = F.col("s1") * F.col("s2") / pairs(F.col("total"))
    most = (F.col("s1") + F.col("s2")) / 2
    return one.select(
        F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"),
        F.when(F.col("h1") + F.col("h2") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("h1") + F.col("h2"))).alias("nmi"),
        F.sqrt((F.col("q") - F.col("total")) / (F.col("total") * (F.least("k1", "k2") - 1))).alias("cramer_v"),
    )


def entropy(shares: Column) -> Column:
    """-sum p ln p over the positive entries of an array."""
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log(p))
