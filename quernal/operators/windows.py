"""Sequence operators: gaps, runs, switches, robust scores, ranks and adjusted p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour_gaps(df: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at, ident)
    return df.withColumn("to_previous", F.col(at) - F.lag(at).over(w)).withColumn("to_next", F.lead(at).over(w) - F.col(at))


def neighbour_counts(df: DataFrame, keys: list[str], at: str, reaches: list[int]) -> DataFrame:
    """Other rows of the key within each reach, both ends inclusive."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumns({f"within_{r}": F.count(F.lit(1)).over(w.rangeBetween(-r, r)) - 1 for r in reaches})


def state_switches(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Per key: changes of a non-null state along the order, the dominant state, and 1 - switch rate."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(state).isNotNull()).withColumn("_s", (F.col(state) != F.lag(state).over(w)).cast("int"))
    n, k = F.count(F.lit(1)), F.coalesce(F.sum("_s"), F.lit(0))
    return rows.groupBy(*keys).agg(n.alias("n"), k.alias("switches"), F.expr(f"mode(`{state}`, true)").alias("dominant"), F.when(n > 1, 1 - k / (n - 1)).otherwise(F.lit(1.0)).alias("stability"))


def runs(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Run-length encoding of a value along the order: one row per run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    marked = df.withColumn("_new", first)
    return marked.withColumn("run", F.sum("_new").over(w)).groupBy(*keys, "run").agg(F.first(flag).alias(flag), F.count(F.lit(1)).alias("length"))


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(x - median) / (1.4826 MAD); where the MAD vanishes (x - mean) / sd, and 0 where that does."""
    centre = df.groupBy(*keys).agg(F.expr(f"percentile(`{value}`, 0.5)").alias("_m"), F.avg(value).alias("_a"), F.stddev_samp(value).alias("_s"))
    a = df.join(centre, keys)
    spread = a.groupBy(*keys).agg((F.expr(f"percentile(abs(`{value}` - _m), 0.5)") * 1.4826).alias("_mad"))
    x = F.col(value)
    z = F.when(F.col("_mad") >= 1e-10, (x - F.col("_m")) / F.col("_mad")).when(F.coalesce(F.col("_s"), F.lit(0.0)) > 0, (x - F.col("_a")) / F.col("_s")).otherwise(0.0)
    return a.join(spread, keys).withColumn("z", z).drop("_m", "_a", "_s", "_mad")


def running_total(df: DataFrame, order: str, value: str, buckets: int = 64, tail_min: str | None = None) -> DataFrame:
    """Adds `total`, the sum of value up to each row of a column of distinct orders.

    Rows are cut into buckets at quantiles of the order; only the buckets' sums
    (one row a bucket) are ordered in one task.  With `tail_min`, an SQL
    expression over the row and `total`, adds `least`, its minimum from each
    row to the end.
    """
    edges = df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.1 / buckets)
    bucket = F.lit(0)
    for e in dict.fromkeys(edges):
        bucket = bucket + (F.col(order) > e).cast("int")
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    local = Window.partitionBy("_b").orderBy(order)
    out = rows.join(F.broadcast(before), "_b").withColumn("total", F.col("_before") + F.sum(value).over(local))
    if tail_min is None:
        return out.drop("_b", "_before")
    out = out.withColumn("_t", F.expr(tail_min))
    ends = out.groupBy("_b").agg(F.min("_t").alias("_m"))
    after = ends.select("_b", F.min("_m").over(Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    here = F.min("_t").over(local.rowsBetween(0, Window.unboundedFollowing))
    return out.join(F.broadcast(after), "_b").withColumn("least", F.least(here, F.col("_after"))).drop("_b", "_before", "_t", "_after")


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """q = min over the tail of p * n / rank, at most 1; equal p have equal q, null p a null q.

    Works on the distinct values of p with their counts, as ties share the
    largest rank among them.
    """
    tests = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    n = tests.agg(F.sum("_k")).first()[0] or 0
    q = running_total(tests, "_p", "_k", tail_min=f"least(1D, _p * {n} / total)").select("_p", F.col("least").alias("q"))
    return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def rolling(value: str, keys: list[str], order: list[str], size: int, how=F.avg) -> Column:
    """Centred window of `size` rows, shorter at the ends."""
    back = (size - 1) // 2
    return how(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, size - 1 - back))


def rolling_median(value: str, keys: list[str], order: list[str], size: int) -> Column:
    """Median of the non-null values of the centred window."""
    held = F.array_sort(rolling(value, keys, order, size, F.collect_list))
    n = F.size(held)
    return F.when(n > 0, (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2)


def percentile_rank(df: DataFrame, reference: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Fraction of the reference values of the key that are <= each value."""
    r = reference.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_k"))
    d = df.withColumn("_v", F.col(value)).withColumn("_k", F.lit(1))
    both = d.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    seen = F.sum(1 - F.col("_k")).over(w.orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
    total = F.sum(1 - F.col("_k")).over(w)
    return both.withColumn("fraction", F.when(total > 0, seen / total)).where("_k = 1").drop("_v", "_k")


def keep_best(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def group_ids(df: DataFrame, keys: list[str], name: str = "group_id") -> DataFrame:
    """Dense ids from 1 of the distinct keys in their order; equal (also null) keys share one.

    Only the distinct keys are ordered together.
    """
    ids = df.select(*keys).distinct().withColumn(name, F.row_number().over(Window.orderBy(*keys)))
    same = F.lit(True)
    right = ids.select(*[F.col(k).alias(f"_g_{k}") for k in keys], name)
    for k in keys:
        same = same & df[k].eqNullSafe(right[f"_g_{k}"])
    return df.join(right, same).drop(*[f"_g_{k}" for k in keys])


def global_ids(df: DataFrame, key: str, order: list[str], name: str = "global_id") -> DataFrame:
    """Numbers from 1 over keys in their order, and within a key by the order; only one row a key is ordered in one task."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(key, (F.sum("_n").over(Window.orderBy(key)) - F.col("_n")).alias("_before"))
    return df.join(before, key).withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("_before")


def offsets(lengths: DataFrame, key: str, length: str) -> DataFrame:
    """Each key with the sum of the lengths of the keys before it."""
    return lengths.withColumn("offset", F.coalesce(F.sum(length).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sign_flips(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key: changes of sign along the order (zeros take the sign before), and those from below to above zero; nulls are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(value).isNotNull()).withColumn("_s", F.last(F.nullif(F.signum(value), F.lit(0.0)), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_p", F.lag("_s").over(w))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") != F.col("_p")).alias("flips"), F.count_if((F.col("_p") < 0) & (F.col("_s") > 0)).alias("upward"))


def rank_blocks(df: DataFrame, keys: list[str], order: list, n_blocks: int) -> DataFrame:
    """Adds the place in the order (ties by the order's last columns) and one of n blocks of like size, from 0."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("place", F.row_number().over(w.orderBy(*order)))
    return rows.withColumn("block", F.floor((F.col("place") - 1) * n_blocks / F.count(F.lit(1)).over(w)))


def position_windows(df: DataFrame, keys: list[str], at: str, lengths: DataFrame, size: int, step: int) -> DataFrame:
    """Rows repeated for every window [k * step, k * step + size) that holds them and lies whole within the key's length."""
    rows = df.join(lengths.select(*keys, F.col("length").alias("_length")), keys)
    first = F.greatest(F.floor((F.col(at) - size) / step) + 1, F.lit(0))
    last = F.least(F.floor(F.col(at) / step), F.floor((F.col("_length") - size) / step))
    return rows.where(first <= last).withColumn("window", F.explode(F.sequence(first, last))).drop("_length")


def switch_events(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """One row a change of a non-null state: from what, to what, and where."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(state).isNotNull()).withColumn("before", F.lag(state).over(w))
    return rows.where(F.col("before") != F.col(state)).select(*keys, *order, "before", F.col(state).alias("after"))


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Per key the longest run of rows whose flag holds, 0 if none does."""
    return runs(df, keys, order, flag).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("length"))), F.lit(0)).alias("longest"))


def smoothed_sign(df: DataFrame, keys: list[str], order: list[str], sign: str, weight: str, reach: int) -> DataFrame:
    """Adds the sign that outweighs the other among the rows within reach (1 on a tie)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("consensus", F.when(F.sum(F.col(sign) * F.col(weight)).over(w) < 0, -1).otherwise(1))


def block_coherence(df: DataFrame, keys: list[str], at: str, ties: list[str], to_first: Column, to_second: Column, blocks: int = 4) -> DataFrame:
    """Per key: markers nearer to one group (ties left out), switch rate along positions, and the share of equal-width blocks whose majority is the overall one."""
    label = F.when(to_first < to_second, 1).when(to_second < to_first, 2)
    rows = df.withColumn("_l", label).where("_l is not null")
    w = Window.partitionBy(*keys)
    span = F.greatest(F.max(at).over(w) - F.min(at).over(w), F.lit(1))
    rows = rows.withColumn("_b", F.least(F.floor((F.col(at) - F.min(at).over(w)) * blocks / span), F.lit(blocks - 1)))
    rows = rows.withColumn("_s", (F.col("_l") != F.lag("_l").over(w.orderBy(at, *ties))).cast("int"))
    per = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_l") == 1).alias("a"), F.coalesce(F.sum("_s"), F.lit(0)).alias("s"))
    whole = per.withColumns({"_n": F.sum("n").over(w), "_a": F.sum("a").over(w)})
    agree = ((2 * F.col("a") >= F.col("n")) == (2 * F.col("_a") >= F.col("_n"))).cast("int")
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("n") - 1).alias("switch_rate"), F.avg(agree).alias("agreement"))
