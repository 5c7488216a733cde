"""Summaries of variants, samples, groups, windows and genes.

All are grouped aggregates that Spark combines before it shuffles; spines of
categories are literal lists.  Rows with a null key form a group of their own,
null values are left out of means and counted nowhere unless stated; an empty
table gives no rows, or the spine with zeros where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import first_match
from .variant_rules import holds


def significant_counts(df: DataFrame, keys: list[str], fdr: Column, cutoff: float = 0.05) -> DataFrame:
    """Rows, and rows under the cutoff, per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(holds(fdr < cutoff)).alias("n_significant"))


def joined_members(df: DataFrame, keys: list[str], member: str, joint: str = ";") -> DataFrame:
    """Distinct members of each key, sorted and joined, and how many; null members are no members."""
    names = F.array_sort(F.collect_set(F.col(member).cast("string")))
    return df.groupBy(*keys).agg(F.array_join(names, joint).alias("members"), F.size(names).cast("long").alias("n_members"))


def collapse_terms(df: DataFrame, terms: str, kind: str, precedence: list[str], place: str, pattern: str = ";") -> DataFrame:
    """Per term of a delimited list: rows, the kind that comes first in precedence, and distinct places."""
    rank = first_match([(F.col(kind) == k, str(i)) for i, k in enumerate(precedence)], str(len(precedence))).cast("int")
    rows = df.select(F.explode(F.split(terms, pattern)).alias("term"), rank.alias("rank"), place).where("term <> ''")
    out = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.count_distinct(place).alias("n_places"))
    return out.select("term", "n", F.try_element_at(F.array(*map(F.lit, precedence)), F.col("rank") + 1).alias("kind"), "n_places")


def covered_share(df: DataFrame, keys: list[str], length: Column, callable_bp: Column | float) -> DataFrame:
    """Length under segments per key and its share of the callable length."""
    total = callable_bp if isinstance(callable_bp, Column) else F.lit(float(callable_bp))
    return df.groupBy(*keys).agg(F.sum(length).alias("bp"), F.count(F.lit(1)).alias("n")).withColumn("share", F.try_divide(F.col("bp"), total))


def inside_outside(df: DataFrame, keys: list[str], value: str, overlap: Column, width: Column) -> DataFrame:
    """Means of windows inside and outside; inside is more than half overlapped."""
    inside = holds(overlap > width / 2)
    return df.groupBy(*keys).agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"), F.avg(F.when(inside, F.col(value))).alias("inside"), F.avg(F.when(~inside, F.col(value))).alias("outside"))


def length_bins(df: DataFrame, keys: list[str], length: Column, bounds: list[float]) -> DataFrame:
    """Summed length by bins [bound, next bound), the last without end, one column each, 0 where none."""
    tops = [*bounds[1:], None]
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when((length >= a) & (F.lit(True) if b is None else length < b), length)), F.lit(0)).alias(f"bin_{i}") for i, (a, b) in enumerate(zip(bounds, tops, strict=True))])


def summary_of_means(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Means over the inner key first; then count, mean, median and quartiles of those."""
    means = df.groupBy(*outer, *inner).agg(F.avg(value).alias("m"))
    return means.groupBy(*outer).agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.median("m").alias("median"), F.percentile("m", 0.25).alias("q25"), F.percentile("m", 0.75).alias("q75"))


def means_by(value: Column, label: Column, labels: list[str]) -> list[Column]:
    """One mean per label."""
    return [F.avg(F.when(label == x, value)).alias(f"mean_{x}") for x in labels]


def spread_summary(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"), F.min(value).alias("least"), F.max(value).alias("most")]


def site_terms(p1: Column, n1: Column, p2: Column, n2: Column) -> dict[str, Column]:
    """Per-site diversity within and between two groups, Hudson's terms, and whether a site is private, fixed or shared."""
    h1, h2 = 2 * p1 * (1 - p1), 2 * p2 * (1 - p2)
    between = p1 * (1 - p2) + p2 * (1 - p1)
    corrected = (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / F.nullif(n1 - 1, F.lit(0)) - p2 * (1 - p2) / F.nullif(n2 - 1, F.lit(0))
    return {"pi1": h1, "pi2": h2, "dxy": between, "delta": F.abs(p1 - p2), "num": corrected, "den": between, "private1": (p1 > 0) & (p2 == 0), "private2": (p2 > 0) & (p1 == 0), "fixed": ((p1 == 1) & (p2 == 0)) | ((p1 == 0) & (p2 == 1)), "shared": (p1 > 0) & (p1 < 1) & (p2 > 0) & (p2 < 1)}


def uncorrected_fst(p1: Column, p2: Column) -> Column:
    """Per-site ratio without sample-size correction; null where nothing differs between the groups."""
    return (p1 - p2) * (p1 - p2) / F.nullif(p1 * (1 - p2) + p2 * (1 - p1), F.lit(0.0))


def window_diversity(sites: DataFrame, keys: list[str], p1: Column, n1: Column, p2: Column, n2: Column) -> DataFrame:
    """Per window: mean diversities, ratio-of-sums FST held to 0..1, and counts of private, fixed and shared sites."""
    t = site_terms(p1, n1, p2, n2)
    rows = sites.select(*keys, *[c.alias(k) for k, c in t.items()])
    fst = F.try_divide(F.sum("num"), F.nullif(F.sum("den"), F.lit(0.0)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sites"), *[F.avg(k).alias(k) for k in ("pi1", "pi2", "dxy", "delta")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), fst)).alias("fst"), *[F.count_if(holds(F.col(k))).alias(k) for k in ("private1", "private2", "fixed", "shared")]
    )


def heterozygosity_ratio(observed: Column, frequency: Column) -> Column:
    """Observed over expected heterozygosity; null at fixed sites."""
    return observed / F.nullif(2 * frequency * (1 - frequency), F.lit(0.0))


def pair_bins(df: DataFrame, a: Column, b: Column, width: int, value: str) -> DataFrame:
    """Mean and count per unordered pair of bins."""
    x, y = F.floor(a / width).cast("long"), F.floor(b / width).cast("long")
    return df.groupBy(F.least(x, y).alias("bin1"), F.greatest(x, y).alias("bin2")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def enrichment_counts(df: DataFrame, term: str, entity: str, target: Column) -> DataFrame:
    """Per term the distinct entities in the target and in the background, with both totals: the cells of a 2 x 2 table."""
    rows = df.select(term, entity, holds(target).alias("hit")).distinct()
    total = rows.select(entity, "hit").distinct().agg(F.count_if("hit").alias("n_target"), F.count_if(~F.col("hit")).alias("n_background"))
    per = rows.groupBy(term).agg(F.count_if("hit").alias("k_target"), F.count_if(~F.col("hit")).alias("k_background"))
    return per.crossJoin(F.broadcast(total))  # one row


def two_level_counts(df: DataFrame, outer: str, inner: str, item: str, least: int) -> DataFrame:
    """Per outer key: distinct inner keys, items, and inner keys that have at least `least` items."""
    per = df.groupBy(outer, inner).agg(F.count_distinct(item).alias("k"))
    return per.groupBy(outer).agg(F.count(F.lit(1)).alias("n_inner"), F.sum("k").alias("n_items"), F.count_if(F.col("k") >= least).alias("n_recurrent"))


def group_frequencies(df: DataFrame, item: str, group: str, member: str) -> DataFrame:
    """Per item and group: distinct members that have the item, and their share of the group's members."""
    sizes = df.groupBy(group).agg(F.count_distinct(member).alias("size"))
    return df.groupBy(item, group).agg(F.count_distinct(member).alias("carriers")).join(sizes, group).withColumn("frequency", F.col("carriers") / F.col("size"))


def recurrent(frequencies: DataFrame, item: str, group: str, top: int | None = None) -> DataFrame:
    """Per item: carriers, groups, the group of the largest frequency (ties to the smaller name) and the largest contrast of two groups that have it."""
    best = F.min(F.struct((-F.col("frequency")).alias("f"), F.col(group).alias("g")))
    out = frequencies.groupBy(item).agg(F.sum("carriers").alias("carriers"), F.count(F.lit(1)).alias("n_groups"), best["g"].alias("top_group"), (-best["f"]).alias("top_frequency"), (F.max("frequency") - F.min("frequency")).alias("contrast"))
    out = out.withColumn("status", F.when(F.col("n_groups") == 1, "private").otherwise("shared"))
    return out if top is None else out.orderBy(F.desc("carriers"), item).limit(top)


def exclusivity(frequencies: DataFrame, item: str, group: str) -> DataFrame:
    """Per group: items, and items that no other group has."""
    alone = frequencies.groupBy(item).agg(F.count(F.lit(1)).alias("n_groups"))
    return frequencies.join(alone, item).groupBy(group).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("n_groups") == 1).alias("n_exclusive"))


def mean_over_ordered_pairs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of |x_i - x_j| over ordered pairs of different rows of each key, without making the pairs.

    With ranks r of the sorted values the sum over i<j is sum((2r - n - 1) x);
    one row alone gives 0.
    """
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    total = F.sum((2 * F.col("_r") - F.col("_n") - 1) * F.col(value))
    return ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(2 * total, F.max("_n") * (F.max("_n") - 1)), F.lit(0.0)).alias("mean"), F.max("_n").alias("n"))


def with_spine(counts: DataFrame, column: str, labels: list[str], fill: list[str]) -> DataFrame:
    """All labels, in rows of their own, with zeros where nothing was counted."""
    spine = counts.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    return F.broadcast(spine).join(counts, column, "left").fillna(0, fill)


def status_matrix(df: DataFrame, columns: list[str], statuses: list[str]) -> DataFrame:
    """One row a column, one count a status."""
    long = df.unpivot([], columns, "question", "status")
    return long.groupBy("question").agg(*[F.count_if(holds(F.col("status") == s)).alias(s) for s in statuses])


def density_fold(n_inside: Column, inside_bp: Column, n_outside: Column, outside_bp: Column, pseudo: float = 1e-6) -> Column:
    """log2 of the densities per Mb, each with a pseudo density."""
    return F.log2((n_inside / (inside_bp / 1e6) + pseudo) / (n_outside / (outside_bp / 1e6) + pseudo))


def context_enrichment(df: DataFrame, kind: str, contexts: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per kind and context: rows within, all rows, and the observed share over the context's share of the genome."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(holds(c)).alias(name) for name, (c, _) in contexts.items()])
    long = counts.unpivot([kind, "n"], list(contexts), "context", "n_in")
    expected = F.element_at(F.create_map(*[x for name, (_, share) in contexts.items() for x in (F.lit(name), F.lit(float(share)))]), F.col("context"))
    return long.withColumn("fold", F.col("n_in") / F.col("n") / F.greatest(expected, F.lit(1e-9)))


def histogram(df: DataFrame, value: Column, bounds: list[float], kind: str) -> DataFrame:
    """Rows per kind and bin; a bin reaches from the bound before (excluded) to its own (included)."""
    label = first_match([(value <= b, f"{i:02d}") for i, b in enumerate(bounds)], f"{len(bounds):02d}")
    return df.groupBy(kind, label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def diversity(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: Shannon entropy (bits) of the items, the largest share, and whether one dominates (0.8) or leads (0.5)."""
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    out = counts.withColumn("p", share).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), (-F.sum(F.col("p") * F.log2("p"))).alias("bits"), F.max("p").alias("largest"))
    return out.withColumn("flag", first_match([(F.col("largest") >= 0.8, "bottleneck"), (F.col("largest") >= 0.5, "skewed")], "diverse"))


def melted_counts(df: DataFrame, kind: str, samples: list[str]) -> DataFrame:
    """Per sample column and kind: how many rows have a value above 0."""
    counts = df.groupBy(kind).agg(*[F.count_if(holds(F.col(s) > 0)).alias(s) for s in samples])
    return counts.unpivot([kind], samples, "sample", "n")


def gap_summary(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Sites, median, 90th percentile and largest gap between neighbours, and sites per kb of the span."""
    gaps = df.withColumn("_gap", F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at)))
    span = F.max(at) - F.min(at)
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("_gap").alias("median_gap"), F.percentile("_gap", 0.9).alias("p90_gap"), F.max("_gap").alias("largest_gap"), F.try_divide(F.count(F.lit(1)) * 1000.0, span).alias("per_kb"))


def block_support(df: DataFrame, sample: str, block: str, at: str, tiers: dict[str, Column]) -> DataFrame:
    """Per sample: rows, rows of each tier, blocks, the largest block's rows and the mean span of blocks."""
    flagged = df.select(sample, block, at, *[holds(c).alias(t) for t, c in tiers.items()])
    per = flagged.groupBy(sample, block).agg(F.count(F.lit(1)).alias("k"), (F.max(at) - F.min(at)).alias("span"), *[F.count_if(t).alias(t) for t in tiers])
    return per.groupBy(sample).agg(F.sum("k").alias("n"), *[F.sum(t).alias(t) for t in tiers], F.count(block).alias("n_blocks"), F.max(F.when(F.col(block).isNotNull(), F.col("k"))).alias("largest"), F.avg(F.when(F.col(block).isNotNull(), F.col("span"))).alias("mean_span"))


def anchor_eligibility(df: DataFrame, key: str, distance: str, coherent: Column, core: Column, least: int = 5, least_core: int = 3, most_cv: float = 0.5, least_share: float = 0.6) -> DataFrame:
    """Per group: members, core members, variation of distances, coherent share, and the first reason against it.

    The bounds are defaults of this library; give those of the study.
    """
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(holds(core)).alias("n_core"), F.when(F.avg(distance) != 0, F.stddev_samp(distance) / F.avg(distance)).alias("cv"), F.avg(holds(coherent).cast("int")).alias("coherent"))
    return out.withColumn("reason", first_match([(F.col("n") < least, "too_few"), (F.col("n_core") < least_core, "small_core"), (F.col("cv") > most_cv, "dispersed"), (F.col("coherent") < least_share, "incoherent")], "eligible"))
