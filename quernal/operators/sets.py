"""Comparing named sets of members (set, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .rules import first_match


def relation(n_a: Column, n_b: Column, shared: Column) -> Column:
    return first_match([(shared == 0, "DISJOINT"), ((shared == n_a) & (shared == n_b), "IDENTICAL"), ((shared == n_a) | (shared == n_b), "NESTED")], "OVERLAPPING")


def compare_all(df: DataFrame, name: str, member: str, universe: int) -> DataFrame:
    """Every pair of different sets, a before b: sizes, what they share, similarities, relation, Fisher's p over a universe.

    The pairs are of sets, whose number does not grow with the members; what
    they share is counted through the members they have in common.
    """
    rows = df.where(F.col(name).isNotNull() & F.col(member).isNotNull()).select(name, member).distinct()
    sizes = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    a, b = (sizes.select(F.col(name).alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    left, right = (rows.select(F.col(name).alias(k), member) for k in "ab")
    both = left.join(right, member).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    either = F.col("n_a") + F.col("n_b") - F.col("shared")
    out = pairs.withColumns({"jaccard": F.col("shared") / either, "overlap": F.col("shared") / F.least("n_a", "n_b"), "dice": 2 * F.col("shared") / (F.col("n_a") + F.col("n_b")), "relation": relation(F.col("n_a"), F.col("n_b"), F.col("shared"))})
    out = out.withColumns({"_b": F.col("n_a") - F.col("shared"), "_c": F.col("n_b") - F.col("shared"), "_d": F.greatest(F.lit(universe) - either, F.lit(0))})
    return stats.fisher_exact(out, "shared", "_b", "_c", "_d").drop("_b", "_c", "_d")


def co_segregating(df: DataFrame, name: str, member: str, least: float) -> DataFrame:
    """Pairs of sets whose Jaccard similarity is at least a bound."""
    return compare_all(df, name, member, 0).where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")
