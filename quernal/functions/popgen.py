"""Trend, rank and genotype statistics, and position thinning."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank within the key, ties sharing the mean of their ranks."""
    part = Window.partitionBy(*keys)
    return F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Rank correlation per key over rows with both values; null below `least` rows and where a side has one value only."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_x", "_y").alias("_c"), (F.var_pop("_x") * F.var_pop("_y")).alias("_v")).withColumn("rho", F.when(F.col("n") >= least, F.try_divide("_c", F.sqrt("_v")))).drop("_c", "_v")


def armitage_z(cases: list[Column], controls: list[Column], scores: list[float]) -> Column:
    """Trend statistic over ordered classes; null where its variance vanishes."""
    n1, n0 = sum(cases, F.lit(0)), sum(controls, F.lit(0))
    total = [a + b for a, b in zip(cases, controls, strict=True)]
    n = n1 + n0
    t = sum((F.lit(s) * (a * n0 - b * n1) for s, a, b in zip(scores, cases, controls, strict=True)), F.lit(0.0))
    s1 = sum((F.lit(s) * c for s, c in zip(scores, total, strict=True)), F.lit(0.0))
    s2 = sum((F.lit(s * s) * c for s, c in zip(scores, total, strict=True)), F.lit(0.0))
    variance = n1 * n0 * (n * s2 - s1 * s1) / F.nullif(n, F.lit(0))
    return F.when(variance > 0, t / F.sqrt(variance))


@F.pandas_udf(DoubleType())  # a type, not its name: names need a session to parse
def two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def genotype_posterior(ref: Column, alt: Column, frequency: Column, error: float = 0.01) -> list[Column]:
    """P(AA), P(AB), P(BB) from read counts with a Hardy-Weinberg prior; no reads give the prior."""
    f = F.least(F.greatest(frequency, F.lit(1e-9)), F.lit(1 - 1e-9))
    prior = [2 * F.log(1 - f), F.log(2 * f * (1 - f)), 2 * F.log(f)]
    logs = [p + alt * math.log(e) + ref * math.log(1 - e) for p, e in zip(prior, (error, 0.5, 1 - error), strict=True)]
    top = F.greatest(*logs)
    weight = [F.exp(x - top) for x in logs]
    return [w / (weight[0] + weight[1] + weight[2]) for w in weight]


def thin(df: DataFrame, keys: list[str], at: str, ident: str, width: int) -> DataFrame:
    """In every bin the row nearest to its middle: ties to the smaller position, then id."""
    bin_ = F.floor(F.col(at) / width)
    away = F.abs(2 * F.col(at) - (2 * bin_ + 1) * width)
    order = Window.partitionBy(*keys, bin_).orderBy(away, at, ident)
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def hash_sample(df: DataFrame, ident: str, share: float, seed: int) -> DataFrame:
    """A reproducible share of the rows by a hash of their id: alike for any partitioning."""
    return df.where(F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
