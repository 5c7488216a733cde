"""Running values over a key whose rows are spread over many tasks.

A window over a whole key sorts all its rows in one task.  Here a key is cut
into buckets of an ordered position; a window runs within a bucket, and what a
row needs from other buckets is carried over from one summary row a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_b"
#: Width of a bucket in positions, unless one is given.
WIDTH = 1 << 20


def bucketed(df: DataFrame, at: Column, width: int = WIDTH) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(at / width).cast("long"))


def within(keys: list[str]):
    return Window.partitionBy(*keys, BUCKET)


def carry(df: DataFrame, keys: list[str], before: dict[str, tuple[Callable, Column]] | None = None, after: dict[str, tuple[Callable, Column]] | None = None) -> DataFrame:
    """Adds, per name, the aggregate (a function and its argument) over all earlier or all later buckets of the key.

    Null where there is none.  Null keys form a key of their own.
    """
    before, after = before or {}, after or {}
    sums = df.groupBy(*keys, BUCKET).agg(*[f(c).alias(n) for n, (f, c) in (before | after).items()])
    order = Window.partitionBy(*keys).orderBy(BUCKET)
    down, up = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = sums.select(
        *[F.col(k).alias(f"_c_{k}") for k in [*keys, BUCKET]], *[f(F.col(n)).over(down).alias(n) for n, (f, _) in before.items()], *[f(F.col(n)).over(up).alias(n) for n, (f, _) in after.items()]
    )
    same = F.lit(True)
    for k in [*keys, BUCKET]:
        same = same & df[k].eqNullSafe(carried[f"_c_{k}"])
    return df.join(carried, same).drop(*[f"_c_{k}" for k in [*keys, BUCKET]])
