"""Local covariance by window, and distances between all rows of a key.

Covariances come from sums that every task forms over its own rows, so a window
may hold any number of sites.  Distances are matrices by definition: rows of a
key are dealt to blocks, and each pair of blocks is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _canonical

HELD = 64  # windows whose sums a task holds at once
ROWS = 512  # rows of a block


def _dosages(column: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in column], dtype=float)


def window_eigen(df: DataFrame, window: str, vector: str, k: int = 2) -> DataFrame:
    """Per window: sites, the covariance's sum of squares, its k first eigenvalues, their vectors and shares.

    A row is a site, its vector holds a value for each sample, all of one
    length.  Values are centred by site and covariances taken over the sites
    that both samples have; a window where some pair shares fewer than two, or
    with fewer samples than k, has nulls.  Null vectors and windows take no
    part, and an empty table gives no rows.
    """
    kind = dict(df.dtypes)[window]
    sums = f"{window} {kind}, i int, sites long, n array<double>, s array<double>, p array<double>"

    def partial(frames):
        held: dict = {}

        def flush():
            for name, (sites, n, s, p) in held.items():
                d = len(n)
                yield pd.DataFrame({window: [name] * d, "i": range(d), "sites": [sites] * d, "n": list(n), "s": list(s), "p": list(p)})
            held.clear()

        for frame in frames:
            for name, rows in frame.groupby(window, sort=False):
                x = _dosages(rows[vector])
                there = ~np.isnan(x)
                count = there.sum(1, keepdims=True)
                x = np.where(there, x - np.nansum(x, 1, keepdims=True) / np.maximum(count, 1), 0.0)
                m = there.astype(float)
                new = (len(x), m.T @ m, x.T @ m, x.T @ x)
                old = held.get(name)
                held[name] = new if old is None else tuple(a + b for a, b in zip(old, new, strict=True))
                if len(held) >= HELD:
                    yield from flush()
        yield from flush()

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        total = {c: [np.sum(np.stack(rows[c].to_numpy()), 0)] for c in "nsp"}
        return pd.DataFrame({window: rows[window].iloc[:1].to_list(), "i": [rows["i"].iloc[0]], "sites": [rows["sites"].sum()], **total})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        n, s, p = (np.stack(rows[c].to_numpy()) for c in "nsp")
        out = {window: [rows[window].iloc[0]], "sites": [rows["sites"].iloc[0]], "total": [None], "lam": [None], "axes": [None], "shares": [None]}
        if (n >= 2).all() and len(n) >= k:
            cov = (p - s * s.T / n) / (n - 1)
            values, vectors = np.linalg.eigh((cov + cov.T) / 2)
            top = np.argsort(-values)[:k]
            positive = values[values > 0].sum()
            out |= {"total": [float((cov * cov).sum())], "lam": [values[top].tolist()], "axes": [_canonical(vectors[:, top]).T.tolist()]}
            out["shares"] = [(np.maximum(values[top], 0) / positive).tolist() if positive > 0 else None]
        return pd.DataFrame(out)

    whole = df.where(F.col(window).isNotNull() & F.col(vector).isNotNull()).select(window, F.col(vector).cast("array<double>").alias(vector))
    parts = whole.mapInPandas(partial, sums).groupBy(window, "i").applyInPandas(combine, sums)
    return parts.groupBy(window).applyInPandas(solve, f"{window} {kind}, sites long, total double, lam array<double>, axes array<array<double>>, shares array<double>")


def block_pairs(df: DataFrame, key: str, ident: str, columns: list[str], distance: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]) -> DataFrame:
    """Each pair a < b of a key's rows with its distance; `distance` answers a whole pair of blocks.

    Rows with a null key or id take no part; an id that repeats within a key
    is a row of its own, but has no distance to itself.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(key, ident, *columns)
    largest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-largest // ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(ident), F.lit(blocks)))
    left = rows.withColumn("_a", F.col("_block")).withColumn("_b", F.explode(F.sequence("_block", F.lit(blocks - 1).cast("long"))))
    again = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own: a cogroup of one table with itself mixes them up
    right = again.withColumn("_b", F.col("_block")).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), "_block")))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (key, "a", "b", "distance")})
        d = distance(a, b)
        x, y = a[ident].to_numpy(), b[ident].to_numpy()
        same = a["_block"].iloc[0] == b["_block"].iloc[0]
        i, j = np.nonzero(x[:, None] < y[None] if same else x[:, None] != y[None])
        first, second = x[i], y[j]
        swap = first > second
        plain = lambda v: pd.Series(v, dtype=object)
        value = plain(d[i, j]).where(~np.isnan(d[i, j]), None)
        return pd.DataFrame({key: plain([a[key].iloc[0]] * len(i)), "a": plain(np.where(swap, second, first)), "b": plain(np.where(swap, first, second)), "distance": value})

    pairs = left.groupBy(key, "_a", "_b").cogroup(right.groupBy(key, "_a", "_b"))
    return pairs.applyInPandas(run, f"{key} {kinds[key]}, a {kinds[ident]}, b {kinds[ident]}, distance double")


def local_structure_distance(windows: DataFrame, key: str, ident: str, lam: str = "lam", axes: str = "axes", scaled: bool = True) -> DataFrame:
    """Frobenius distance between windows' covariances as their first eigenvectors give them.

    `scaled` divides eigenvalues by their absolute sum; windows with nulls, or
    where that sum is 0, have null distances.
    """

    def weights(frame: pd.DataFrame) -> np.ndarray:
        v = np.stack(frame[lam].to_numpy())
        size = np.abs(v).sum(1, keepdims=True)
        return np.where(size > 0, v / np.where(size > 0, size, 1), np.nan) if scaled else v

    def distance(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        out = np.full((len(a), len(b)), np.nan)
        good_a, good_b = a[lam].notna().to_numpy(), b[lam].notna().to_numpy()
        a, b = a[good_a], b[good_b]
        if len(a) and len(b):
            v, w = weights(a), weights(b)
            flat = lambda f: np.stack([np.stack(x) for x in f[axes]])
            x, y = flat(a), flat(b)
            dots = np.einsum("ikn,jln->ijkl", x, y, optimize=True) ** 2
            cross = np.einsum("ik,jl,ijkl->ij", v, w, dots, optimize=True)
            d2 = (v * v).sum(1)[:, None] + (w * w).sum(1)[None] - 2 * cross
            out[np.ix_(good_a, good_b)] = np.sqrt(np.where(d2 < 0, 0, d2))
        return out

    return block_pairs(windows, key, ident, [lam, axes], distance)


def dosage_distance(df: DataFrame, key: str, ident: str, vector: str, missing: float = 1.0) -> DataFrame:
    """Mean absolute difference of two samples' dosages over all sites; a missing one counts as `missing`."""

    def distance(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        fill = lambda f: np.nan_to_num(_dosages(f[vector]), nan=missing)
        x, y = fill(a), fill(b)
        return np.stack([np.abs(y - row).mean(1) for row in x])

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn(vector, F.col(vector).cast("array<double>"))
    return block_pairs(rows, key, ident, [vector], distance)
