"""Numeric kernels by group, as grouped-map functions in numpy."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _canonical(vectors: np.ndarray) -> np.ndarray:
    """Each column's largest loading is positive."""
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def pca(df: DataFrame, key: str, ident: str, vector: str, k: int = 2) -> DataFrame:
    """First k principal scores of each row within its group, and the share of variance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        x = np.stack([np.asarray(v, float) for v in pdf[vector]])
        x = x - x.mean(0)
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        axes = _canonical(vt[:k].T)
        share = s**2 / max((s**2).sum(), 1e-300)
        return pd.DataFrame({key: pdf[key], ident: pdf[ident], "scores": list(x @ axes), "shares": [share[:k].tolist()] * len(pdf)})

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {ident} {dict(df.dtypes)[ident]}, scores array<double>, shares array<double>")


def classical_mds(df: DataFrame, key: str, ident: str, vector: str, k: int = 2) -> DataFrame:
    """Coordinates whose distances approximate those between the group's vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        x = np.stack([np.asarray(v, float) for v in pdf[vector]])
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        n = len(d)
        j = np.eye(n) - 1 / n
        values, vectors = np.linalg.eigh(-j @ d @ j / 2)
        top = np.argsort(-values)[: min(k, max(1, n - 1))]
        points = _canonical(vectors[:, top]) * np.sqrt(np.maximum(values[top], 0))
        return pd.DataFrame({key: pdf[key], ident: pdf[ident], "point": list(points)})

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, {ident} {dict(df.dtypes)[ident]}, point array<double>")


def kmeans_1d(df: DataFrame, key: str, ident: str, value: str, k: int = 3, rounds: int = 12) -> DataFrame:
    """Lloyd's rounds from quantile centres; clusters are numbered by ascending centre."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        x = pdf[value].to_numpy(float)
        centre = np.quantile(x, (np.arange(k) + 0.5) / k)
        for _ in range(rounds):
            label = np.abs(x[:, None] - centre[None]).argmin(1)
            centre = np.array([x[label == i].mean() if (label == i).any() else centre[i] for i in range(k)])
        order = np.argsort(centre, kind="stable")
        rank = np.argsort(order)
        label = rank[np.abs(x[:, None] - centre[None]).argmin(1)]
        return pd.DataFrame({key: pdf[key], ident: pdf[ident], "cluster": label.astype("int32"), "centre": np.sort(centre)[label]})

    kinds = dict(df.dtypes)
    return df.where(f"`{value}` is not null").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}, cluster int, centre double")


def permutation_p(df: DataFrame, key: str, ident: str, label: str, value: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """Add-one p of |mean difference| between label 1 and 0; each group draws from its own seed.

    Rows with a null value or label take no part; a group with one label alone has null results.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        x, y = pdf[value].to_numpy(float), pdf[label].to_numpy().astype(bool)
        name = pdf[key].iloc[0]
        if y.all() or not y.any():
            return pd.DataFrame({key: [name], "difference": [None], "p": [None]})
        seen = x[y].mean() - x[~y].mean()
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        more = sum(abs(x[s].mean() - x[~s].mean()) >= abs(seen) - 1e-12 for s in (rng.permutation(y) for _ in range(draws)))
        return pd.DataFrame({key: [name], "difference": [seen], "p": [(more + 1) / (draws + 1)]})

    kept = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    return kept.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, difference double, p double")
