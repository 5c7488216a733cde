"""Scalar helpers with the guards that the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-9, a / b)


def safe_log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1", "yes"), F.lit(False))


def dosage(ab: Column, bb: Column, aa: Column | None = None) -> Column:
    """Expected copies; with `aa`, divided by the sum of the three where that is over 1e-15."""
    d = ab + 2 * bb
    return d if aa is None else F.when(aa + ab + bb > 1e-15, d / (aa + ab + bb))


def hudson_terms(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column]:
    """Bias-corrected numerator and denominator; divide after summing."""
    num = (p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)
    return num, p1 * (1 - p2) + p2 * (1 - p1)


def terms(x: Column, separator: str = ";") -> Column:
    """Trimmed, non-empty, distinct terms."""
    return F.array_distinct(F.filter(F.transform(F.split(x, separator), lambda t: F.trim(t)), lambda t: t != ""))


def microhomology(left: Column, right: Column, most: int) -> Column:
    """Longest i <= most for which the last i characters of left are the first i of right."""
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: (i == 0) | ((F.length(left) >= i) & (F.length(right) >= i) & (F.substr(left, F.length(left) - i + 1, i) == F.substr(right, F.lit(1), i))))), F.lit(0))
