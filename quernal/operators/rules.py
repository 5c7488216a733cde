"""Ordered rules: the first condition that holds gives the label; a null condition fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F
    for condition, label in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose lower bound the value reaches (steps descend)."""
    return first_match([(value >= bound, label) for bound, label in steps], otherwise)


def below(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose upper bound the value does not pass (steps ascend)."""
    return first_match([(value <= bound, label) for bound, label in steps], otherwise)


def only_if_present(value: Column, condition: Column) -> Column:
    """A condition that a missing value passes."""
    return value.isNull() | condition


def genotype_class(gt: Column) -> Column:
    """Any missing allele OTHER; one distinct allele HOM_REF if 0, else HOM_VAR; more HET."""
    alleles = F.array_distinct(F.split(gt, r"[/|]"))
    return first_match(
        [
            (gt.isNull() | F.array_contains(alleles, "."), "OTHER"),
            ((F.size(alleles) == 1) & (alleles[0] == "0"), "HOM_REF"),
            (F.size(alleles) == 1, "HOM_VAR"),
        ],
        "HET",
    )


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return first_match([((r == 1) & (a == 1), "SNP"), (a > r, "INS"), (a < r, "DEL")], "OTHER")


def capped_gate(current: Column, evidence: list[tuple[Column, str]], order: list[str], demote: Column) -> Column:
    """Demotion first; else the highest of the current level and the evidence's levels."""
    rank = F.create_map(*[x for i, level in enumerate(order) for x in (F.lit(level), F.lit(i))])
    best = F.greatest(F.coalesce(F.try_element_at(rank, current), F.lit(0)), *[F.when(F.coalesce(c, F.lit(False)), F.lit(order.index(level))).otherwise(0) for c, level in evidence])
    return F.when(F.coalesce(demote, F.lit(False)), F.lit("SUSPECT")).otherwise(F.element_at(F.array(*[F.lit(x) for x in order]), (best + 1).cast("int")))
