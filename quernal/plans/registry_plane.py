"""A small registry of groups and results with a composable question method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ResultRegistry:
    """Manifest rows (kind, chrom, group_1, group_2, stat) over groups (group_id, sample_id)."""

    def __init__(self, manifest: DataFrame, groups: DataFrame):
        self.manifest, self.groups = manifest, groups

    def ask(self, where: str | None = None, who: str | None = None, what: str | None = None, kind: str | None = None) -> DataFrame:
        """All given conditions hold; `who` may stand on either side."""
        out = self.manifest
        for column, value in (("chrom", where), ("stat", what), ("kind", kind)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out if who is None else out.where((F.col("group_1") == who) | (F.col("group_2") == who))

    def unknown_groups(self, rows: DataFrame) -> DataFrame:
        """Group names in new rows that no group has."""
        named = rows.select(F.explode(F.array("group_1", "group_2")).alias("group_id")).where("group_id is not null").distinct()
        return named.join(self.groups.select("group_id"), "group_id", "left_anti")

    def append(self, rows: DataFrame) -> ResultRegistry:
        bad = self.unknown_groups(rows).limit(5).collect()
        if bad:
            raise ValueError(f"unknown groups: {', '.join(r['group_id'] for r in bad)}")
        return ResultRegistry(self.manifest.unionByName(rows, allowMissingColumns=True), self.groups)

    def overlap(self, a: str, b: str) -> DataFrame:
        """Sizes of two groups, of what they share, and their Jaccard similarity."""
        s = self.groups.where(F.col("group_id").isin(a, b)).groupBy("sample_id").agg(F.max((F.col("group_id") == a).cast("int")).alias("a"), F.max((F.col("group_id") == b).cast("int")).alias("b"))
        n = s.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("shared"), F.count(F.lit(1)).alias("either"))
        return n.withColumn("jaccard", F.try_divide("shared", "either"))
