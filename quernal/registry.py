"""All registered queries of the core library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import comparison_queries, interval_queries, kernel_queries, matching_queries, relational_queries, rule_queries, sequence_queries, statistic_queries, summary_queries

QUERIES: dict = interval_queries.QUERIES | relational_queries.QUERIES | kernel_queries.QUERIES | statistic_queries.QUERIES | comparison_queries.QUERIES | rule_queries.QUERIES | summary_queries.QUERIES | matching_queries.QUERIES | sequence_queries.QUERIES
ORACLE_SQL: dict[str, str] = interval_queries.ORACLE_SQL | relational_queries.ORACLE_SQL | kernel_queries.ORACLE_SQL | statistic_queries.ORACLE_SQL | comparison_queries.ORACLE_SQL | rule_queries.ORACLE_SQL | summary_queries.ORACLE_SQL | matching_queries.ORACLE_SQL | sequence_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class for every supplier, in a fixed order."""
    return relational_queries.genotype_class_counts(spark, sf_dir).orderBy("l_suppkey")
