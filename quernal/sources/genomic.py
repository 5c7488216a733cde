"""Readers and writers of interval and variant text formats, normalised to 0-based half-open ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, least: int) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).withColumn("c", F.split("value", "\t")).where(F.size("c") >= least)


def _long(x: Column) -> Column:
    return F.expr("try_cast(0 as bigint)") if x is None else x.try_cast("long")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand, class; missing columns are null."""
    c = lambda i: F.get("c", F.lit(i))
    return _lines(spark, path, 3).select(c(0).alias("chrom"), _long(c(1)).alias("start"), _long(c(2)).alias("end"), c(3).alias("name"), c(4).alias("score"), c(5).alias("strand"), c(6).alias("class")).where("start is not null and end is not null")


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features with their attributes as a map; 1-based inclusive becomes 0-based half-open."""
    c = lambda i: F.get("c", F.lit(i))
    return _lines(spark, path, 9).select(c(0).alias("chrom"), (_long(c(3)) - 1).alias("start"), _long(c(4)).alias("end"), c(2).alias("feature"), c(6).alias("strand"), F.expr("str_to_map(c[8], ';', '=')").alias("attributes")).where("start is not null")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: fixed columns, INFO as a map, and genotype by sample name.

    An empty FILTER is PASS; only the first alternative is typed; the id
    defaults to chrom:pos:type.
    """
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    samples = head["value"].split("\t")[9:] if head else []
    c = lambda i: F.get("c", F.lit(i))
    info = F.expr("str_to_map(c[7], ';', '=')")
    gt = F.transform(F.slice("c", 10, max(1, len(samples))), lambda x: F.get(F.split(x, ":"), F.lit(0)))
    rows = _lines(spark, path, 8).withColumn("info", info)
    kind = F.coalesce(F.try_element_at("info", F.lit("SVTYPE")), F.lit("BND"))
    return rows.select(
        c(0).alias("chrom"), _long(c(1)).alias("pos"), F.coalesce(F.nullif(c(2), F.lit(".")), F.concat_ws(":", c(0), c(1), kind)).alias("id"), c(3).alias("ref"), F.get(F.split(c(4), ","), F.lit(0)).alias("alt"),
        c(5).try_cast("double").alias("qual"), F.when(F.coalesce(c(6), F.lit(".")).isin("", "."), "PASS").otherwise(c(6)).alias("filter"), "info",
        (F.map_from_arrays(F.array(*[F.lit(s) for s in samples]), gt) if samples else F.lit(None).cast("map<string,string>")).alias("genotypes"),
    )


def write_by_chrom(df: DataFrame, path: str) -> None:
    """Parquet partitioned by chrom and sorted by start within files, for pruned range scans."""
    df.repartition("chrom").sortWithinPartitions("chrom", "start").write.partitionBy("chrom").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def pick_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns, each the first of its names that is present; null where none is."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`").alias(k) if (n := next((x for x in names if x in have), None)) else F.lit(None).cast("string").alias(k) for k, names in aliases.items()])
