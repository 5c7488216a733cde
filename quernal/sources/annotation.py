"""Readers of repeat, alignment, likelihood and per-window text formats, FASTA runs and nested JSON layers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File-name endings that settle a format by themselves.
_BY_NAME = {".intact.gff3": "edta_intact", ".teanno.gff3": "edta_anno", ".gff": "gff3", ".gff3": "gff3", ".bed": "bed"}


def _at(i: int) -> Column:
    return F.get("c", F.lit(i))


def _tokens(spark: SparkSession, path: str, pattern: str, least: int) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), pattern).alias("c")).where(F.size("c") >= least)


def repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """One row per hit, 0-based half-open; lines without a leading number or with under 11 columns are left out."""
    hits = _tokens(spark, path, r"\s+", 11).where(_at(0).rlike(r"^[0-9]"))
    kind = F.split(_at(10), "/")
    return hits.select(
        _at(4).alias("chrom"), (_at(5).try_cast("long") - 1).alias("start"), _at(6).try_cast("long").alias("end"), _at(9).alias("name"), _at(0).alias("score"),
        F.when(_at(8) == "+", "+").when(_at(8).isin("C", "-"), "-").otherwise(".").alias("strand"), F.get(kind, F.lit(0)).alias("class"), F.coalesce(F.get(kind, F.lit(1)), F.lit("NA")).alias("family"),
    ).where("start is not null and end is not null")


def paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignment blocks; lines with under 12 columns or a number that is none are left out."""
    rows = _tokens(spark, path, "\t", 12).select(_at(0).alias("query"), _at(4).alias("strand"), _at(5).alias("target"), *[_at(i).try_cast("long").alias(n) for i, n in ((7, "start"), (8, "end"), (9, "matches"), (10, "length"))])
    return rows.dropna(subset=["start", "end", "matches", "length"])


def alignment_classes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per query and target: span, strand (? if mixed) and blocks.  Per query: class by targets and mean identity in percent."""
    strands = F.collect_set(F.when(F.col("strand").isin("+", "-"), F.col("strand")))
    targets = blocks.groupBy("query", "target").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.when(F.size(strands) == 1, F.get(strands, F.lit(0))).otherwise("?").alias("strand"), F.count(F.lit(1)).alias("n_blocks"),
        F.sum(F.when(F.col("length") > 0, F.col("matches") / F.col("length"))).alias("_i"), F.count_if(F.col("length") > 0).alias("_n"),
    )
    n = F.count(F.lit(1))
    whole = targets.groupBy("query").agg(
        F.when(n >= 4, "1-4+").otherwise(F.concat(F.lit("1-"), n.cast("string"))).alias("class"), F.sum("n_blocks").alias("n_blocks"), (100 * F.coalesce(F.try_divide(F.sum("_i"), F.sum("_n")), F.lit(0.0))).alias("identity")
    )
    return targets.drop("_i", "_n"), whole


def marker_position(marker: Column) -> tuple[Column, Column]:
    """Chromosome and position: the last all-digit token is the position, what stands before it the chromosome."""
    m, pattern = F.translate(marker, ":", "_"), r"^(.+)_(\d+)((?:_[^_]*\D[^_]*|_)*)$"
    return F.nullif(F.regexp_extract(m, pattern, 1), F.lit("")), F.regexp_extract(m, pattern, 2).try_cast("long")


def beagle(spark: SparkSession, path: str) -> DataFrame:
    """Marker, chromosome, position, alleles and one (aa, ab, bb) per sample.

    A header whose names do not come in threes is an error, and so is a row
    with another number of columns, when it is read.
    """
    lines = spark.read.text(path)
    first = lines.first()
    head = first["value"].split() if first else []
    names = head[3::3]
    if head and head[3:] != [n for n in names for _ in range(3)]:
        raise ValueError("BEAGLE header: each sample's name must stand three times")
    rows = _tokens(spark, path, r"\s+", 1).where(~_at(0).isin(head[:1]) & (_at(0) != ""))
    c = F.when(F.size("c") == len(head), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("BEAGLE row with a wrong number of columns: "), _at(0))))
    number = lambda i: F.get(F.col("c"), i).try_cast("double")
    triples = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.struct(number(3 * i + 3).alias("aa"), number(3 * i + 4).alias("ab"), number(3 * i + 5).alias("bb"))) if names else F.array().cast("array<struct<aa:double,ab:double,bb:double>>")
    chrom, at = marker_position(_at(0))
    return rows.withColumn("c", c).select(_at(0).alias("marker"), chrom.alias("chrom"), at.alias("pos"), _at(1).alias("allele1"), _at(2).alias("allele2"), triples.alias("likelihoods"))


def window_theta(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """Per-window theta: the pairwise sum (column 5) over the sites (column 14); null without sites.

    The sample is the file's name up to its first dot.
    """
    rows = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("sample"), F.split("value", "\t").alias("c"))
    rows = rows.where((F.size("c") == 14) & ~_at(0).startswith("#"))
    sites = _at(13).try_cast("long")
    return rows.select("sample", _at(1).alias("chrom"), _at(2).try_cast("long").alias("center"), F.when(sites > 0, _at(4).try_cast("double") / sites).alias("theta"), sites.alias("n_sites")).where(F.col("n_sites") >= least)


def chrom_lengths(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns of a FASTA index."""
    return _tokens(spark, path, "\t", 2).select(_at(0).alias("chrom"), _at(1).try_cast("long").alias("length"))


def share_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a headerless float matrix, in order of the file; a row with a token that is no number is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("values"))
    return rows


def sniff_format(spark: SparkSession, path: str) -> str:
    """By name, else by the first lines: edta_intact, edta_anno, repeatmasker_out, gff3, bed or unknown."""
    name = path.lower().removesuffix(".gz")
    for ending, kind in _BY_NAME.items():
        if name.endswith(ending):
            return kind
    if not name.endswith(".out"):
        return "unknown"
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect()).lower()
    return "repeatmasker_out" if re.search(r"sw\s+perc|score\s+div", head) or ("left" in head and "matching" in head) else "unknown"


def sequence_runs(bases: DataFrame, chrom: str = "chrom", at: str = "offset", text: str = "bases") -> DataFrame:
    """Runs of hard-masked (N), soft-masked (lower case) and plain bases, 0-based half-open.

    `bases` holds sequence lines with their offsets.  Each line is cut into its
    own runs first; only those are ordered to join runs across lines.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([Nn]+|[acgt]+|[ACGT]+|[^NnacgtACGT]+)"), F.lit(1))
    p = bases.select(chrom, at, F.posexplode(pieces).alias("i", "piece"), pieces.alias("_all"))
    before = F.aggregate(F.slice("_all", 1, F.col("i")), F.lit(0), lambda s, x: s + F.length(x))
    first = F.substring("piece", 1, 1)
    p = p.select(F.col(chrom).alias("chrom"), (F.col(at) + before).alias("start"), F.length("piece").alias("n"), F.when(first.rlike("[Nn]"), "hard").when(first.rlike("[acgt]"), "soft").when(first.rlike("[ACGT]"), "plain").otherwise("other").alias("kind"))
    p = p.withColumn("end", F.col("start") + F.col("n"))
    order = Window.partitionBy("chrom").orderBy("start")
    new = ~((F.lag("kind").over(order) == F.col("kind")) & (F.lag("end").over(order) == F.col("start")))
    p = p.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return p.groupBy("chrom", "_run", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end", "kind")


def write_layers(df: DataFrame, path: str, keys: list[str], version: str) -> None:
    """One JSON object a line: the keys, the format's version and the other columns as payload; one folder for each first key.

    A version that does not read name_vN is refused.
    """
    if not re.fullmatch(r"[a-z][a-z0-9_]*_v\d+", version):
        raise ValueError(f"unknown format_version: {version}")
    rest = [F.col(c) for c in df.columns if c not in keys]
    folder = F.col(keys[0]).cast("string").alias(f"{keys[0]}_folder")
    df.select(folder, *keys, F.lit(version).alias("format_version"), F.struct(*rest).alias("payload")).write.partitionBy(f"{keys[0]}_folder").json(path)


def read_layers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects as `schema` reads them; a line that is no JSON gives a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
