"""Readers of call tables, repeats, keys and manifests, and writers that replace or extend files safely."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import info_map, sample_map
from ..operators.rules import genotype_class, variant_type
from .genomic import _lines, _long, pick_columns, vcf

# Accepted names of each column.
SV_COLUMNS = {"sv_id": ["sv_id", "id", "ID"], "chrom": ["chrom", "CHROM", "chr"], "position_bp": ["position_bp", "pos", "POS", "start"], "end_bp": ["end_bp", "end", "END"], "sv_type": ["sv_type", "SVTYPE", "type"], "sample_id": ["sample_id", "sample"], "GT": ["GT", "gt", "genotype"], "quality": ["quality", "QUAL"], "callers": ["callers", "caller"]}
KARYOTYPES = {"HOMO_1": "H1/H1", "HET": "H1/H2", "HOMO_2": "H2/H2"}
MISSING = ("", "NA", "nan", ".")


def _at(i: int):
    return F.get("c", F.lit(i))


def variants(spark: SparkSession, path: str) -> DataFrame:
    """One row per record and sample: fixed fields, INFO flags and values, and typed GT, GQ, DP, AD and PL.

    END is INFO's, else the reference's last base.  Missing fields are null.
    """
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    samples = head["value"].split("\t")[9:] if head else []
    rows = _lines(spark, path, 8).withColumn("info", info_map(_at(7)))
    alts = F.split(_at(4), ",")
    rows = rows.select(
        _at(0).alias("chrom"), _long(_at(1)).alias("pos"), _at(3).alias("ref"), F.get(alts, F.lit(0)).alias("alt"), alts.alias("alts"), F.size(alts).alias("n_alt"), _at(5).try_cast("double").alias("qual"), F.when(F.coalesce(_at(6), F.lit(".")).isin("", "."), "PASS").otherwise(_at(6)).alias("filter"), "info", "c",
    )
    rows = rows.withColumns({"end": F.coalesce(_long(F.try_element_at("info", F.lit("END"))), F.col("pos") + F.length("ref") - 1), "var_type": variant_type(F.col("ref"), F.col("alt")), "indel_len": F.length("alt") - F.length("ref")})
    if samples:
        calls = F.array(*[F.struct(F.lit(s).alias("sample"), sample_map(_at(8), _at(9 + i)).alias("f")) for i, s in enumerate(samples)])
        rows = rows.select("*", F.inline(calls))
    else:
        rows = rows.withColumns({"sample": F.lit(None).cast("string"), "f": F.lit(None).cast("map<string,string>")})
    value = lambda k: F.try_element_at("f", F.lit(k))
    ints = lambda k: F.transform(F.split(value(k), ","), lambda x: x.try_cast("int"))
    rows = rows.withColumns({"gt": value("GT"), "gq": value("GQ").try_cast("double"), "dp": value("DP").try_cast("int"), "ad": ints("AD"), "pl": ints("PL")})
    ad_sum = F.aggregate(F.array_compact("ad"), F.lit(0), lambda a, x: a + x)
    return rows.withColumns({"gt_class": genotype_class(F.col("gt")), "ad_ref": F.get("ad", F.lit(0)), "ad_alt": F.get("ad", F.lit(1)), "ad_sum": ad_sum, "af": F.try_divide(F.get("ad", F.lit(1)), ad_sum)}).drop("c", "f")


def sv_calls(spark: SparkSession, path: str) -> DataFrame:
    """Long table of calls with canonical column names; positions as numbers."""
    out = pick_columns(spark.read.option("sep", "\t").option("header", True).csv(path), SV_COLUMNS)
    return out.withColumns({"position_bp": _long(F.col("position_bp")), "end_bp": _long(F.col("end_bp"))})


def karyotypes(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and its group; rows with other labels are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select("sample_id", F.try_element_at(F.create_map(*[F.lit(x) for kv in KARYOTYPES.items() for x in kv]), F.upper(F.trim("label"))).alias("grp")).where("grp is not null")


def tandem_repeats(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, period, copies and motif of a tandem repeat finder's .dat (named by `Sequence:` lines) or of a table with a header.

    A .dat file is read whole by one task, as its rows belong to the name above them.
    """

    def parse(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for text in batch["value"]:
                chrom = None
                for line in text.splitlines():
                    if line.startswith("Sequence:"):
                        chrom = line.split()[1]
                    elif line[:1].isdigit() and len(p := line.split()) >= 14:
                        out.append((chrom, int(p[0]) - 1, int(p[1]), int(float(p[2])), float(p[3]), p[13]))
            yield pd.DataFrame(out, columns=["chrom", "start", "end", "period", "copies", "motif"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "chrom string, start long, end long, period int, copies double, motif string")


def duplications(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of segmental duplications (BEDPE columns): both copies, strands, identity in percent, length."""
    rows = _lines(spark, path, 10)
    return rows.select(
        _at(0).alias("chr1"), _long(_at(1)).alias("start1"), _long(_at(2)).alias("end1"), _at(3).alias("chr2"), _long(_at(4)).alias("start2"), _long(_at(5)).alias("end2"), _at(8).alias("strand1"), _at(9).alias("strand2"), (100 - _at(7).try_cast("double")).alias("identity"), (_long(_at(2)) - _long(_at(1))).alias("length"), (_at(8) != _at(9)).alias("inverted"),
    ).where("start1 is not null and start2 is not null")


def bed_spans(spark: SparkSession, path: str) -> DataFrame:
    """Per chromosome of a BED file: ranges, first start, last end."""
    from .genomic import bed

    return bed(spark, path).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


def flat_keys(spark: SparkSession, path: str) -> DataFrame:
    """candidate_id (the file's name), key, value and line of `key<TAB>value` files; missing values are null, a repeated key's later lines stay."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumn("c", F.split("value", "\t")).where((F.size("c") >= 2) & ~F.col("value").startswith("#"))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1)
    return rows.select(name.alias("candidate_id"), F.trim(_at(0)).alias("key"), F.when(~F.trim(_at(1)).isin(*MISSING), F.trim(_at(1))).alias("value"), "line")


def first_present(tiers: list[DataFrame]) -> DataFrame:
    """Keys of candidates from tables in order of preference: each candidate's from the first table that has it."""
    out = None
    for k, t in enumerate(tiers):
        rows = t.select("candidate_id", "key", "value").withColumn("tier", F.lit(k))
        out = rows if out is None else out.unionByName(rows.join(out.select("candidate_id").distinct(), "candidate_id", "left_anti"))
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a registry's manifest (JSON lines or one JSON array)."""
    return spark.read.option("multiLine", True).json(path)


def translated(df: DataFrame, column: str, names: DataFrame, source: str, target: str) -> DataFrame:
    """Ids replaced by their other name where there is one."""
    to = names.select(F.col(source).alias("_from"), F.col(target).alias("_to")).dropDuplicates(["_from"])
    return df.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


# Writers.


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json_atomic(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small JSON file: written under another name, then renamed."""
    fs, target = _fs(spark, path)
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OSError(f"cannot replace {path}")


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a folder of gzip TSV files, each with one header line; the columns must be those already there."""
    fs, target = _fs(df.sparkSession, path)
    if fs.exists(target):
        have = df.sparkSession.read.option("sep", "\t").option("header", True).csv(path).columns
        if have != df.columns:
            raise ValueError(f"columns {df.columns} are not {have}")
    df.write.mode("append").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def write_store(df: DataFrame, path: str, hot: list[str], buckets_bp: int = 1_000_000) -> None:
    """Two tables by chrom: `sites` (chrom, pos, id and the hot columns) and `dosage` (all samples), sorted by position.

    Rows are dealt by chrom and position bucket, so a chromosome is many tasks and files.
    """
    dealt = df.withColumn("_bucket", F.floor(F.col("pos") / buckets_bp)).repartition("chrom", "_bucket").sortWithinPartitions("chrom", "pos").drop("_bucket")
    cold = [c for c in df.columns if c not in hot]
    dealt.select("chrom", "pos", "id", *hot).write.partitionBy("chrom").parquet(f"{path}/sites")
    dealt.select(*cold).write.partitionBy("chrom").parquet(f"{path}/dosage")


def read_range(spark: SparkSession, path: str, table: str, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of a store's table in a closed range; partition and row-group filters reach the scan."""
    return spark.read.parquet(f"{path}/{table}").where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def at_positions(spark: SparkSession, path: str, chrom: str, positions: DataFrame) -> DataFrame:
    """Dosages of the given positions (pos) of a chromosome."""
    return spark.read.parquet(f"{path}/dosage").where(F.col("chrom") == chrom).join(positions.select("pos").distinct(), "pos", "left_semi")


def pair_triangle(pairs: DataFrame, n: int) -> DataFrame:
    """Rows of the upper triangle as bytes: r2 times 255, rounded, 0 where missing; row i holds the pairs (i, i+1) to (i, n-1)."""
    level = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r2", F.lit(0.0)))) * 255).cast("int")
    rows = pairs.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", level.alias("v")))).alias("m"))
    spine = pairs.sparkSession.range(n - 1).select(F.col("id").cast("int").alias("i"))
    text = F.array_join(F.transform(F.sequence(F.col("i") + 1, F.lit(n - 1)), lambda j: F.lpad(F.hex(F.coalesce(F.try_element_at("m", j), F.lit(0))), 2, "0")), "")
    return spine.join(rows, "i", "left").select("i", F.unhex(text).alias("row")).orderBy("i")
