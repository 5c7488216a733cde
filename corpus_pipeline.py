"""A corpus pipeline: five stages, each an operator of quernal.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of documents, extra ones included,
whatever their names; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm import decontaminate, ngram_join, packing, quality, substring
from quernal.llm.common import keep, table
from quernal.llm.queries import vocabulary


#: Near duplicates share 0.8 of their shingles of five words.
NEAR = ngram_join.Rule(5, 4, 5)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored by the bias alone; repeated rows share
    their fate; without labels of both kinds every document has score 0.5 and stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Texts without a word (null, empty, white space) all stay, as do rows without
    an id in a group without ids; of rows that repeat an id and a text one stays.
    """
    return ngram_join.keep_one(docs, NEAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has too are taken out.

    All rows stay; null texts stay null, a text that loses all words becomes
    empty; rows with equal ids do not cut one another; a null id comes last.
    """
    out = substring.strip(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items hold nothing; repeated rows share their fate.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text is its end id alone; repeated rows are packed one by one.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and byte-pair encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
