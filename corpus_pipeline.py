"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages are meant to be written as Parquet and read again
by the next one; all but the last return the columns of documents, and any others that their input has, unchanged. An empty
table stays empty in every stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from chorale.llm.common import shared_folder, table
from chorale.llm.langid import keep_identified
from chorale.llm.mixing import mix
from chorale.llm.neardup import keep_one
from chorale.llm.packing import pack
from chorale.llm.quality import keep_good


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go: null and empty texts, those without a letter, and those in which no language
    has a posterior of ``langid.LEAST_SCORE`` (0.3). Repeated rows share a fate; ties go to the more frequent language."""
    return keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably bad, by the votes of all rules, go, as do those of fewer than 10 words (null and empty ones
    too) or of over a fifth repeated words. Repeated rows share a fate; a posterior of exactly one half keeps."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row of the smallest id stays (a missing id comes last; of repeated rows one).
    Null texts and those without words have no duplicates and stay."""
    return keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights and shuffled globally. A null source is a source; a null text
    counts as one byte; repeated rows are repeated equally often."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of windows of equal length. A null or empty text is its end id alone; repeated rows are packed
    each."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Language models and windows packed in order aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
