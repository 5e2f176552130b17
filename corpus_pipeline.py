"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
documents.  SQL can express no stage of this pipeline, so that ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm._common import scratch_path
from evenkeel.llm.language_id import language_stage
from evenkeel.llm.ngram_join import near_duplicate_stage
from evenkeel.llm.packing import pack
from evenkeel.llm.quality_rules import quality_stage
from evenkeel.llm.substring_dedup import substring_dedup_stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no learned language with a probability of at least one half."""
    return language_stage(docs).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base limits or a rule learned from labels."""
    return quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near_duplicate_stage(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words that occur elsewhere; documents of which nothing is left go."""
    return substring_dedup_stage(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left, by their digests."""
    out = pack(docs)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset"), "bucket", "batch_id")


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
