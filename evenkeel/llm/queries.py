"""Queries over the whole tables for the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses
from .ann import nearest_neighbours
from .byte_bpe import bpe_digest
from .language_id import held_out, identify, train_on
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .quality_rules import fit, quality_rules
from .substring_dedup import substring_dedup, substring_digest
from .token_store import token_store_round_trip
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of all documents: five-word n-grams, similarity 0.8 or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by byte-level BPE."""
    return bpe_digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the learned rules on all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a content-addressed token store and read back."""
    return token_store_round_trip(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences by power-of-two decomposition."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 35-word passages that occur elsewhere."""
    return substring_digest(substring_dedup(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(marked, train_on(docs), keep=("doc_id", "held_out"))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50, among all rows."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_byte_bpe, op3_quality_rules, op4_warc, op5_token_store, op6_packing, op7_license_scan,
        op8_substring_dedup, op9_language_id, op10_learned_partitions, pipeline,
    )
}

ORACLES: dict[str, str] = {"op7_license_scan": licenses.oracle()}
