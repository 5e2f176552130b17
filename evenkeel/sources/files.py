"""Text sources and sinks, and generated skew."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fields, owner, parse_pipe


def read_pipe(spark: SparkSession, path: str, ddl: str, most: int | None = None, until_blank: bool = False) -> DataFrame:
    """A pipe-separated table without a header; `most` caps what is loaded where the caller asks for it.

    Blank lines are left out; with until_blank, so is all that follows the first one in the order of the files' lines."""
    lines = spark.read.text(path)
    blank = F.length(F.trim("value")) == 0
    if until_blank:
        lines = lines.withColumn("_n", F.monotonically_increasing_id())
        first = lines.where(blank).agg(F.min("_n").alias("_end"))
        lines = lines.crossJoin(F.broadcast(first)).where("_end is null or _n < _end").drop("_n", "_end")  # one row
    rows = parse_pipe(lines.where(~blank), ddl)
    return rows if most is None else rows.limit(most)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where(F.length("line") > 0)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """The fields of each line."""
    return read_lines(spark, path).select(fields(F.col("line")).alias("fields"))


def last_by_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key by an order without ties, whole."""
    names = rows.columns
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*names), order).alias("_r")).select("_r.*")


def read_key_histogram(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    """(task, key, count) of a file with one integer a line, by hash owners."""
    keys = read_lines(spark, path).select(F.col("line").cast("long").alias("key"))
    return keys.groupBy(owner(F.col("key"), nodes).alias("task"), "key").agg(F.count("*").alias("count"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str, append: bool = True) -> None:
    """Counters and plans as JSON lines, one file set for each write."""
    df.write.mode("append" if append else "overwrite").json(path)


def zipf_counts(spark: SparkSession, keys: int = 150, rows: int = 480_000, skew: float = 0.5) -> DataFrame:
    """(rank, count): the whole part of each rank's share."""
    total = sum(1 / i**skew for i in range(1, keys + 1))
    share = F.lit(1.0) / F.pow(F.col("rank").cast("double"), F.lit(float(skew))) / F.lit(total)
    return spark.range(1, keys + 1).select(F.col("id").alias("rank")).withColumn("count", F.floor(share * rows).cast("long"))


def zipf_keys(spark: SparkSession, keys: int = 150, rows: int = 480_000, skew: float = 0.5, seed: int = 1) -> DataFrame:
    """Rows of key, shuffled; which key has which rank is drawn by the seed."""
    ranks = list(range(1, keys + 1))
    random.Random(seed).shuffle(ranks)
    names = spark.createDataFrame([(r, k) for k, r in enumerate(ranks)], "rank long, key long")
    per = zipf_counts(spark, keys, rows, skew).join(F.broadcast(names), "rank")  # as many rows as keys
    return per.select("key", F.explode(F.sequence(F.lit(1), F.col("count")))).select("key").orderBy(F.rand(seed))
