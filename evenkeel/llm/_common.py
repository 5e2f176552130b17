"""Helpers that the training-data operators share: shared scratch tables, words and hashing."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import delete, scratch

#: Words are maximal runs of other bytes than space and \x09-\x0D, which is how bytes.split() cuts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_TABLES: list[str] = []


def _forget(spark: SparkSession) -> None:
    try:
        while _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    except Exception:  # the session is gone, and its catalog with it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return scratch(spark, name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, written: DataFrame) -> None:
    """Delete the files of a table from materialise() that nothing will read again."""
    for name in written.inputFiles():
        delete(spark, name)


def _table_name(spark: SparkSession, name: str) -> str:
    if not _TABLES:
        atexit.register(_forget, spark)
    _TABLES.append(f"evenkeel_{name}_{uuid.uuid4().hex[:12]}")
    return _TABLES[-1]


def write_bucketed(df: DataFrame, path: str, name: str, buckets: int, *keys: str) -> str:
    """Write a table whose rows of a key are in one bucket, sorted: later joins and groupings by it need no exchange.

    The session's catalog has to name such a table; the name goes when the session ends or drop_table is called."""
    table = _table_name(df.sparkSession, name)
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return table


def open_bucketed(spark: SparkSession, path: str, name: str, ddl: str, buckets: int, key: str) -> str:
    """Name a table that write_bucketed() left in a folder, in this session too."""
    table = _table_name(spark, name)
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return table


def drop_table(spark: SparkSession, table: str) -> None:
    """Take the name of a bucketed table out of the session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    _TABLES.remove(table)


def materialise_bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """As materialise, but bucketed by keys."""
    return df.sparkSession.table(write_bucketed(df, scratch_path(df.sparkSession, name), name, buckets, *keys))


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows in a record batch, where whole texts travel, for the jobs that run inside."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for the binary formats that executors write to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def quoted(name: str) -> str:
    """A column name that may hold any character, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame):
    """All columns of a table as one struct, so that no helper column can clash with theirs."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def text_bytes(col: str = "text"):
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(col).cast("string").cast("binary")


class WordHasher(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of `width` words, in order; empty if there are fewer words."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    b = np.uint64(base)
    for k in range(width):
        out *= b
        out += word_hashes[k : k + n]
    return mix(out)


def own_exchange(col: str):
    """An integer key under another value: a join by it exchanges both sides anew, whatever they are bucketed or summed by, so that
    adaptive execution can split hot keys."""
    return F.col(col).bitwiseXOR(F.lit(1 << 40))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph (u bigint, v bigint): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps.  A hub's smallest neighbour is joined back by a key of its own, in an
    exchange that adaptive execution can split.  Every round is written to the shared folder.  Self loops keep a node.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, name)
    before = None
    hub = own_exchange("u")
    while True:  # some log of the longest chain, squared
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(hub.alias("hub"), F.least("u", "m").alias("m"))
        large = both.where("v > u").withColumn("hub", hub).join(low, "hub").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.withColumn("hub", hub).join(low.select(hub.alias("hub"), "m"), "hub").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first())
        if now == before:
            break
        before = now
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("root")), nodes["node"] == F.col("u"), "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
