"""The joins and statistics on Structured Streaming sources.

A micro-batch boundary is what suspends intake and flushes buffers; state is kept for the whole history unless a
watermark is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import band_join
from ..operators.stats import histogram
from ..plans.prefix_sum import plan_moves, route_table
from ..session import scratch, written
from ..sources.control import RouteLog
from ..sources.files import last_by_key


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of a folder as a stream of its files, with the schema of the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the rows that it wrote to the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:  # the last complete result replaces those before it

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_equi_join(r: DataFrame, s: DataFrame, on: list[str]) -> DataFrame:
    """Symmetric join of two streams on equal keys."""
    return r.join(s, on, "inner")


def stream_band_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, width: int) -> DataFrame:
    """The bucketed band join, which streams accept since it joins by equality of buckets."""
    return band_join(r, s, r_key, s_key, width)


def stream_load(rows: DataFrame) -> DataFrame:
    """Running load of each node."""
    return rows.groupBy("task").agg(F.count("*").alias("load"))


def stream_key_sides(rows: DataFrame) -> DataFrame:
    """Rows of each key (key, side) on either side, kept as state for the whole history; a key is told anew with each batch that has it.

    Counts are summed before they are shuffled, so that a common key is a row for each task of a batch."""
    n_r = F.count_if(F.col("side") == "R")
    return rows.groupBy("key").agg(n_r.alias("n_r"), (F.count("*") - n_r).alias("n_s"))


def drain_updates(stream: DataFrame, name: str, key: str) -> DataFrame:
    """Run a stream of updates over what is there and return the last row of each key."""
    spark = stream.sparkSession
    out = scratch(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return last_by_key(spark.read.schema(stream.schema.add("batch", "long")).parquet(out), key, F.col("batch")).drop("batch")


def rebalance_each_batch(rows: DataFrame, nodes: int, rule: str, log: RouteLog, seconds: float | None = None) -> StreamingQuery:
    """A controller on a tick: each micro-batch of rows (task, key) adds its histogram to those before, a plan is made of all of
    them, and its routing table is published as the next epoch.  With seconds, ticks come that often until the query is
    stopped by its caller; without, what is there is worked off.
    """
    spark = rows.sparkSession
    parts = scratch(spark, "histograms")

    def tick(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces its own part and epoch
        histogram(batch).write.mode("overwrite").parquet(f"{parts}/batch={number}")
        hist = written(spark.read.schema("task int, key long, count long").parquet(parts).groupBy("task", "key").agg(F.sum("count").alias("count")), "histogram")
        log.publish(number + 1, route_table(hist, written(plan_moves(hist, nodes, rule), "plan")))

    out = rows.writeStream.foreachBatch(tick).option("checkpointLocation", scratch(spark, "controller"))
    query = out.trigger(availableNow=True).start() if seconds is None else out.trigger(processingTime=f"{seconds} seconds").start()
    if seconds is None:
        query.awaitTermination()
    return query
