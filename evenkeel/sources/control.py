"""Control state that outlives a plan: versions of the routing table, reports as text, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import route_fields, route_text
from .files import read_lines, write_lines

ROUTES = "key long, task int, count long"


class RouteLog:
    """Versions of a routing table in a folder, one for each epoch; a repeated epoch replaces its own version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, epoch: int, routes: DataFrame) -> None:
        routes.select("key", "task", "count").write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def epochs(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("epoch="))

    def at(self, epoch: int) -> DataFrame:
        """The table that holds in an epoch: the last one published until then, empty before the first."""
        known = [e for e in self.epochs() if e <= epoch]
        return self.spark.read.schema(ROUTES).parquet(f"{self.path}/epoch={known[-1]}") if known else self.spark.createDataFrame([], ROUTES)

    def history(self) -> DataFrame:
        """All versions, with their epoch."""
        return self.spark.read.schema(ROUTES + ", epoch int").parquet(self.path)


def route_lines(routes: DataFrame) -> DataFrame:
    """(key, line) of a routing table as text, entries by count, then task."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("count", "task"))), lambda e: F.struct(e["task"].alias("task"), e["count"].alias("count")))
    return routes.groupBy("key").agg(entries.alias("e")).select("key", route_text(F.col("key"), F.col("e")).alias("line"))


def write_routes(routes: DataFrame, path: str) -> None:
    write_lines(route_lines(routes).select("line"), path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """The routing table of a text report; lines of another form are left out."""
    parsed = read_lines(spark, path).select(route_fields(F.col("line")).alias("r")).where("r is not null")
    return parsed.select("r.key", F.explode("r.entries").alias("e")).select("key", "e.task", "e.count")


def load_lines(hist: DataFrame, load: DataFrame) -> DataFrame:
    """(task, line) of a load report: a node's load, and the count of each of its keys."""
    nodes = load.select("task", F.concat(F.lit("taskIndex = "), F.col("task"), F.lit(" , load = "), F.col("load")).alias("line"))
    return nodes.unionByName(hist.select("task", F.concat(F.lit("key = "), F.col("key"), F.lit(" , count = "), F.col("count")).alias("line")))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The counters that write_metrics appended."""
    return spark.read.schema("epoch int, name string, value double").json(path)
