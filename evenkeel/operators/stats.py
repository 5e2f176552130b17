"""Load statistics of nodes and keys, bounds and overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THETA = 0.01
BAND_THETA = 0.1


def histogram(rows: DataFrame) -> DataFrame:
    """Rows of each (task, key): task int, key long, count long."""
    return rows.groupBy("task", "key").agg(F.count("*").alias("count"))


def node_load(hist: DataFrame, nodes: int) -> DataFrame:
    """Load of each node, those without rows too."""
    every = hist.sparkSession.range(nodes).select(F.col("id").cast("int").alias("task"))
    per = hist.groupBy("task").agg(F.sum("count").alias("load"))
    return every.join(per, "task", "left").select("task", F.coalesce("load", F.lit(0)).cast("long").alias("load"))


def key_side_load(rows: DataFrame) -> DataFrame:
    """Rows of each key on either side."""
    return rows.groupBy("key").agg(F.count_if(F.col("side") == "R").alias("n_r"), F.count_if(F.col("side") == "S").alias("n_s"))


def bounds(load: DataFrame, nodes: int) -> DataFrame:
    """One row: total, bl (the whole mean plus one) and ul, above which a node is overloaded."""
    one = load.agg(F.sum("load").alias("total"))
    bl = (F.floor(F.col("total") / nodes) + 1).cast("long")
    return one.select("total", bl.alias("bl")).withColumn("ul", F.floor(F.col("bl") * (1 + THETA) + 1).cast("long"))


def quick_bounds(load: DataFrame, nodes: int) -> DataFrame:
    """One row with the bounds of the quick planner (bl, ul) and of the band planner (band_bl)."""
    one = load.agg(F.sum("load").alias("total"))
    bl = F.floor(F.col("total") / nodes).cast("long")
    return one.select(
        "total", bl.alias("bl"), F.floor(bl * (1 + THETA)).cast("long").alias("ul"), (F.col("total") / nodes * (1 + BAND_THETA)).alias("band_bl")
    )


def limits(load: DataFrame, nodes: int, rule: str = "") -> DataFrame:
    """One row with target, to which a planner brings nodes, and trigger, above which they are overloaded.

    ``quick`` takes the whole mean, ``band`` a tenth above it as both, the others the whole mean plus one."""
    if rule in ("quick", "band"):
        one = quick_bounds(load, nodes)
        if rule == "quick":
            return one.select(F.col("bl").alias("target"), F.col("ul").cast("double").alias("trigger"))
        return one.select(F.floor("band_bl").cast("long").alias("target"), F.col("band_bl").alias("trigger"))
    return bounds(load, nodes).select(F.col("bl").alias("target"), F.col("ul").cast("double").alias("trigger"))


def overloaded(load: DataFrame, nodes: int) -> DataFrame:
    """Nodes above ul with what they hold above bl."""
    return load.crossJoin(bounds(load, nodes)).where("load > ul").select("task", "load", (F.col("load") - F.col("bl")).alias("excess"))


def migrate_volume(load: DataFrame, nodes: int) -> DataFrame:
    """Rows above the band planner's bound, over all nodes above it."""
    over = load.crossJoin(quick_bounds(load, nodes)).where("load > band_bl")
    return over.agg(F.coalesce(F.sum(F.floor(F.col("load") - F.col("band_bl"))), F.lit(0)).cast("long").alias("migrate_count"))


def route_table_size(routes: DataFrame) -> DataFrame:
    """Bytes of a routing table: three integers for the first entry of a key, two for each further one."""
    per = routes.groupBy("key").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(4 * (3 + 2 * (F.col("n") - 1))), F.lit(0)).cast("long").alias("bytes"))


def utility_rank(hist: DataFrame) -> DataFrame:
    """Keys of a node by rows moved for each row of load."""
    total = hist.groupBy("key").agg(F.sum("count").alias("load"), F.max("count").alias("mc"))
    return total.select("key", "mc", "load", (F.col("mc") / F.col("load")).alias("utility"))
