"""Carrying out a migration plan: which rows of each side move, and to which node."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .joins import running_sum


def side_counts(rows: DataFrame) -> DataFrame:
    """Rows of either side of each (from_task, key)."""
    return rows.groupBy(F.col("task").alias("from_task"), "key").agg(F.count_if(F.col("side") == "R").alias("n_r"), F.count_if(F.col("side") == "S").alias("n_s"))


def quotas(sides: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of either side that leave each (from_task, key): quota_r, quota_s, from the table of side_counts.

    A side with less than half of what moves goes whole; otherwise the larger side gives one more than half, as far
    as it can, and the other the rest.
    """
    out = plan.groupBy("from_task", "key").agg(F.sum("count").alias("count"))
    met = out.join(sides, ["from_task", "key"])
    half = F.floor(F.col("count") / 2)
    small, large = F.least("n_r", "n_s"), F.greatest("n_r", "n_s")
    more = F.least(large, half + 1)
    large_q = F.when(small < half, F.col("count") - small).otherwise(F.greatest(more, F.col("count") - small))
    r_large = F.col("n_r") >= F.col("n_s")
    return met.select(
        "from_task", "key", "count", "n_r", "n_s",
        F.when(r_large, large_q).otherwise(F.col("count") - large_q).cast("long").alias("quota_r"),
        F.when(r_large, F.col("count") - large_q).otherwise(large_q).cast("long").alias("quota_s"),
    )


def migrate(rows: DataFrame, plan: DataFrame, order: list[str], newest: bool = False, size: int = 1024) -> DataFrame:
    """Rows (task, key, side, ...) with task replaced and from_task added where they move; oldest first by `order`, or newest.

    The first column of the order is an integer.  Rows of a key that moves are counted in buckets of `size` of its values, and
    the counts, few against the rows, are summed; a row's place is that sum and its place in the bucket, so that
    no task sorts all rows of a hot key.
    """
    at = F.floor(F.col(order[0]) / size)
    hot = plan.select(F.col("from_task").alias("task"), "key").distinct()
    moving = rows.join(hot, ["task", "key"], "left_semi").withColumn("_b", -at if newest else at)
    total = written(moving.groupBy("task", "key", "side", "_b").agg(F.count("*").alias("n")), "moving")
    before = Window.partitionBy("task", "key", "side").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("task", "key", "side", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    n = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0))
    q = quotas(total.groupBy(F.col("task").alias("from_task"), "key").agg(n("R").alias("n_r"), n("S").alias("n_s")), plan)
    to = Window.partitionBy("from_task", "key").orderBy("to_task").rowsBetween(Window.unboundedPreceding, 0)
    targets = plan.withColumn("hi", F.sum("count").over(to)).groupBy("from_task", "key").agg(F.sort_array(F.collect_list(F.struct("hi", "to_task"))).alias("targets"))
    asked = q.join(targets, ["from_task", "key"]).select(F.col("from_task").alias("task"), "key", "quota_r", "quota_s", "targets")
    asked = written(base.join(asked, ["task", "key"]), "asked")
    by = [F.col(c).desc() for c in order] if newest else order
    rank = F.row_number().over(Window.partitionBy("task", "key", "side", "_b").orderBy(*by)) + F.col("_base")
    moving = moving.join(asked, ["task", "key", "side", "_b"]).withColumn("_n", rank)
    place = F.when(F.col("side") == "R", F.when(F.col("_n") <= F.col("quota_r"), F.col("_n") - 1)).otherwise(
        F.when(F.col("_n") <= F.col("quota_s"), F.col("quota_r") + F.col("_n") - 1)
    )
    target = F.get(F.filter("targets", lambda t: F.col("_p") < t["hi"]), F.lit(0))["to_task"]
    moving = moving.withColumn("_p", place).withColumn("from_task", F.col("task")).withColumn("task", F.coalesce(target, F.col("task")))
    stay = rows.join(hot, ["task", "key"], "left_anti").withColumn("from_task", F.col("task"))
    return stay.unionByName(moving.select(*stay.columns))


def pairs_after(moved: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs of each key once rows lie where the plan brought them: R of each node meets S, which is sent to every node that
    the routing table names for the key, or to the key's only node."""
    here = written(side_counts(moved), "held").withColumnRenamed("from_task", "task")
    total = here.groupBy("key").agg(F.sum("n_s").alias("s_rows"))
    held = here.join(routes.select("key", "task", F.lit(True).alias("named")), ["key", "task"], "left").join(routes.select("key").distinct().withColumn("split", F.lit(True)), "key", "left")
    met = held.where("named or split is null").join(total, "key")
    return met.groupBy("key").agg(F.sum(F.col("n_r") * F.col("s_rows")).alias("n_pairs")).where("n_pairs > 0")


def upsert(base: DataFrame, tagged: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a node has after a migration: its own rows, those that were sent and those that came meanwhile; the last wins for each id."""
    parts = [part.select(F.col(key).alias("_k"), F.lit(n).alias("_n"), F.struct(*base.columns).alias("_r")) for n, part in enumerate((base, tagged, new))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("_k").agg(F.max_by("_r", "_n").alias("_r")).select("_r.*")


def position_slice(rows: DataFrame, id_col: str, total: int, begin: float, end: float) -> DataFrame:
    """Rows whose place by a unique integer id lies in [floor(begin * total), floor(end * total)): what an interval of a grid plan moves."""
    ids = rows.select(id_col, F.lit(1).alias("n"))
    placed = running_sum(ids, id_col, ["n"], 1 << 16).select(id_col, "n_before")
    inside = placed.where((F.col("n_before") >= floor(begin * total)) & (F.col("n_before") < floor(end * total)))
    return rows.join(inside.select(id_col), id_col, "left_semi")
