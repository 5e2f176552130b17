"""Rebalancing plans as overlaps of intervals.

What donors give lies on one number line and what acceptors can take on another, each in the order of its
rule; running sums make segments, and overlapping segments are the moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import limits, node_load

RULES = ("random", "first", "boundary", "quick", "band")


def plan_moves(hist: DataFrame, nodes: int, rule: str = "random", routed: DataFrame | None = None) -> DataFrame:
    """Moves (from_task, to_task, key, count) that bring overloaded nodes to the rule's target (stats.limits).

    ``random``, ``quick`` and ``band`` unload keys and fill nodes in ascending order of their ids; ``boundary`` does so too, but
    unloads the keys of `routed` (key) first; ``first`` unloads the largest keys and fills the fullest nodes first.  Ties go
    to the smaller id.  Rows are conserved and keys are split where a segment ends; what finds no room stays.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    load = node_load(hist, nodes)
    limit = load.crossJoin(F.broadcast(limits(load, nodes, rule)))  # one row
    donors = limit.where("load > trigger").select("task", (F.col("load") - F.col("target")).alias("excess"))  # nodes at most
    late = F.lit(1)
    if rule == "boundary" and routed is not None:
        hist = hist.join(routed.select("key").distinct().withColumn("_known", F.lit(0)), "key", "left")
        late = F.coalesce("_known", F.lit(1))
    hist = hist.select("task", "key", "count", late.alias("_late"))
    order = [F.desc("count"), F.col("key")] if rule == "first" else [F.col("_late"), F.col("key")]
    before = Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    unload = hist.join(F.broadcast(donors), "task").withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    unload = unload.withColumn("amount", F.least("count", F.col("excess") - F.col("_before"))).where("amount > 0")
    # donors in ascending order, each with its keys in ascending order
    base = donors.withColumn("_base", F.coalesce(F.sum("excess").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("task").orderBy("_late", "key").rowsBetween(Window.unboundedPreceding, 0)
    give = unload.join(F.broadcast(base.select("task", "_base")), "task").withColumn("hi", F.sum("amount").over(inside) + F.col("_base"))
    give = give.select(F.col("task").alias("from_task"), "key", (F.col("hi") - F.col("amount")).alias("lo"), "hi")
    # acceptors: as many rows as nodes
    by = [F.desc("load"), F.col("task")] if rule == "first" else [F.col("task")]
    room = limit.where("load < target").withColumn("gap", F.col("target") - F.col("load"))
    room = room.withColumn("a_hi", F.sum("gap").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    room = room.select(F.col("task").alias("to_task"), (F.col("a_hi") - F.col("gap")).alias("a_lo"), "a_hi")
    met = give.join(F.broadcast(room), (F.col("lo") < F.col("a_hi")) & (F.col("a_lo") < F.col("hi")))
    return met.select("from_task", "to_task", "key", (F.least("hi", "a_hi") - F.greatest("lo", "a_lo")).cast("long").alias("count"))


def histogram_after(hist: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of each (task, key) once a plan is carried out."""
    moved = plan.select(F.col("from_task").alias("task"), "key", (-F.col("count")).alias("count")).unionByName(plan.select(F.col("to_task").alias("task"), "key", "count"))
    return hist.select("task", "key", "count").unionByName(moved).groupBy("task", "key").agg(F.sum("count").alias("count")).where("count > 0")


def route_table(hist: DataFrame, plan: DataFrame) -> DataFrame:
    """Entries (key, task, count) of the keys that a plan touches, with their rows after it."""
    return histogram_after(hist, plan).join(plan.select("key").distinct(), "key", "left_semi").select("key", "task", "count")


def end_checks(plan: DataFrame) -> DataFrame:
    """Transfers that each node has to wait for."""
    return plan.groupBy(F.col("to_task").alias("task")).agg(F.count("*").alias("n"))
