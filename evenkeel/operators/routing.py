"""Routing of rows to nodes: hash owners, weighted choices from a routing table, probes of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import key_range, owner


def cumulative(routes: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Add lo, hi (half open) and total to a routing table (key, task, count): each key's entries by count, then task."""
    w = Window.partitionBy(*by).orderBy("count", "task").rowsBetween(Window.unboundedPreceding, 0)
    out = routes.withColumn("hi", F.sum("count").over(w)).withColumn("total", F.sum("count").over(Window.partitionBy(*by)))
    return out.withColumn("lo", F.col("hi") - F.col("count"))


def _nested(routes: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """One row for a key with its entries in an array, bounded by the number of nodes."""
    return cumulative(routes, by).groupBy(*by).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("hi", "task"))).alias("entries"))


def pick(rows: DataFrame, routes: DataFrame, seq: Column, nodes: int, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Add task, where a row is stored, and routed, whether by the table.

    A row's place in its key's cumulative counts is a pure function of the row, so that a retry agrees.  With rows and a
    table that carry an epoch too, `by` is ("epoch", "key"): a row follows the version that it carries.
    """
    met = rows.withColumn("_seq", seq).join(_nested(routes, by), list(by), "left")
    place = F.pmod(F.col("_seq"), F.col("total"))
    chosen = F.get(F.filter("entries", lambda e: place < e["hi"]), F.lit(0))["task"]
    return met.withColumn("routed", F.col("total").isNotNull()).withColumn("task", F.coalesce(chosen, owner(F.col("key"), nodes))).drop("_seq", "total")


def route_equi(rows: DataFrame, routes: DataFrame, seq: Column, nodes: int) -> DataFrame:
    """STORE at one node; JOIN probes at every other node that holds the key."""
    met = pick(rows, routes, seq, nodes)
    other = F.filter(F.transform(F.coalesce("entries", F.array()), lambda e: e["task"]), lambda t: t != F.col("task"))
    sent = F.concat(F.array(F.struct(F.col("task").alias("t"), F.lit("STORE").alias("role"))), F.transform(other, lambda t: F.struct(t.alias("t"), F.lit("JOIN").alias("role"))))
    keep = [c for c in rows.columns if c != "task"]
    return met.withColumn("_m", F.explode(sent)).select(*keep, F.col("_m.t").alias("task"), F.col("_m.role").alias("role"), "routed")


def routed_equi_join(r: DataFrame, s: DataFrame, routes: DataFrame, seq: Column, nodes: int, on: list[str]) -> DataFrame:
    """The join as nodes do it: rows of R where they are stored meet S wherever it is stored or probes."""
    stored = route_equi(r, routes, seq, nodes).where("role = 'STORE'").drop("role", "routed")
    sent = route_equi(s, routes, seq, nodes).drop("role", "routed")
    return stored.join(sent, [*on, "task"]).drop("task")


def routed_pair_counts(r: DataFrame, s: DataFrame, routes: DataFrame, seq: Column, nodes: int) -> DataFrame:
    """The size of that join by key alone: pairs of each key over all nodes, without a row for each pair.

    A node has as many pairs of a key as it stores rows of R times those of S that it stores or is probed with."""
    stored = route_equi(r, routes, seq, nodes).where("role = 'STORE'").groupBy("key", "task").agg(F.count("*").alias("n_r"))
    sent = route_equi(s, routes, seq, nodes).groupBy("key", "task").agg(F.count("*").alias("n_s"))
    return stored.join(sent, ["key", "task"]).groupBy("key").agg(F.sum(F.col("n_r") * F.col("n_s")).alias("n_pairs"))


_PROBES = "array<struct<role:string,at:bigint>>"


def band_fanout(rows: DataFrame, key: str, width: int, nodes: int) -> DataFrame:
    """One probe for each opposite key in the band, to that key's owner."""
    return rows.withColumn("probe_key", F.explode(key_range(F.col(key), width))).withColumn("task", owner(F.col("probe_key"), nodes))


def route_band(rows: DataFrame, routes: DataFrame, seq: Column, nodes: int, width: int, passes: Column) -> DataFrame:
    """STORE each row (column key) at one node; of rows that pass their side's filter, JOIN probes to one holder of each
    opposite key in the band: role, probe_key (the row's own for STORE) and task are added."""
    own = F.struct(F.lit("STORE").alias("role"), F.col("key").alias("at"))
    probes = F.transform(key_range(F.col("key"), width), lambda k: F.struct(F.lit("JOIN").alias("role"), k.alias("at")))
    sent = rows.withColumn("_seq", seq).withColumn("_m", F.explode(F.concat(F.array(own), F.when(passes, probes).otherwise(F.array().cast(_PROBES)))))
    sent = sent.select(*[F.col(c) for c in rows.columns], F.col("_m.role").alias("role"), F.col("_m.at").alias("probe_key"), "_seq")
    met = sent.join(_nested(routes).withColumnRenamed("key", "probe_key"), "probe_key", "left")
    place = F.pmod(F.col("_seq") + F.col("probe_key"), F.col("total"))
    chosen = F.get(F.filter("entries", lambda e: place < e["hi"]), F.lit(0))["task"]
    return met.select(*rows.columns, "role", "probe_key", F.coalesce(chosen, owner(F.col("probe_key"), nodes)).alias("task"))


def deal(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in turn to `parts` partitions."""
    return rows.repartition(parts)


def by_task(rows: DataFrame, nodes: int) -> DataFrame:
    """Rows to the partition that their column task names."""
    return rows.repartitionById(nodes, F.col("task"))
