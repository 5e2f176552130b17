"""Queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import time
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import fields, grid_cells, grid_descriptor, grid_text, key_range, owner, same_text, side, to_text
from .functions.hashing import Ring, ring_lookup
from .operators import grid as gridop
from .operators import joins, migrate, routing, stats
from .plans import greedy, prefix_sum
from .plans.grid import TARGET, TRIGGER, Grid, change_grid, grid_within, merge_sends, needs_resize, node_share, overlaps, pieces, resized, size_grid
from .plans.intervals import length
from .session import scratch, written
from .sources import control
from .sources.files import last_by_key, write_metrics, zipf_counts
from .streaming.joins import drain, drain_updates, file_stream, rebalance_each_batch, stream_band_join, stream_equi_join, stream_key_sides, stream_load

NODES, BAND = 5, 10
SIDE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
#: A short last column; grid rows and columns are chosen by functions of the row.
GRID = Grid(4, 3, "col", 2)
#: Rows that a node of the grids over tables holds.
NODE_ROWS = 4096
#: Nodes that a join over tables has at most, however many rows: the reference's joiners (LoadBalanceTopologyMFM.java:28-36).
MOST_NODES = 40
_SKEW = "CASE WHEN l_orderkey % 10 < 5 THEN 0 WHEN l_orderkey % 10 = 5 THEN 7 ELSE l_partkey % 50 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of lineitem with the asked columns, prefixed r_ and s_."""
    rows = table(spark, sf_dir, "lineitem").withColumn("side", side(*SIDE))
    cut = lambda s, p: rows.where(F.col("side") == s).select(*[F.col(c).alias(f"{p}_{c[2:]}") for c in cols])
    return cut("R", "r"), cut("S", "s")


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with side, a skewed key and its hash owner in task."""
    rows = table(spark, sf_dir, "lineitem").select(*SIDE).withColumn("side", side(*SIDE)).withColumn("key", F.expr(_SKEW))
    return rows.withColumn("task", owner(F.col("key"), NODES))


# joins


def equi_join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = sides(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey")
    return joins.equi_join(r.withColumnRenamed("r_orderkey", "key"), s.withColumnRenamed("s_orderkey", "key"), ["key"])


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = sides(spark, sf_dir, "l_orderkey", "l_quantity")
    met = joins.band_join(r, s.select("s_orderkey", "s_quantity"), "r_orderkey", "s_orderkey", BAND)
    return met.groupBy(F.col("r_orderkey").alias("key")).agg(F.count("*").alias("n_pairs"), F.sum("s_quantity").alias("sum_s_quantity"))


def _band_filtered(r: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return r.where(same_text(F.col("r_returnflag"), F.lit("r"))), s.where((F.col("s_quantity") > 48) & same_text(F.col("s_linestatus"), F.lit("o")))


def band_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = sides(spark, sf_dir, "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    r, s = _band_filtered(r, s)
    met = joins.band_join(r.select("r_orderkey", "r_partkey"), s.select("s_orderkey", "s_partkey", "s_quantity"), "r_orderkey", "s_orderkey", BAND)
    return met.select("r_orderkey", "r_partkey", "s_orderkey", "s_partkey", "s_quantity")


def band_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = sides(spark, sf_dir, *SIDE, "l_returnflag", "l_quantity", "l_linestatus")
    r, s = _band_filtered(r, s)
    text = lambda p: to_text(*[f"{p}_{c[2:]}" for c in SIDE]).alias(f"{p}_text")
    met = joins.band_join(r.select("r_orderkey", text("r")), s.select("s_orderkey", text("s")), "r_orderkey", "s_orderkey", BAND)
    return met.select(F.concat_ws("|", "r_text", "s_text").alias("joined"))


def ineq_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = sides(spark, sf_dir, "l_orderkey")
    return joins.inequality_counts(r.withColumnRenamed("r_orderkey", "key"), s.withColumnRenamed("s_orderkey", "key"), "key")


def cust_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.count_by_key(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


def cust_order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cust_order_counts(spark, sf_dir).agg(F.sum("n_rows").cast("long").alias("total"))


# statistics


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(skewed(spark, sf_dir))


def node_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.node_load(_hist(spark, sf_dir), NODES)


def node_key_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist(spark, sf_dir)


def key_side_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.key_side_load(skewed(spark, sf_dir))


def load_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bounds(node_load(spark, sf_dir), NODES)


def load_bounds_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quick_bounds(node_load(spark, sf_dir), NODES)


def overloaded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overloaded(node_load(spark, sf_dir), NODES)


def migrate_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.migrate_volume(node_load(spark, sf_dir), NODES)


def utility_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.utility_rank(_hist(spark, sf_dir))


# planners


def _control(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The histogram and a plan for it, written once: control state that all later steps read."""
    hist = written(_hist(spark, sf_dir), "histogram")
    return hist, written(prefix_sum.plan_moves(hist, NODES, "first"), "plan")


def _second(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The histogram after that plan and more rows at their hash owners, and the keys that the first plan routed."""
    hist, plan = _control(spark, sf_dir)
    more = stats.histogram(skewed(spark, sf_dir).where("l_linenumber <= 2"))
    both = prefix_sum.histogram_after(hist, plan).unionByName(more).groupBy("task", "key").agg(F.sum("count").alias("count"))
    return written(both, "histogram"), written(plan.select("key").distinct(), "routed")


def _planned(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return prefix_sum.plan_moves(written(_hist(spark, sf_dir), "histogram"), NODES, rule)


def plan_split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir, "random")


def plan_split_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir, "first")


def plan_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir, "quick")


def plan_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir, "band")


def plan_boundary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second rebalance, which unloads the keys that the first one routed before the others."""
    hist, routed = _second(spark, sf_dir)
    return prefix_sum.plan_moves(hist, NODES, "boundary", routed)


def _greedy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    hist, routed = _second(spark, sf_dir)
    part, load = greedy.collect_histogram(hist, NODES, routed)
    return greedy.as_table(spark, greedy.PLANNERS[name](part, [r["key"] for r in routed.collect()], load))  # keys of a routing table


def plan_split_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(spark, sf_dir, "last")


def plan_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(spark, sf_dir, "fit")


def end_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_sum.end_checks(plan_split_first(spark, sf_dir))


def load_after_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.node_load(prefix_sum.histogram_after(*_control(spark, sf_dir)), NODES)


def route_table_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(prefix_sum.route_table(*_control(spark, sf_dir)), "routes")


def route_table_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.route_table_size(route_table_after(spark, sf_dir))


def _route_log(spark: SparkSession, sf_dir: str) -> control.RouteLog:
    """Two epochs: the table after the first plan, and after a second one, in which untouched routes are carried over."""
    hist, plan = _control(spark, sf_dir)
    log = control.RouteLog(spark, scratch(spark, "route-log"))
    log.publish(1, prefix_sum.route_table(hist, plan))
    hist, routed = _second(spark, sf_dir)
    plan = written(prefix_sum.plan_moves(hist, NODES, "boundary", routed), "plan")
    kept = plan.select("key").union(routed).distinct()
    log.publish(2, prefix_sum.histogram_after(hist, plan).join(kept, "key", "left_semi"))
    return log


def routes_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_log(spark, sf_dir).history()


def dest_pick_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row follows the version of the table that it carries."""
    rows = skewed(spark, sf_dir).withColumn("epoch", F.when(F.col("l_linenumber") <= 2, 2).otherwise(1))
    picked = routing.pick(rows, _route_log(spark, sf_dir).history(), _seq(), NODES, ("epoch", "key"))
    return picked.groupBy("epoch", "key", "task", "routed").agg(F.count("*").alias("n_rows"))


def route_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.route_lines(route_table_after(spark, sf_dir))


def route_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing table, written as text and read back."""
    path = scratch(spark, "route-text")
    control.write_routes(route_table_after(spark, sf_dir), path)
    return control.read_routes(spark, path)


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = _hist(spark, sf_dir)
    return control.load_lines(hist, stats.node_load(hist, NODES))


def control_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one rebalance, appended one by one and read back; times are written too but not returned."""
    began = time.perf_counter()
    hist, plan = _control(spark, sf_dir)
    routes = written(prefix_sum.route_table(hist, plan), "routes")
    took = (time.perf_counter() - began) * 1000
    n_r, n_s = _counts(spark, sf_dir)
    path = scratch(spark, "metrics")
    found = {
        "broadcast": routing.route_equi(skewed(spark, sf_dir), routes, _seq(), NODES).count(),
        "migrateCount": stats.migrate_volume(stats.node_load(hist, NODES), NODES).first()[0],
        "routeTableSize": stats.route_table_size(routes).first()[0],
        "migVolume": plan.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0],
        "statistics": node_share(n_r, n_s, GRID), "expinfo.r": n_r, "expinfo.s": n_s, "expinfo.nodes": GRID.nodes, "migrateTime": took,
    }
    for name, value in found.items():
        write_metrics(spark.createDataFrame([(1, name, float(value))], "epoch int, name string, value double"), path)
    return control.read_metrics(spark, path).where("name <> 'migrateTime'")


# routing


def _seq():
    return F.col("l_partkey") + F.col("l_suppkey")


def dest_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skewed(spark, sf_dir)
    return routing.pick(rows, route_table_after(spark, sf_dir), _seq(), NODES).select(*SIDE, "side", "key", "task", "routed")


def route_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skewed(spark, sf_dir)
    return routing.route_equi(rows, route_table_after(spark, sf_dir), _seq(), NODES).select(*SIDE, "side", "key", "task", "role", "routed")


def broadcast_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_equi(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n_messages"))


def equi_join_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each skewed key over all nodes: every pair meets at one of them."""
    rows = skewed(spark, sf_dir)
    r, s = rows.where("side = 'R'"), rows.where("side = 'S'")
    return routing.routed_pair_counts(r, s, route_table_after(spark, sf_dir), _seq(), NODES)


def band_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return routing.band_fanout(rows, "l_orderkey", BAND, NODES).groupBy("task").agg(F.count("*").alias("n_probes"))


def band_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the band router: every row is stored, those that pass their side's filter probe; keys under 100 are split."""
    rows = table(spark, sf_dir, "lineitem").withColumn("side", side(*SIDE)).withColumn("key", F.col("l_orderkey"))
    keys = rows.where("key < 100").select("key").distinct()
    entries = F.explode(F.array(*[F.struct(F.pmod(F.col("key") + d, F.lit(NODES)).cast("int").alias("task"), F.lit(n).cast("long").alias("count")) for d, n in ((0, 3), (1, 2))]))
    routes = written(keys.withColumn("e", entries).select("key", "e.task", "e.count"), "routes")
    r_passes = (F.col("side") == "R") & same_text(F.col("l_returnflag"), F.lit("r"))
    s_passes = (F.col("side") == "S") & (F.col("l_quantity") > 48) & same_text(F.col("l_linestatus"), F.lit("o"))
    sent = routing.route_band(rows.select("key", "side", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_linestatus"), routes, _seq(), NODES, BAND, r_passes | s_passes)
    return sent.groupBy("task", "side", "role").agg(F.count("*").alias("n_messages"))


def direct_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each node, dealt to it by number: all of them are in one partition."""
    dealt = routing.by_task(skewed(spark, sf_dir).select("task"), NODES).select("task", F.spark_partition_id().alias("part"))
    return dealt.groupBy("task").agg(F.count("*").alias("n_rows"), F.count_distinct("part").alias("n_parts"), F.min("part").alias("part"))


# migration


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def migration_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, plan = _control(spark, sf_dir)
    return migrate.quotas(migrate.side_counts(skewed(spark, sf_dir)), plan)


def _moved(spark: SparkSession, sf_dir: str, newest: bool = False) -> DataFrame:
    return migrate.migrate(skewed(spark, sf_dir), _control(spark, sf_dir)[1], _ORDER, newest)


def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir).where("task <> from_task").select(*SIDE, "side", "key", "from_task", F.col("task").alias("to_task"))


def migrated_rows_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir, True).where("task <> from_task").select(*SIDE, "side", "key", "from_task", F.col("task").alias("to_task"))


def moved_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each node received in an epoch."""
    return _moved(spark, sf_dir).where("task <> from_task").groupBy(F.lit(1).alias("epoch"), "task").agg(F.count("*").alias("n_rows"))


def equi_join_after_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each skewed key once rows have moved: R where it now lies meets S at each node that holds its key."""
    hist, plan = _control(spark, sf_dir)
    moved = migrate.migrate(skewed(spark, sf_dir), plan, _ORDER)
    return migrate.pairs_after(moved, written(prefix_sum.route_table(hist, plan), "routes"))


def merge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with those that were sent anew and those that came meanwhile folded in."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    again = base.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("T"))
    new = base.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("N")).unionByName(base.where("o_orderkey < 10").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return migrate.upsert(base, again, new, "o_orderkey")


# grid


_SIZES = ((20, 20, 250000), (100, 100, 100), (250, 90, 100), (640, 320, 170), (1000, 700, 300), (700, 1000, 300), (300000, 100000, 150000), (400000, 150000, 150000))


def matrix_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for r, s, v in _SIZES:
        g = size_grid(r, s, v)
        rows.append((r, s, v, g["case"], g["rows"], g["cols"], g["short"], g["last"], g["nodes"]))
    return spark.createDataFrame(rows, "n_r long, n_s long, v long, best string, grid_rows int, grid_cols int, short string, last int, nodes int")


def _counts(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "customer").count()


def _sized(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid for the tables' counts, with as many nodes as there are at most."""
    return grid_within(*_counts(spark, sf_dir), NODE_ROWS, MOST_NODES)


def matrix_size_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_r, n_s = _counts(spark, sf_dir)
    g = size_grid(n_r, n_s, NODE_ROWS)
    row = (n_r, n_s, NODE_ROWS, g["case"], g["rows"], g["cols"], g["short"], g["last"], g["nodes"])
    return spark.createDataFrame([row], "n_r long, n_s long, v long, best string, grid_rows int, grid_cols int, short string, last int, nodes int")


def matrix_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a node of the present grid holds, whether that is too much, and the grid that would take its place."""
    n_r, n_s = _counts(spark, sf_dir)
    new = resized(n_r, n_s, NODE_ROWS)
    row = (node_share(n_r, n_s, GRID), needs_resize(n_r, n_s, GRID, NODE_ROWS), new.rows, new.cols, new.nodes)
    return spark.createDataFrame([row], "load double, overloaded boolean, grid_rows int, grid_cols int, nodes int")


def _orders_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridop.assign(table(spark, sf_dir, "orders").select("o_orderkey"), GRID, "R", F.col("o_orderkey"))


def _customer_cells(spark: SparkSession, sf_dir: str, *cols: str, grid: Grid = GRID) -> DataFrame:
    return gridop.assign(table(spark, sf_dir, "customer").select("c_custkey", *cols), grid, "S", F.col("c_custkey"))


def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_cells(spark, sf_dir).select("o_orderkey", "node", "special")


def _matrix_sides(spark: SparkSession, sf_dir: str, r_cols: list[str], s_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Orders and customers at the nodes of the grid for their counts; an order without a key has a line too."""
    grid = _sized(spark, sf_dir)
    r = gridop.assign(table(spark, sf_dir, "orders").select("o_orderkey", *r_cols), grid, "R", F.coalesce("o_orderkey", F.lit(0)))
    return r, _customer_cells(spark, sf_dir, *s_cols, grid=grid)


def matrix_join_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _matrix_sides(spark, sf_dir, ["o_custkey"], ["c_name"])
    return joins.grid_join(r, s, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


def matrix_join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = (F.abs(F.col("o_custkey") - F.col("c_custkey")) <= 1) & (F.col("o_totalprice") > F.col("c_acctbal"))
    r, s = _matrix_sides(spark, sf_dir, ["o_custkey", "o_totalprice"], ["c_acctbal"])
    return joins.grid_join(r, s, near, ("o_custkey", "c_custkey", 1)).select("o_orderkey", "o_custkey", "c_custkey")


def matrix_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridop.node_rows(_orders_cells(spark, sf_dir), _customer_cells(spark, sf_dir))


_OLD, _NEW = Grid(2, 2), Grid(4, 2)


def matrix_cell_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a[0], a[1], b[0], b[1], r, s, both) for a, b, r, s, both in overlaps(_OLD, _NEW, 1000, 600)]
    return spark.createDataFrame(rows, "old_i int, old_j int, new_i int, new_j int, r_rows double, s_rows double, total double")


_CHANGED = Grid(3, 3, "col", 2)


def matrix_mig_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions and rows that nodes send each other for a change of the grid over orders and customers."""
    n_r, n_s = _counts(spark, sf_dir)
    moves, total = merge_sends(change_grid(_OLD, _CHANGED, n_r, n_s)), {"R": n_r, "S": n_s}
    rows = [(a, b, s, round(length(x), 12), sum(floor(hi * total[s]) - floor(lo * total[s]) for lo, hi in x)) for (a, b, s), x in sorted(moves.items())]
    return spark.createDataFrame(rows, "from_node int, to_node int, side string, fraction double, n_rows long")


def _after_change(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[int, tuple[int, int]]]:
    """Orders and customers at the nodes that hold them after a change of the grid, and the nodes' cells."""
    n_r, n_s = _counts(spark, sf_dir)
    plan = change_grid(_OLD, _CHANGED, n_r, n_s)
    held = pieces(_OLD, plan, n_r, n_s)
    r = gridop.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    s = gridop.with_position(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return gridop.held_rows(r, held, "R"), gridop.held_rows(s, held, "S"), {n: c for c, n in plan.nodes.items()}


def matrix_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each cell of the new grid holds, by sends and discards alone."""
    r, s, cells = _after_change(spark, sf_dir)
    n = lambda side, how: F.count_if((F.col("side") == side) & (F.col("how") == "special" if how else F.col("how") != "special"))
    both = r.select("node", "how", F.lit("R").alias("side")).unionByName(s.select("node", "how", F.lit("S").alias("side")))
    per = both.groupBy("node").agg(n("R", False).alias("n_r"), n("S", False).alias("n_s"), n("R", True).alias("n_special"))
    names = spark.createDataFrame([(k, *c) for k, c in cells.items()], "node int, i int, j int")
    return names.join(per, "node").select("i", "j", "n_r", "n_s", "n_special")


def matrix_join_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, _ = _after_change(spark, sf_dir)
    met = joins.grid_join(r.drop("how", "position"), s.drop("how", "position"), F.col("o_custkey") == F.col("c_custkey"))
    return met.select("o_orderkey", "c_custkey", "c_name")


def free_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridop.free_nodes(spark, 40, gridop.grid_table(spark, GRID))


def grid_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spark.createDataFrame([("0 1 2|3 4 5|6 7 -1|8 9 -1",)], "map string")
    return text.select(F.explode(grid_cells(F.col("map"))).alias("c")).select("c.i", "c.j", "c.node")


def grid_map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of the grid as text, by its cells, and the grid's descriptor."""
    missing = GRID.rows * GRID.cols - GRID.nodes
    shape = spark.createDataFrame([(f"{GRID.rows} {GRID.cols} {GRID.nodes} {missing} {int(GRID.short == 'col')}",)], "shape string").select(grid_descriptor(F.col("shape")).alias("d"))
    cells = gridop.grid_table(spark, GRID).agg(F.collect_list(F.struct("i", "j", "node")).alias("cells"))  # one row, a cell for each node
    return shape.crossJoin(cells).select(grid_text(F.col("cells"), F.col("d.rows"), F.col("d.cols")).alias("map"), "d.*")


# streams


def _stream_sides(spark: SparkSession, sf_dir: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    def cut(s: str, p: str) -> DataFrame:
        rows = file_stream(spark, sf_dir, "lineitem").withColumn("side", side(*SIDE)).where(F.col("side") == s)
        return rows.select(*[F.col(c).alias(f"{p}_{c[2:]}") for c in cols])

    return cut("R", "r"), cut("S", "s")


def stream_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _stream_sides(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey")
    return drain(stream_equi_join(r.withColumnRenamed("r_orderkey", "key"), s.withColumnRenamed("s_orderkey", "key"), ["key"]), "stream-equi")


def stream_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _stream_sides(spark, sf_dir, "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    r, s = _band_filtered(r, s)
    met = stream_band_join(r.select("r_orderkey", "r_partkey"), s.select("s_orderkey", "s_partkey", "s_quantity"), "r_orderkey", "s_orderkey", BAND)
    return drain(met.select("r_orderkey", "r_partkey", "s_orderkey", "s_partkey", "s_quantity"), "stream-band")


def stream_node_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = file_stream(spark, sf_dir, "events").select(owner(F.col("user_id"), NODES).alias("task"))
    return drain(stream_load(rows), "stream-load", "complete")


def stream_grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of orders to the cells of the grid."""
    rows = file_stream(spark, sf_dir, "orders").select("o_orderkey")
    return drain(gridop.assign(rows, GRID, "R", F.col("o_orderkey")).select("o_orderkey", "node", "special"), "stream-grid")


def stream_key_side_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each skewed key on either side, from the state of a stream."""
    rows = file_stream(spark, sf_dir, "lineitem").withColumn("side", side(*SIDE)).withColumn("key", F.expr(_SKEW))
    return drain_updates(stream_key_sides(rows), "stream-sides", "key")


def stream_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing table that a controller has published when the stream has ended."""
    rows = file_stream(spark, sf_dir, "lineitem").withColumn("key", F.expr(_SKEW)).select(owner(F.col("key"), NODES).alias("task"), "key")
    log = control.RouteLog(spark, scratch(spark, "route-log"))
    rebalance_each_batch(rows, NODES, "first", log)
    return log.at(log.epochs()[-1])


# utilities


def zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipf_counts(spark)


def pipe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").select("o_orderkey", to_text("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("line"))
    parts = text.withColumn("f", fields(F.col("line")))
    return parts.select("o_orderkey", "line", F.col("f")[1].cast("long").alias("custkey"), F.col("f")[3].alias("priority"), F.size("f").alias("n_fields"))


def last_wins_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", F.col("o_orderkey"))


def key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band's keys around each customer, clamped at 0."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", key_range(F.col("c_custkey"), BAND).alias("k")).select("c_custkey", F.size("k").alias("n_keys"), F.array_min("k").alias("low"), F.array_max("k").alias("high"))


def _ring(spark: SparkSession, sf_dir: str, replicas: int) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return ring_lookup(keys, Ring([f"node-{i}" for i in range(NODES)], replicas), "key")


def consistent_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ring(spark, sf_dir, 5)


def consistent_hash_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring with one point for each server, by the additive hash."""
    return _ring(spark, sf_dir, 0)


QUERIES = {
    "equi_join_self": equi_join_self, "band_join": band_join, "band_join_filtered": band_join_filtered, "band_join_text": band_join_text,
    "ineq_join": ineq_join, "cust_order_counts": cust_order_counts, "cust_order_total": cust_order_total,
    "node_load": node_load, "node_key_load": node_key_load, "key_side_load": key_side_load, "load_bounds": load_bounds, "load_bounds_band": load_bounds_band,
    "overloaded_nodes": overloaded_nodes, "migrate_volume": migrate_volume, "utility_rank": utility_rank,
    "plan_split_random": plan_split_random, "plan_split_first": plan_split_first, "plan_split_last": plan_split_last, "plan_first_fit": plan_first_fit,
    "plan_boundary_split": plan_boundary_split, "plan_quick": plan_quick, "plan_band": plan_band, "end_check_counts": end_check_counts,
    "load_after_plan": load_after_plan, "route_table_after": route_table_after, "route_table_size": route_table_size,
    "dest_pick": dest_pick, "route_equi": route_equi, "broadcast_count": broadcast_count, "equi_join_routed": equi_join_routed, "band_fanout": band_fanout,
    "migration_quota": migration_quota, "migrated_rows": migrated_rows, "equi_join_after_migration": equi_join_after_migration,
    "matrix_size": matrix_size, "grid_assign": grid_assign, "matrix_join_equi": matrix_join_equi, "matrix_join_theta": matrix_join_theta,
    "matrix_load": matrix_load, "matrix_cell_overlap": matrix_cell_overlap, "matrix_mig_volume": matrix_mig_volume, "free_nodes": free_nodes, "grid_codec": grid_codec,
    "stream_equi_join": stream_equi, "stream_band_join": stream_band, "stream_node_load": stream_node_load,
    "zipf_counts": zipf, "pipe_roundtrip": pipe_roundtrip, "last_wins_by_key": last_wins_by_key, "key_ranges": key_ranges, "consistent_hash_ring": consistent_hash_ring,
    "consistent_hash_plain": consistent_hash_plain, "routes_by_epoch": routes_by_epoch, "dest_pick_by_epoch": dest_pick_by_epoch, "route_table_text": route_table_text,
    "route_table_file": route_table_file, "load_report": load_report, "control_metrics": control_metrics, "band_route": band_route, "direct_grouping": direct_grouping,
    "migrated_rows_newest": migrated_rows_newest, "moved_per_task": moved_per_task, "merge_by_id": merge_by_id, "matrix_size_tables": matrix_size_tables,
    "matrix_trigger": matrix_trigger, "matrix_after_change": matrix_after_change, "matrix_join_after_change": matrix_join_after_change, "grid_map_text": grid_map_text,
    "stream_grid_assign": stream_grid_assign, "stream_rebalance": stream_rebalance, "stream_key_side_load": stream_key_side_load,
}

# SQL

_L = f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN ({' + '.join(SIDE)}) % 2 = 0 THEN 'R' ELSE 'S' END AS side, l_quantity, l_returnflag, l_linestatus FROM lineitem"
_SKEWED = f"li AS ({_L}), sk AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, side, {_SKEW} AS key FROM li), skewed AS (SELECT *, CAST(key % {NODES} AS INTEGER) AS task FROM sk)"
_HIST = (
    f"{_SKEWED}, hist AS (SELECT task, key, count(*) AS count FROM skewed GROUP BY task, key), "
    f"loads AS (SELECT CAST(n.task AS INTEGER) AS task, CAST(coalesce(sum(count), 0) AS BIGINT) AS load FROM range({NODES}) n(task) LEFT JOIN hist ON hist.task = n.task GROUP BY n.task), "
    f"lim AS (SELECT total, bl, CAST(floor(bl * 1.01 + 1) AS BIGINT) AS ul FROM (SELECT CAST(sum(load) AS BIGINT) AS total, CAST(sum(load) // {NODES} + 1 AS BIGINT) AS bl FROM loads))"
)


def _plan(unload: str, fill: str, give: str = "key", target: str = "bl", trigger: str = "ul", n: str = "") -> str:
    """CTEs of a plan over hist, loads and lim; n tells a second plan's names from the first's."""
    return (
        f"don{n} AS (SELECT task, load - {target} AS excess FROM loads{n}, lim{n} WHERE load > {trigger}), "
        f"un{n} AS (SELECT h.*, excess, coalesce(sum(h.count) OVER (PARTITION BY h.task ORDER BY {unload} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hist{n} h JOIN don{n} d ON d.task = h.task), "
        f"am{n} AS (SELECT *, least(count, excess - before) AS amount FROM un{n} WHERE excess > before), "
        f"give{n} AS (SELECT task, key, amount, sum(amount) OVER (ORDER BY task, {give} ROWS UNBOUNDED PRECEDING) AS hi FROM am{n}), "
        f"room{n} AS (SELECT task, {target} - load AS gap, sum({target} - load) OVER (ORDER BY {fill} ROWS UNBOUNDED PRECEDING) AS hi FROM loads{n}, lim{n} WHERE load < {target}), "
        f"plan{n} AS (SELECT g.task AS from_task, r.task AS to_task, g.key, CAST(least(g.hi, r.hi) - greatest(g.hi - g.amount, r.hi - r.gap) AS BIGINT) AS count "
        f"FROM give{n} g JOIN room{n} r ON g.hi - g.amount < r.hi AND r.hi - r.gap < g.hi)"
    )


_RANDOM, _FIRST = f"{_HIST}, {_plan('h.key', 'task')}", f"{_HIST}, {_plan('h.count DESC, h.key', 'load DESC, task')}"
_MEAN = f"qlim AS (SELECT CAST(total // {NODES} AS BIGINT) AS qbl, floor((total // {NODES}) * CAST(1.01 AS DOUBLE)) AS qul, total / {NODES} * CAST(1.1 AS DOUBLE) AS band_bl FROM lim)"
_QUICK = f"{_HIST.replace('lim AS', 'lim0 AS')}, {_MEAN.replace('FROM lim', 'FROM lim0').replace('qlim AS', 'lim AS')}, {_plan('h.key', 'task', target='qbl', trigger='qul')}"
_BANDED = f"{_HIST.replace('lim AS', 'lim0 AS')}, {_MEAN.replace('FROM lim', 'FROM lim0').replace('qlim AS', 'lim AS')}, {_plan('h.key', 'task', target='CAST(floor(band_bl) AS BIGINT)', trigger='band_bl')}"
_AFTER = (
    f"{_FIRST}, moved AS (SELECT task, key, count FROM hist UNION ALL SELECT from_task, key, -count FROM plan UNION ALL SELECT to_task, key, count FROM plan), "
    "after AS (SELECT task, key, CAST(sum(count) AS BIGINT) AS count FROM moved GROUP BY task, key HAVING sum(count) > 0), "
    "routes AS (SELECT key, task, count FROM after WHERE key IN (SELECT key FROM plan))"
)
_SECOND = (
    f"{_AFTER}, more AS (SELECT task, key, count FROM after UNION ALL SELECT task, key, count(*) FROM skewed WHERE l_linenumber <= 2 GROUP BY task, key), "
    "hist2 AS (SELECT task, key, CAST(sum(count) AS BIGINT) AS count, CASE WHEN key IN (SELECT key FROM plan) THEN 0 ELSE 1 END AS late FROM more GROUP BY task, key), "
    f"loads2 AS (SELECT CAST(n.task AS INTEGER) AS task, CAST(coalesce(sum(count), 0) AS BIGINT) AS load FROM range({NODES}) n(task) LEFT JOIN hist2 h ON h.task = n.task GROUP BY n.task), "
    f"lim2 AS (SELECT bl, CAST(floor(bl * 1.01 + 1) AS BIGINT) AS ul FROM (SELECT CAST(sum(load) // {NODES} + 1 AS BIGINT) AS bl FROM loads2)), "
    f"{_plan('h.late, h.key', 'task', 'late, key', n='2')}, "
    "moved2 AS (SELECT task, key, count FROM hist2 UNION ALL SELECT from_task, key, -count FROM plan2 UNION ALL SELECT to_task, key, count FROM plan2), "
    "after2 AS (SELECT task, key, CAST(sum(count) AS BIGINT) AS count FROM moved2 GROUP BY task, key HAVING sum(count) > 0), "
    "routes2 AS (SELECT key, task, count FROM after2 WHERE key IN (SELECT key FROM plan UNION SELECT key FROM plan2)), "
    "log AS (SELECT key, task, count, CAST(1 AS INTEGER) AS epoch FROM routes UNION ALL SELECT key, task, count, 2 FROM routes2)"
)
_CDF = (
    f"{_AFTER}, cdf AS (SELECT key, task, sum(count) OVER (PARTITION BY key ORDER BY count, task ROWS UNBOUNDED PRECEDING) AS hi, count, sum(count) OVER (PARTITION BY key) AS total FROM routes), "
    "picked AS (SELECT s.l_orderkey, s.l_partkey, s.l_suppkey, s.l_linenumber, s.side, s.key, c.task, TRUE AS routed FROM skewed s JOIN cdf c ON c.key = s.key "
    "AND (s.l_partkey + s.l_suppkey) % c.total < c.hi AND (s.l_partkey + s.l_suppkey) % c.total >= c.hi - c.count "
    "UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, side, key, task, FALSE FROM skewed WHERE key NOT IN (SELECT key FROM routes)), "
    "sent AS (SELECT *, 'STORE' AS role FROM picked UNION ALL SELECT p.l_orderkey, p.l_partkey, p.l_suppkey, p.l_linenumber, p.side, p.key, r.task, p.routed, 'JOIN' FROM picked p JOIN routes r ON r.key = p.key AND r.task <> p.task)"
)
_QUOTA = (
    f"{_FIRST}, mv AS (SELECT from_task, key, CAST(sum(count) AS BIGINT) AS count FROM plan GROUP BY from_task, key), "
    "sd AS (SELECT task, key, count(*) FILTER (side = 'R') AS n_r, count(*) FILTER (side = 'S') AS n_s FROM skewed GROUP BY task, key), "
    "qa AS (SELECT from_task, m.key, m.count, n_r, n_s, CASE WHEN least(n_r, n_s) < m.count // 2 THEN m.count - least(n_r, n_s) ELSE greatest(least(greatest(n_r, n_s), m.count // 2 + 1), m.count - least(n_r, n_s)) END AS lq "
    "FROM mv m JOIN sd ON sd.task = m.from_task AND sd.key = m.key), "
    "quota AS (SELECT from_task, key, count, n_r, n_s, CAST(CASE WHEN n_r >= n_s THEN lq ELSE count - lq END AS BIGINT) AS quota_r, CAST(CASE WHEN n_r >= n_s THEN count - lq ELSE lq END AS BIGINT) AS quota_s FROM qa)"
)
_PAIRS = "SELECT r.key, CAST(r.n * s.n AS BIGINT) AS n_pairs FROM (SELECT key, count(*) AS n FROM skewed WHERE side = 'R' GROUP BY key) r JOIN (SELECT key, count(*) AS n FROM skewed WHERE side = 'S' GROUP BY key) s ON s.key = r.key"
_LINE_TEXT = "'key = ' || key || ' , ' || string_agg(' [taskIndex = ' || task || ', count = ' || count || ']   ', '' ORDER BY count, task)"


def _migrated(order: str) -> str:
    return (
        f"WITH {_QUOTA}, rk AS (SELECT s.*, q.quota_r, q.quota_s, row_number() OVER (PARTITION BY s.task, s.key, s.side ORDER BY {order}) AS n FROM skewed s JOIN quota q ON q.from_task = s.task AND q.key = s.key), "
        "ps AS (SELECT *, CASE WHEN side = 'R' THEN n - 1 ELSE quota_r + n - 1 END AS p FROM rk WHERE n <= CASE WHEN side = 'R' THEN quota_r ELSE quota_s END), "
        "tg AS (SELECT from_task, to_task, key, count, sum(count) OVER (PARTITION BY from_task, key ORDER BY to_task ROWS UNBOUNDED PRECEDING) AS hi FROM plan) "
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, side, ps.key, ps.task AS from_task, to_task FROM ps JOIN tg ON tg.from_task = ps.task AND tg.key = ps.key AND p < hi AND p >= hi - tg.count"
    )


def _hashed(text: str, additive: bool) -> str:
    """The 32-bit string hash as nested expressions over unsigned numbers."""
    shifted = lambda h, n: f"(CAST(floor((CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) / {2 ** n}.0) AS BIGINT) & 4294967295)"
    second = f"(h1 + {shifted('h1', 7)}) % 4294967296" if additive else f"xor(h1, {shifted('h1', 7)})"
    return (
        f"SELECT t, abs(CASE WHEN h5 >= 2147483648 THEN h5 - 4294967296 ELSE h5 END) AS h FROM (SELECT t, (h4 + h4 * 32) % 4294967296 AS h5 FROM (SELECT t, xor(h3, {shifted('h3', 17)}) AS h4 FROM "
        f"(SELECT t, (h2 + h2 * 8) % 4294967296 AS h3 FROM (SELECT t, {second} AS h2 FROM (SELECT t, (h + h * 8192) % 4294967296 AS h1 FROM (SELECT t, "
        f"list_reduce(list_transform(string_split(t, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM {text}))))))"
    )


def _ring_sql(replicas: int) -> str:
    name = "'node-' || s || '&&VN' || v" if replicas else "'node-' || s"
    return (
        f"WITH names AS (SELECT {name} AS t, 'node-' || s AS server FROM range({NODES}) a(s), range({max(1, replicas)}) b(v)), keys AS (SELECT CAST(c_custkey AS VARCHAR) AS t FROM customer), "
        f"texts AS (SELECT t FROM names UNION SELECT t FROM keys), hashes AS MATERIALIZED ({_hashed('texts', not replicas)}), points AS (SELECT h AS p, server FROM names JOIN hashes USING (t)) "
        "SELECT t AS key, coalesce((SELECT arg_min(server, p) FROM points WHERE p >= h), (SELECT arg_min(server, p) FROM points)) AS server FROM keys JOIN hashes USING (t)"
    )


_EQUI = f"WITH li AS ({_L}) SELECT r.l_orderkey AS key, r.l_partkey AS r_partkey, r.l_suppkey AS r_suppkey, s.l_partkey AS s_partkey, s.l_suppkey AS s_suppkey FROM li r JOIN li s ON r.l_orderkey = s.l_orderkey WHERE r.side = 'R' AND s.side = 'S'"
_BAND_ON = f"s.l_orderkey BETWEEN r.l_orderkey - {BAND} AND r.l_orderkey + {BAND}"
_BAND_F = f"FROM (SELECT * FROM li WHERE side = 'R' AND l_returnflag = 'R') r JOIN (SELECT * FROM li WHERE side = 'S' AND l_quantity > 48 AND l_linestatus = 'O') s ON {_BAND_ON}"
_BAND_ROWS = f"WITH li AS ({_L}) SELECT r.l_orderkey AS r_orderkey, r.l_partkey AS r_partkey, s.l_orderkey AS s_orderkey, s.l_partkey AS s_partkey, s.l_quantity AS s_quantity {_BAND_F}"
_LINE = lambda t: f"concat_ws('|', {', '.join(f'{t}.{c}' for c in SIDE)})"
_CELLS = [(n, i, j) for n, (i, j) in enumerate(GRID.cells())]
_GRID_R = (
    f"SELECT o_orderkey, c.node, FALSE AS special FROM orders JOIN (VALUES {', '.join(f'({n}, {i}, {j})' for n, i, j in _CELLS)}) c(node, i, j) ON o_orderkey % {GRID.rows} = c.i "
    f"UNION ALL SELECT o_orderkey, c.node, TRUE FROM orders JOIN (VALUES {', '.join(f'({n}, {i})' for n, i, j in _CELLS if j == GRID.cols - 1)}) c(node, i) "
    f"ON o_orderkey % {GRID.rows} >= {GRID.last} AND (o_orderkey // {GRID.rows}) % {GRID.last} = c.i"
)
_GRID_S = f"SELECT c_custkey, c.node FROM customer JOIN (VALUES {', '.join(f'({n}, {j})' for n, i, j in _CELLS)}) c(node, j) ON c_custkey % {GRID.cols} = c.j"
def _sizes(inputs: str) -> str:
    """CTEs that size the grid of each row (n_r, n_s, v); table h, k = 1."""
    return f"""inp(n_r, n_s, v) AS ({inputs}),
cases(ord, best, by_r, up) AS (VALUES (1, 'ru', TRUE, TRUE), (2, 'rl', TRUE, FALSE), (3, 'su', FALSE, TRUE), (4, 'sl', FALSE, FALSE)),
a AS (SELECT n_r, n_s, v, ord, best, by_r, CAST(CASE WHEN by_r THEN n_r ELSE n_s END AS DOUBLE) AS p0, CAST(CASE WHEN by_r THEN n_s ELSE n_r END AS DOUBLE) AS a0, up FROM inp, cases),
b AS (SELECT *, greatest(1, CASE WHEN up THEN ceil(p0 / (v / 2.0)) ELSE floor(p0 / (v / 2.0)) END) AS p FROM a),
c AS (SELECT *, v - p0 / p AS rem FROM b), d AS (SELECT *, floor(a0 / rem) AS q0 FROM c WHERE rem > 0), e AS (SELECT *, a0 - q0 * rem AS surplus FROM d),
f AS (SELECT *, CASE WHEN surplus <> 0 THEN ceil(p0 / (v - surplus)) ELSE p END AS lack, CASE WHEN surplus <> 0 THEN q0 + 1 ELSE q0 END AS q FROM e),
g AS (SELECT *, p0 * q + (a0 - surplus) * p + CASE WHEN surplus <> 0 THEN surplus * lack ELSE 0 END AS cost FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY n_r, n_s, v ORDER BY cost, ord) AS k FROM g)"""


_SIZE_COLS = """CAST(CASE WHEN by_r THEN p ELSE q END AS INTEGER) AS grid_rows, CAST(CASE WHEN by_r THEN q ELSE p END AS INTEGER) AS grid_cols"""
_SIZE_ROWS = f"""SELECT CAST(n_r AS BIGINT) AS n_r, CAST(n_s AS BIGINT) AS n_s, CAST(v AS BIGINT) AS v, best, {_SIZE_COLS},
CASE WHEN by_r THEN 'col' ELSE 'row' END AS short, CAST(lack AS INTEGER) AS last, CAST(p * q - (p - lack) AS INTEGER) AS nodes FROM h WHERE k = 1"""
_COUNTED = "SELECT (SELECT count(*) FROM orders), (SELECT count(*) FROM customer), CAST({} AS DOUBLE)"
_SIZE = f"WITH {_sizes('VALUES ' + ', '.join(f'({a}, {b}, {c})' for a, b, c in _SIZES))} {_SIZE_ROWS}"
_TRIGGERED = (
    f"WITH {_sizes(_COUNTED.format(TARGET * NODE_ROWS))}, now AS (SELECT n_r / CAST({GRID.rows} AS DOUBLE) + n_s / CAST({GRID.cols} AS DOUBLE) AS load FROM inp) "
    f"SELECT load, load > CAST({TRIGGER * NODE_ROWS} AS DOUBLE) AS overloaded, {_SIZE_COLS}, CAST(p * q - (p - lack) AS INTEGER) AS nodes FROM h, now WHERE k = 1"
)
_SLICE = "CAST(floor(CAST({hi} AS DOUBLE) / {parts} * n) - floor(CAST({lo} AS DOUBLE) / {parts} * n) AS BIGINT)"
_CHANGED_CELLS = (
    f"WITH c AS (SELECT i, j FROM range({_CHANGED.rows}) a(i), range({_CHANGED.cols}) b(j) WHERE j < {_CHANGED.cols - 1} OR i < {_CHANGED.last}), "
    f"r AS (SELECT i, j, {_SLICE.format(hi='(i + 1)', lo='i', parts=_CHANGED.rows)} AS n_r, "
    f"CASE WHEN j = {_CHANGED.cols - 1} THEN {_SLICE.format(hi=f'({_CHANGED.last ** 2} + i + 1)', lo=f'({_CHANGED.last ** 2} + i)', parts=_CHANGED.rows * _CHANGED.last)} ELSE 0 END AS n_special FROM c, (SELECT count(*) AS n FROM orders)), "
    f"s AS (SELECT i, j, {_SLICE.format(hi='(j + 1)', lo='j', parts=_CHANGED.cols)} AS n_s FROM c, (SELECT count(*) AS n FROM customer)) "
    "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, n_r, n_s, n_special FROM r JOIN s USING (i, j)"
)
_SHORT = _CHANGED.last  # cells of the short last column
_PARTS = _CHANGED.rows * _SHORT
_VOLUME = f"""WITH RECURSIVE n AS (SELECT (SELECT count(*) FROM orders) AS r, (SELECT count(*) FROM customer) AS s),
old AS (SELECT i, j, CAST(row_number() OVER (ORDER BY i, j) - 1 AS INTEGER) AS node, i / {_OLD.rows}.0::DOUBLE AS r0, (i + 1) / {_OLD.rows}.0::DOUBLE AS r1, j / {_OLD.cols}.0::DOUBLE AS s0, (j + 1) / {_OLD.cols}.0::DOUBLE AS s1
  FROM range({_OLD.rows}) a(i), range({_OLD.cols}) b(j)),
new AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS cell, i / {_CHANGED.rows}.0::DOUBLE AS r0, (i + 1) / {_CHANGED.rows}.0::DOUBLE AS r1, j / {_CHANGED.cols}.0::DOUBLE AS s0, (j + 1) / {_CHANGED.cols}.0::DOUBLE AS s1
  FROM range({_CHANGED.rows}) a(i), range({_CHANGED.cols}) b(j) WHERE j < {_CHANGED.cols - 1} OR i < {_SHORT}),
common AS (SELECT o.node, w.cell, round(greatest(0, least(o.r1, w.r1) - greatest(o.r0, w.r0)) * n.r, 2) + round(greatest(0, least(o.s1, w.s1) - greatest(o.s0, w.s0)) * n.s, 2) AS total FROM old o, new w, n),
ord AS (SELECT node, cell, row_number() OVER (ORDER BY round(total, 2) DESC, node, cell) AS k FROM common),
greedy(k, nodes, cells) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS BIGINT[]) UNION ALL
  SELECT ord.k, CASE WHEN list_contains(nodes, node) OR list_contains(cells, cell) THEN nodes ELSE list_append(nodes, node) END,
  CASE WHEN list_contains(nodes, node) OR list_contains(cells, cell) THEN cells ELSE list_append(cells, cell) END FROM greedy JOIN ord ON ord.k = greedy.k + 1),
pairs AS (SELECT unnest(nodes) AS node, unnest(cells) AS cell FROM (SELECT * FROM greedy ORDER BY k DESC LIMIT 1)),
free AS (SELECT x AS node, row_number() OVER (ORDER BY x) AS k FROM range({_OLD.nodes + _CHANGED.nodes}) t(x) WHERE x NOT IN (SELECT node FROM pairs)),
late AS (SELECT cell, row_number() OVER (ORDER BY cell) AS k FROM new WHERE cell NOT IN (SELECT cell FROM pairs)),
place AS (SELECT cell, CAST(node AS INTEGER) AS node FROM pairs UNION ALL SELECT cell, CAST(free.node AS INTEGER) FROM late JOIN free USING (k)),
has AS (SELECT w.*, p.node, o.r0 AS hr0, o.r1 AS hr1, o.s0 AS hs0, o.s1 AS hs1 FROM new w JOIN place p USING (cell) LEFT JOIN pairs m USING (cell) LEFT JOIN old o ON o.node = m.node),
want AS (SELECT cell, node, 'R' AS side, i AS line, r0 AS a, r1 AS b, hr0 AS h0, hr1 AS h1, 0 AS kind FROM has UNION ALL SELECT cell, node, 'S', j, s0, s1, hs0, hs1, 0 FROM has
  UNION ALL SELECT cell, node, 'R', -1, ({_SHORT * _SHORT} + i) / {_PARTS}.0::DOUBLE, ({_SHORT * _SHORT} + i + 1) / {_PARTS}.0::DOUBLE, NULL, NULL, 1 FROM has WHERE j = {_CHANGED.cols - 1}),
cuts AS (SELECT DISTINCT side, x FROM (SELECT side, unnest([a, b]) AS x FROM want UNION ALL SELECT 'R', unnest([r0, r1]) FROM old UNION ALL SELECT 'S', unnest([s0, s1]) FROM old)),
seg AS (SELECT side, x AS lo, lead(x) OVER (PARTITION BY side ORDER BY x) AS hi FROM cuts QUALIFY hi IS NOT NULL),
need AS (SELECT w.cell, w.node, w.side, w.line, w.kind, lo, hi FROM want w JOIN seg ON seg.side = w.side AND lo >= a AND hi <= b WHERE h0 IS NULL OR hi <= h0 OR lo >= h1),
giver AS (SELECT need.*, g.node AS from_node, 0 AS turn, g.cell AS place FROM need JOIN has g ON need.kind = 0 AND g.cell <> need.cell AND CASE WHEN need.side = 'R' THEN g.i = need.line AND lo >= hr0 AND hi <= hr1 ELSE g.j = need.line AND lo >= hs0 AND hi <= hs1 END
  UNION ALL SELECT need.*, o.node, 1, o.node FROM need JOIN old o ON CASE WHEN need.side = 'R' THEN o.j = 0 AND lo >= r0 AND hi <= r1 ELSE o.i = 0 AND lo >= s0 AND hi <= s1 END),
sent AS (SELECT *, row_number() OVER (PARTITION BY cell, side, kind, lo ORDER BY turn, place) AS k FROM giver WHERE kind = 1 OR from_node <> node),
moved AS (SELECT DISTINCT from_node, node AS to_node, side, lo, hi FROM sent WHERE k = 1 AND from_node <> node)
SELECT CAST(from_node AS INTEGER) AS from_node, to_node, side, round(sum(hi - lo), 12) AS fraction, CAST(sum(floor(hi * CASE side WHEN 'R' THEN n.r ELSE n.s END) - floor(lo * CASE side WHEN 'R' THEN n.r ELSE n.s END)) AS BIGINT) AS n_rows FROM moved, n GROUP BY 1, 2, 3"""
_BAND_ROUTE = (
    f"WITH li AS ({_L}), m AS (SELECT side, l_orderkey AS k, l_partkey + l_suppkey AS seq, 'STORE' AS role FROM li UNION ALL "
    f"SELECT side, unnest(range(greatest(l_orderkey - {BAND}, 0), l_orderkey + {BAND + 1})), l_partkey + l_suppkey, 'JOIN' FROM li WHERE CASE WHEN side = 'R' THEN l_returnflag = 'R' ELSE l_quantity > 48 AND l_linestatus = 'O' END), "
    "split AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey < 100) "
    f"SELECT CAST((CASE WHEN split.key IS NOT NULL AND (seq + k) % 5 < 2 THEN k + 1 ELSE k END) % {NODES} AS INTEGER) AS task, side, role, count(*) AS n_messages FROM m LEFT JOIN split ON split.key = m.k GROUP BY ALL"
)
_PICKED2 = (
    f"WITH {_SECOND}, cdf AS (SELECT *, sum(count) OVER (PARTITION BY epoch, key ORDER BY count, task ROWS UNBOUNDED PRECEDING) AS hi, sum(count) OVER (PARTITION BY epoch, key) AS total FROM log), "
    "rows AS (SELECT *, CAST(CASE WHEN l_linenumber <= 2 THEN 2 ELSE 1 END AS INTEGER) AS epoch FROM skewed), "
    "hit AS (SELECT r.epoch, r.key, c.task, TRUE AS routed FROM rows r JOIN cdf c ON c.key = r.key AND c.epoch = r.epoch AND (r.l_partkey + r.l_suppkey) % c.total < c.hi AND (r.l_partkey + r.l_suppkey) % c.total >= c.hi - c.count "
    "UNION ALL SELECT epoch, key, task, FALSE FROM rows r WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.key = r.key AND log.epoch = r.epoch)) SELECT epoch, key, task, routed, count(*) AS n_rows FROM hit GROUP BY ALL"
)
_METRICS = (
    f"WITH {_CDF}, n AS (SELECT (SELECT count(*) FROM orders) AS r, (SELECT count(*) FROM customer) AS s), "
    f"v(name, value) AS (SELECT 'broadcast', CAST(count(*) AS DOUBLE) FROM sent UNION ALL SELECT 'migrateCount', coalesce(sum(floor(load - total / {NODES} * CAST(1.1 AS DOUBLE))), 0) FROM loads, lim WHERE load > total / {NODES} * CAST(1.1 AS DOUBLE) "
    "UNION ALL SELECT 'routeTableSize', coalesce(sum(4 * (3 + 2 * (k - 1))), 0) FROM (SELECT count(*) AS k FROM routes GROUP BY key) UNION ALL SELECT 'migVolume', coalesce(sum(count), 0) FROM plan "
    f"UNION ALL SELECT 'statistics', r / CAST({GRID.rows} AS DOUBLE) + s / CAST({GRID.cols} AS DOUBLE) FROM n UNION ALL SELECT 'expinfo.r', r FROM n UNION ALL SELECT 'expinfo.s', s FROM n UNION ALL SELECT 'expinfo.nodes', {GRID.nodes}) "
    "SELECT CAST(1 AS INTEGER) AS epoch, name, CAST(value AS DOUBLE) AS value FROM v"
)
_MERGED = (
    "WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, 0 AS n FROM orders), u AS (SELECT * FROM b UNION ALL SELECT o_orderkey, o_custkey, 'T', 1 FROM b WHERE o_orderkey % 7 = 0 "
    "UNION ALL SELECT o_orderkey, o_custkey, 'N', 2 FROM b WHERE o_orderkey % 5 = 0 UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, 2 FROM b WHERE o_orderkey < 10) "
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) AS k FROM u) WHERE k = 1"
)
_MAP = (
    f"WITH cells(node, i, j) AS (VALUES {', '.join(f'({n}, {i}, {j})' for n, i, j in _CELLS)}), g AS (SELECT i, j, coalesce(node, -1) AS node FROM (SELECT i, j FROM range({GRID.rows}) a(i), range({GRID.cols}) b(j)) LEFT JOIN cells USING (i, j)), "
    "l AS (SELECT i, string_agg(node || ' ', '' ORDER BY j) || '|' AS line FROM g GROUP BY i) "
    f"SELECT string_agg(line, '' ORDER BY i) AS map, {GRID.rows} AS rows, {GRID.cols} AS cols, {GRID.nodes} AS nodes, {GRID.rows * GRID.cols - GRID.nodes} AS missing, {GRID.short == 'col'} AS short_col FROM l"
)
_OVERLAP = """WITH o AS (SELECT i, j FROM range(2) a(i), range(2) b(j)), n AS (SELECT i, j FROM range(4) a(i), range(2) b(j)),
x AS (SELECT o.i AS old_i, o.j AS old_j, n.i AS new_i, n.j AS new_j, greatest(0, least((o.i + 1) / 2.0, (n.i + 1) / 4.0) - greatest(o.i / 2.0, n.i / 4.0)) * 1000 AS r, greatest(0, least((o.j + 1) / 2.0, (n.j + 1) / 2.0) - greatest(o.j / 2.0, n.j / 2.0)) * 600 AS s FROM o, n)
SELECT CAST(old_i AS INTEGER) AS old_i, CAST(old_j AS INTEGER) AS old_j, CAST(new_i AS INTEGER) AS new_i, CAST(new_j AS INTEGER) AS new_j, CAST(r AS DOUBLE) AS r_rows, CAST(s AS DOUBLE) AS s_rows, CAST(r + s AS DOUBLE) AS total FROM x"""

ORACLES = {
    "equi_join_self": _EQUI,
    "band_join": f"WITH li AS ({_L}) SELECT r.l_orderkey AS key, count(*) AS n_pairs, sum(s.l_quantity) AS sum_s_quantity FROM (SELECT * FROM li WHERE side = 'R') r JOIN (SELECT * FROM li WHERE side = 'S') s ON {_BAND_ON} GROUP BY 1",
    "band_join_filtered": _BAND_ROWS,
    "band_join_text": f"WITH li AS ({_L}) SELECT {_LINE('r')} || '|' || {_LINE('s')} AS joined {_BAND_F}",
    "ineq_join": f"WITH li AS ({_L}), k AS (SELECT l_orderkey AS key, CAST(count(*) FILTER (side = 'R') AS BIGINT) AS n_r, count(*) FILTER (side = 'S') AS n_s FROM li GROUP BY 1), c AS (SELECT key, n_r, CAST(coalesce(sum(n_s) OVER (ORDER BY key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_greater FROM k) SELECT * FROM c WHERE n_r > 0",
    "cust_order_counts": "SELECT c_custkey, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey",
    "cust_order_total": "SELECT count(*) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "node_load": f"WITH {_HIST} SELECT * FROM loads",
    "node_key_load": f"WITH {_HIST} SELECT * FROM hist",
    "key_side_load": f"WITH {_SKEWED} SELECT key, count(*) FILTER (side = 'R') AS n_r, count(*) FILTER (side = 'S') AS n_s FROM skewed GROUP BY key",
    "load_bounds": f"WITH {_HIST} SELECT * FROM lim",
    "load_bounds_band": f"WITH {_HIST} SELECT total, CAST(total // {NODES} AS BIGINT) AS bl, CAST(floor((total // {NODES}) * CAST(1.01 AS DOUBLE)) AS BIGINT) AS ul, total / {NODES} * CAST(1.1 AS DOUBLE) AS band_bl FROM lim",
    "overloaded_nodes": f"WITH {_HIST} SELECT task, load, load - bl AS excess FROM loads, lim WHERE load > ul",
    "migrate_volume": f"WITH {_HIST}, b AS (SELECT total / {NODES} * CAST(1.1 AS DOUBLE) AS b FROM lim) SELECT CAST(coalesce(sum(floor(load - b)), 0) AS BIGINT) AS migrate_count FROM loads, b WHERE load > b",
    "utility_rank": f"WITH {_HIST} SELECT key, max(count) AS mc, CAST(sum(count) AS BIGINT) AS load, max(count) / sum(count) AS utility FROM hist GROUP BY key",
    "plan_split_random": f"WITH {_RANDOM} SELECT * FROM plan",
    "plan_split_first": f"WITH {_FIRST} SELECT * FROM plan",
    "end_check_counts": f"WITH {_FIRST} SELECT to_task AS task, count(*) AS n FROM plan GROUP BY to_task",
    "load_after_plan": f"WITH {_AFTER} SELECT task, CAST(sum(count) AS BIGINT) AS load FROM after GROUP BY task",
    "route_table_after": f"WITH {_AFTER} SELECT * FROM routes",
    "route_table_size": f"WITH {_AFTER}, k AS (SELECT key, count(*) AS n FROM routes GROUP BY key) SELECT CAST(coalesce(sum(4 * (3 + 2 * (n - 1))), 0) AS BIGINT) AS bytes FROM k",
    "dest_pick": f"WITH {_CDF} SELECT * FROM picked",
    "route_equi": f"WITH {_CDF} SELECT * FROM sent",
    "broadcast_count": f"WITH {_CDF} SELECT task, count(*) AS n_messages FROM sent GROUP BY task",
    "equi_join_routed": f"WITH {_SKEWED} {_PAIRS}",
    "band_fanout": f"SELECT CAST(k % {NODES} AS INTEGER) AS task, count(*) AS n_probes FROM (SELECT unnest(range(greatest(l_orderkey - {BAND}, 0), l_orderkey + {BAND + 1})) AS k FROM lineitem) GROUP BY 1",
    "migration_quota": f"WITH {_QUOTA} SELECT * FROM quota",
    "migrated_rows": _migrated(", ".join(_ORDER)),
    "migrated_rows_newest": _migrated(", ".join(f"{c} DESC" for c in _ORDER)),
    "moved_per_task": f"WITH {_FIRST} SELECT CAST(1 AS INTEGER) AS epoch, to_task AS task, CAST(sum(count) AS BIGINT) AS n_rows FROM plan GROUP BY to_task",
    "plan_quick": f"WITH {_QUICK} SELECT * FROM plan",
    "plan_band": f"WITH {_BANDED} SELECT * FROM plan",
    "plan_boundary_split": f"WITH {_SECOND} SELECT * FROM plan2",
    "routes_by_epoch": f"WITH {_SECOND} SELECT * FROM log",
    "dest_pick_by_epoch": _PICKED2,
    "route_table_text": f"WITH {_AFTER} SELECT key, {_LINE_TEXT} AS line FROM routes GROUP BY key",
    "route_table_file": f"WITH {_AFTER} SELECT key, task, count FROM routes",
    "load_report": f"WITH {_HIST} SELECT task, 'taskIndex = ' || task || ' , load = ' || load AS line FROM loads UNION ALL SELECT task, 'key = ' || key || ' , count = ' || count FROM hist",
    "control_metrics": _METRICS,
    "band_route": _BAND_ROUTE,
    "direct_grouping": f"WITH {_SKEWED} SELECT task, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_parts, task AS part FROM skewed GROUP BY task",
    "merge_by_id": _MERGED,
    "matrix_size_tables": f"WITH {_sizes(_COUNTED.format(NODE_ROWS))} {_SIZE_ROWS}",
    "matrix_trigger": _TRIGGERED,
    "matrix_mig_volume": _VOLUME,
    "matrix_after_change": _CHANGED_CELLS,
    "matrix_join_after_change": "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "grid_map_text": _MAP,
    "stream_grid_assign": _GRID_R,
    "stream_key_side_load": f"WITH {_SKEWED} SELECT key, count(*) FILTER (side = 'R') AS n_r, count(*) FILTER (side = 'S') AS n_s FROM skewed GROUP BY key",
    "stream_rebalance": f"WITH {_AFTER} SELECT key, task, count FROM routes",
    "consistent_hash_ring": _ring_sql(5),
    "consistent_hash_plain": _ring_sql(0),
    "equi_join_after_migration": f"WITH {_SKEWED} {_PAIRS}",
    "matrix_size": _SIZE,
    "grid_assign": _GRID_R,
    "matrix_join_equi": "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "matrix_join_theta": "SELECT o_orderkey, o_custkey, c_custkey FROM orders JOIN customer ON abs(o_custkey - c_custkey) <= 1 AND o_totalprice > c_acctbal",
    "matrix_load": f"WITH b AS (SELECT node, 1 AS r, 0 AS s FROM ({_GRID_R}) UNION ALL SELECT node, 0, 1 FROM ({_GRID_S})) SELECT node, CAST(sum(r) AS BIGINT) AS n_r, CAST(sum(s) AS BIGINT) AS n_s FROM b GROUP BY node",
    "matrix_cell_overlap": _OVERLAP,
    "free_nodes": f"SELECT CAST(n AS INTEGER) AS node FROM range(40) t(n) WHERE n >= {GRID.nodes}",
    "grid_codec": "WITH r AS (SELECT i - 1 AS i, string_split(string_split('0 1 2|3 4 5|6 7 -1|8 9 -1', '|')[i], ' ') AS c FROM range(1, 5) t(i)), x AS (SELECT i, j - 1 AS j, CAST(c[j] AS INTEGER) AS node FROM r, range(1, 4) u(j)) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, node FROM x WHERE node >= 0",
    "stream_equi_join": _EQUI,
    "stream_band_join": _BAND_ROWS,
    "stream_node_load": f"SELECT CAST(user_id % {NODES} AS INTEGER) AS task, count(*) AS load FROM events GROUP BY 1",
    "zipf_counts": "WITH s AS (SELECT i AS rank, 1 / pow(CAST(i AS DOUBLE), 0.5) AS w FROM range(1, 151) t(i)) SELECT rank, CAST(floor(w / (SELECT sum(w) FROM s) * 480000) AS BIGINT) AS count FROM s",
    "pipe_roundtrip": "SELECT o_orderkey, concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) AS line, o_custkey AS custkey, o_orderpriority AS priority, CAST(4 AS INTEGER) AS n_fields FROM orders",
    "last_wins_by_key": "SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "key_ranges": f"SELECT c_custkey, CAST(c_custkey + {BAND} - greatest(c_custkey - {BAND}, 0) + 1 AS INTEGER) AS n_keys, greatest(c_custkey - {BAND}, 0) AS low, c_custkey + {BAND} AS high FROM customer",
}
