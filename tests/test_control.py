"""Hashes, codecs of the control plane, versions of the routing table, and the controller on a tick."""

import random

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.columns import dimension, grid_cells, grid_descriptor, grid_text, route_fields
from evenkeel.functions.hashing import Ring, fnv32, fnv32_column, ring_lookup
from evenkeel.operators import routing
from evenkeel.operators.joins import running_sum
from evenkeel.plans.grid import Grid
from evenkeel.session import conf_int, memory_info, parent_tasks
from evenkeel.sources import control, files
from evenkeel.streaming.joins import drain_updates, rebalance_each_batch, stream_key_sides


def test_hash_in_built_in_functions(spark):
    rng = random.Random(1)
    texts = ["", "a", "node-0&&VN1", "\U0001f600é", "x" * 300, *("".join(chr(rng.randrange(32, 0x3000)) for _ in range(rng.randrange(1, 30))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", fnv32_column(F.col("t")).alias("h"), fnv32_column(F.col("t"), True).alias("a"))
    got = {r.t: (r.h, r.a) for r in df.collect()}
    assert got.pop(None) == (None, None) and got == {t: (fnv32(t), fnv32(t, True)) for t in texts}


def test_ring_without_replicas(spark):
    ring = Ring(["a", "b", "c"], 0)
    assert set(ring.points) == {fnv32(x, True) for x in "abc"}
    keys = spark.createDataFrame([(str(k),) for k in range(50)], "key string")
    assert all(r.server == ring.lookup(r.key) for r in ring_lookup(keys, ring, "key").collect())


def test_grid_codecs(spark):
    df = spark.createDataFrame([("0 1 2 |3 -1 5 |", "2-3", "2 3 5 1 0")], "m string, d string, s string")
    row = df.select(grid_text(grid_cells(F.col("m")), F.lit(2), F.lit(3)).alias("m"), dimension(F.col("d")).alias("d"), grid_descriptor(F.col("s")).alias("s")).first()
    assert row.m == "0 1 2 |3 -1 5 |" and tuple(row.d) == (2, 3) and tuple(row.s) == (2, 3, 5, 1, False)


def test_route_text(spark, tmp_path):
    lines = ["key = 5 ,  [taskIndex = 1, count = 14764]   ", "key = 87 ,  [taskIndex = 4, count = 26459]    [taskIndex = 1, count = 42562]    [taskIndex = 3, count = 67713]   "]
    rows = [(5, 1, 14764), (87, 1, 42562), (87, 3, 67713), (87, 4, 26459)]
    routes = spark.createDataFrame(rows, control.ROUTES)
    assert [r.line for r in control.route_lines(routes).orderBy("key").collect()] == lines
    control.write_routes(routes, f"file://{tmp_path}/routes")
    assert sorted(map(tuple, control.read_routes(spark, f"file://{tmp_path}/routes").collect())) == rows
    assert spark.createDataFrame([("taskIndex = 1 , load = 3",)], "line string").select(route_fields(F.col("line")).alias("r")).first().r is None
    assert [r.fields for r in files.read_fields(spark, f"file://{tmp_path}/routes").collect()] == [[x.strip()] for x in lines]


def test_versions_of_the_routing_table(spark, tmp_path):
    log = control.RouteLog(spark, f"file://{tmp_path}/log")
    assert log.epochs() == [] and log.at(3).count() == 0
    one, two = spark.createDataFrame([(1, 0, 5)], control.ROUTES), spark.createDataFrame([(1, 1, 2), (1, 0, 3)], control.ROUTES)
    for epoch, routes in ((1, two), (1, one), (4, two), (6, two.limit(0))):
        log.publish(epoch, routes)
    assert log.epochs() == [1, 4, 6] and [log.at(e).count() for e in (0, 1, 3, 4, 5, 6)] == [0, 1, 1, 2, 2, 0]
    rows = spark.createDataFrame([(e, 1, s) for e in (1, 4) for s in range(5)], "epoch int, key long, s long")
    got = routing.pick(rows, log.history(), F.col("s"), 7, ("epoch", "key")).groupBy("epoch", "task").count()
    assert {tuple(r) for r in got.collect()} == {(1, 0, 5), (4, 0, 3), (4, 1, 2)}


def test_controller_plans_over_all_batches(spark, tmp_path):
    """Two files are two batches: the second plan takes in both, and the first epoch stays."""
    for n, keys in enumerate(([0] * 90 + [1] * 10, [1] * 200)):
        spark.createDataFrame([(k % 4, k) for k in keys], "task int, key long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    rows = spark.readStream.schema("task int, key long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    log = control.RouteLog(spark, f"file://{tmp_path}/log")
    rebalance_each_batch(rows, 4, "first", log)
    assert log.epochs() == [1, 2]
    last = {(r["key"], r["task"]): r["count"] for r in log.at(2).collect()}
    assert sum(last.values()) == 300 and max(sum(n for (_, t), n in last.items() if t == task) for task in range(4)) <= 77


def test_state_of_a_stream_over_batches(spark, tmp_path):
    for part in ([(1, "R"), (1, "S"), (2, "S")], [(1, "R"), (3, None)]):
        spark.createDataFrame(part, "key long, side string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    rows = spark.readStream.schema("key long, side string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = drain_updates(stream_key_sides(rows), "sides", "key")
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (2, 0, 1), (3, 0, 1)}


def test_loader_that_ends_at_a_blank_line(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|x|\n2|y|\n\n3|z|\n")
    path = f"file://{tmp_path}/t.tbl"
    assert [r.k for r in files.read_pipe(spark, path, "k int, v string", until_blank=True).collect()] == [1, 2]
    assert files.read_pipe(spark, path, "k int, v string").count() == 3
    assert files.read_pipe(spark, path, "k int, v string", most=2).count() == 2


def test_helpers_of_the_session(spark):
    assert conf_int(spark, "spark.sql.shuffle.partitions") == 4 and conf_int(spark, "spark.evenkeel.none", 7) == 7
    with pytest.raises(KeyError):
        conf_int(spark, "spark.evenkeel.none")
    assert parent_tasks({"source": 4, "router": 5}, "source", "router") == 9 and memory_info(spark)["total_mb"] > 0
    assert str(Grid(2, 3, "col", 1)) == "0 1 2\n3 4 ."


def test_rows_dealt_by_task_and_in_turn(spark):
    rows = spark.range(100).select((F.col("id") % 3).cast("int").alias("task"))
    parts = routing.by_task(rows, 3).select("task", F.spark_partition_id().alias("p")).distinct().collect()
    assert {tuple(r) for r in parts} == {(0, 0), (1, 1), (2, 2)}
    dealt = routing.deal(rows, 4).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and all(abs(r["count"] - 25) <= 2 for r in dealt)


def test_running_sums_at_every_level(spark):
    df = spark.range(0, 4000, 7).selectExpr("id - 900 as k", "id % 5 as v")
    want, total = {}, 0
    for r in df.orderBy("k").collect():
        want[r.k] = total
        total += r.v
    for bucket, levels in ((1000, 1), (10, 2), (6, 3)):
        assert {r.k: r.v_before for r in running_sum(df, "k", ["v"], bucket, levels).collect()} == want


def test_pairs_of_a_routed_join(spark):
    """Counts by key are those of the join that lists the pairs, and of the join without routing."""
    rows = spark.range(400).selectExpr("id % 3 as key", "id as seq", "if(id % 2 = 0, 'R', 'S') as side")
    routes = spark.createDataFrame([(0, 1, 20), (0, 2, 30), (0, 4, 84), (2, 0, 7)], control.ROUTES)
    r, s = rows.where("side = 'R'"), rows.where("side = 'S'")
    want = {x.key: x.n for x in r.join(s, "key").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert {x.key: x.n_pairs for x in routing.routed_pair_counts(r, s, routes, F.col("seq"), 5).collect()} == want
    left, right = r.select("key", "seq", F.col("seq").alias("a")), s.select("key", "seq", F.col("seq").alias("b"))
    listed = routing.routed_equi_join(left, right, routes, F.col("seq"), 5, ["key"])
    assert listed.count() == sum(want.values()) == listed.select("a", "b").distinct().count()
