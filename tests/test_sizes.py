"""What queries do with larger and with odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import grid as gridop
from evenkeel.operators.joins import grid_join
from evenkeel.plans.grid import Grid, grid_for, grid_within
from evenkeel.queries import MOST_NODES, NODE_ROWS, ORACLES, QUERIES
from evenkeel.streaming.joins import drain_updates, stream_key_sides

SF = "/root/testdata/sf0.001"


def odd_tables(spark, folder) -> str:
    """Orders and customers that need a grid of many nodes: a common customer, nulls, negative and unmatched keys."""
    orders = spark.range(9000).selectExpr(
        "if(id % 500 = 3, null, id * 7 - 90) as o_orderkey", "case when id % 3 = 0 then 5 when id % 50 = 1 then null else pmod(id * 31, 5000) - 60 end as o_custkey", "'O' as o_orderstatus",
        "if(id % 40 = 7, null, double(id % 900)) as o_totalprice", "timestamp_ntz'1998-01-01' as o_orderdate", "'1' as o_orderpriority",
    )
    customer = spark.range(5000).selectExpr("if(id % 100 = 9, null, id - 40) as c_custkey", "concat('c', id) as c_name", "1 as c_nationkey", "if(id % 30 = 2, null, double(id % 700)) as c_acctbal", "'x' as c_mktsegment")
    for name, df in (("orders", orders), ("customer", customer)):
        df.write.parquet(f"file://{folder}/{name}.parquet")
    return str(folder)


def test_nodes_by_arithmetic():
    for grid in (Grid(1, 1), Grid(4, 3, "col", 2), Grid(4, 3, "row", 1), Grid(4, 3), Grid(76, 1, "col", 38), Grid(2, 3, "row", 9)):
        assert grid.nodes == len(grid.cells())


def test_copies_grow_as_the_rows():
    """The nodes for a fixed number of rows are as many as the product of the relations asks for; a bound keeps the copies in proportion."""
    for n in (1, 10, 100, 1000, 10000):
        r, s = 15_000 * n, 1_500 * n
        grid = grid_within(r, s, NODE_ROWS, MOST_NODES)
        assert grid.nodes <= MOST_NODES and r * grid.cols + s * grid.rows <= 5 * (r + s)
    assert grid_within(15_000, 1_500, NODE_ROWS, MOST_NODES) == grid_for(15_000, 1_500, NODE_ROWS)
    assert grid_within(0, 0, NODE_ROWS, MOST_NODES).nodes == 1


@pytest.mark.parametrize("name", ["matrix_join_equi", "matrix_join_theta", "matrix_join_after_change"])
def test_copies_are_not_broadcast(spark, name):
    """The copies that cells hold are many times what the planner takes them for."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "node#" in x and "Join" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


@pytest.mark.parametrize("name", ["matrix_join_equi", "matrix_join_theta"])
def test_matrix_joins_of_odd_tables(spark, tmp_path, name):
    folder = odd_tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert len(want) > 3000 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("width", [0, 1, 3, 10])
def test_rows_of_a_cell_meet_by_ranges_of_keys(spark, width):
    """The pairs of the join that holds all rows of a cell against each other, without holding far rows against each other."""
    keys = [*range(-70, 70, 1), 2**61, 2**61 + 1, 2**61 + 5, None, 7, 7, 7]
    r, s = (spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{x}_key long, {x} int") for x in "rs")
    grid = Grid(3, 2, "col", 2)
    left, right = gridop.assign(r, grid, "R", F.col("r")), gridop.assign(s, grid, "S", F.col("s"))
    close = F.abs(F.col("r_key") - F.col("s_key")) <= width
    met = grid_join(left, right, close, ("r_key", "s_key", width))
    got = sorted((x.r, x.s) for x in met.collect())
    assert met.columns == ["r_key", "r", "s_key", "s"]
    assert got == sorted((i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if a is not None and b is not None and abs(a - b) <= width)
    every = grid_join(left, right, F.lit(True), ("r_key", "s_key", width)).count()  # pairs that are held against each other
    assert every < len(keys) * (24 * width + 8)


def test_matrix_join_theta_holds_near_keys_against_each_other(spark):
    plan = QUERIES["matrix_join_theta"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [node#" in x]
    assert joins and all("_range#" in x.split("]")[0] for x in joins)


def test_stream_counts_before_it_shuffles(spark, tmp_path):
    """A key that has nearly all rows is shuffled as its counts; nulls are a key, and a row without a side is S."""
    rows = spark.range(20_000, numPartitions=4).selectExpr("case when id % 100 < 98 then 0 when id % 100 = 98 then null else id % 7 end as key", "case id % 3 when 0 then 'R' when 1 then 'S' end as side")
    for n in range(2):
        rows.write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"file://{tmp_path}/in")
    want = {(r.key, 2 * r.n_r, 2 * (r.n - r.n_r)) for r in rows.groupBy("key").agg(F.count_if(F.col("side") == "R").alias("n_r"), F.count("*").alias("n")).collect()}
    assert {tuple(r) for r in drain_updates(stream_key_sides(stream), "sides", "key").collect()} == want and len(want) == 8

    q = stream_key_sides(stream).writeStream.outputMode("update").format("memory").queryName("sides_plan").trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.streamingQuery().lastExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(key", 1)
    assert "HashAggregate(keys=[key" in below and "Python" not in plan and "Pandas" not in plan
