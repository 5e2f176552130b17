"""Codecs, hashing, sources and the batch joins on small rows with nulls."""

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.columns import fields, key_range, parse_pipe, round2, to_text
from evenkeel.functions.hashing import Ring, fnv32, ring_lookup
from evenkeel.operators import joins, migrate
from evenkeel.sources import files


def test_rounding_is_of_the_exact_binary_value():
    assert round2(2.675) == 2.67 and round2(0.125) == 0.13 and round2(1.005) == 1.0


def test_pipe_codec(spark):
    df = spark.createDataFrame([("1|a||",), ("",), ("2|b|c",)], "value string")
    assert [r[0] for r in df.select(fields(F.col("value"))).collect()] == [["1", "a"], [], ["2", "b", "c"]]
    typed = parse_pipe(df.where("value <> ''"), "k int, x string").collect()
    assert [(r.k, r.x) for r in typed] == [(1, "a"), (2, "b")]
    row = spark.createDataFrame([(1, None)], "a int, b string").select(to_text("a", "b").alias("t")).first()
    assert row["t"] == "1|"


def test_files(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|x|\n\n 2|y|\n1|z|\n")
    path = f"file://{tmp_path}/t.tbl"
    rows = files.read_pipe(spark, path, "k int, v string")
    assert rows.count() == 3
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    assert {r["k"]: r["v"] for r in files.last_by_key(numbered, "k", F.col("n")).collect()} == {1: "z", 2: "y"}
    (tmp_path / "k.txt").write_text("5\n5\n7\n")
    hist = files.read_key_histogram(spark, f"file://{tmp_path}/k.txt", 5)
    assert {(r["task"], r["key"], r["count"]) for r in hist.collect()} == {(0, 5, 2), (2, 7, 1)}


@pytest.mark.parametrize("skew,first,second,last,total", [(0.5, 20801, 14708, 1698, 479928), (1.0, 85849, 42924, 572, 479928)])
def test_zipf(spark, skew, first, second, last, total):
    got = [r["count"] for r in files.zipf_counts(spark, skew=skew).orderBy("rank").collect()]
    assert (got[0], got[1], got[-1], sum(got)) == (first, second, last, total)
    assert files.zipf_keys(spark, 10, 1000).count() == sum(r["count"] for r in files.zipf_counts(spark, 10, 1000).collect())


def test_ring(spark):
    ring = Ring(["a", "b", "c"])
    before = {k: ring.lookup(k) for k in map(str, range(200))}
    assert set(before.values()) == {"a", "b", "c"}
    ring.add("d")
    assert all(s == before[k] or s == "d" for k in before if (s := ring.lookup(k)))
    ring.remove("d")
    assert before == {k: ring.lookup(k) for k in before}
    top = max(ring.points)
    past = next(k for k in map(str, range(100_000)) if fnv32(k) > top)
    assert ring.lookup(past) == ring.points[min(ring.points)]
    keys = spark.createDataFrame([(k,) for k in before], "key string")
    assert {r["key"]: r["server"] for r in ring_lookup(keys, ring, "key").collect()} == before
    assert Ring(["x"], 0).lookup("anything") == "x"
    with pytest.raises(LookupError):
        Ring([]).lookup("x")


def test_band_join_of_odd_keys(spark):
    left = [None, -25, -1, 0, 3, 11, 11, 40]
    right = [None, -12, 0, 1, 10, 21, 22]
    r = spark.createDataFrame([(k,) for k in left], "a long")
    s = spark.createDataFrame([(k,) for k in right], "b long")
    got = sorted(tuple(x) for x in joins.band_join(r, s, "a", "b", 10).collect())
    assert got == sorted((a, b) for a in left for b in right if None not in (a, b) and abs(a - b) <= 10)


def test_inequality_counts(spark):
    left, right = [1, 1, 5, 9, None], [0, 5, 6, 6, 20, None]
    r = spark.createDataFrame([(k,) for k in left], "key long")
    s = spark.createDataFrame([(k,) for k in right], "key long")
    got = {(x["key"], x["n_r"], x["n_greater"]) for x in joins.inequality_counts(r, s, "key", 4).collect()}
    assert got == {(1, 2, 4), (5, 1, 3), (9, 1, 1)}


def test_position_slice(spark):
    rows = spark.range(10, 110).withColumn("x", F.lit(1))
    assert sorted(r["id"] for r in migrate.position_slice(rows, "id", 100, 0.25, 0.305).collect()) == [35, 36, 37, 38, 39]


def test_key_range(spark):
    assert spark.range(3, 4).select(key_range(F.col("id"), 5)).first()[0] == list(range(9))
