"""Planners: conservation, bounds, goldens of the sizing formula, interval algebra."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.operators import grid as gridop
from evenkeel.operators import migrate, stats
from evenkeel.plans import greedy, prefix_sum
from evenkeel.plans.grid import Grid, change_grid, holdings, match_cells, pieces, size_grid
from evenkeel.plans.intervals import intersect, length, normalise, rescale, subtract

HISTS = st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 300), max_size=8), min_size=2, max_size=6).map(lambda x: dict(enumerate(x)))
loads = lambda h: {t: sum(k.values()) for t, k in h.items()}
keys = lambda h: sum((Counter(k) for k in h.values()), Counter())


@pytest.mark.parametrize("name", sorted(greedy.PLANNERS))
@settings(max_examples=150, deadline=None)
@given(hist=HISTS)
def test_greedy_conserves_rows(name, hist):
    plan = greedy.PLANNERS[name](hist)
    assert all(n > 0 and a != b for a, b, _, n in plan)
    after = greedy.after(hist, plan)
    assert keys(after) == keys(hist)
    assert max(loads(after).values()) <= max(loads(hist).values())
    if name == "last":
        bl = sum(loads(hist).values()) // len(hist) + 1
        assert max(loads(after).values()) <= int(bl * 1.01 + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=10), st.integers(0, 200), st.integers(0, 20))
def test_subset_is_as_near_as_can_be(counts, goal, within):
    items = list(enumerate(counts))
    got = greedy.subset_near(items, goal, within)
    sums = {0}
    for c in counts:
        sums |= {s + c for s in sums}
    best = max(s for s in sums if s <= goal)
    assert len(set(got)) == len(got)
    assert sum(counts[k] for k in got) == (best if best >= goal - within else 0)


HIST = [(0, 0, 900), (0, 1, 40), (1, 2, 700), (1, 3, 20), (2, 4, 30), (3, 5, 10)]


def step_by_step(hist, nodes, rule, routed=()):
    """The moves of a rule, one after the other."""
    load = {t: sum(n for a, _, n in hist if a == t) for t in range(nodes)}
    total = sum(load.values())
    target, trigger = total // nodes + 1, int((total // nodes + 1) * 1.01 + 1)
    if rule == "quick":
        target, trigger = total // nodes, int(total // nodes * 1.01)
    if rule == "band":
        target, trigger = int(total / nodes * 1.1), total / nodes * 1.1
    first, give = dict(load), []
    for a in range(nodes):
        if load[a] <= trigger:
            continue
        left, taken = load[a] - target, []
        order = {"first": lambda x: (-x[1], x[0]), "boundary": lambda x: (x[0] not in routed, x[0])}.get(rule, lambda x: x[0])
        for key, n in sorted(((k, n) for t, k, n in hist if t == a), key=order):
            if left > 0:
                taken.append((key, min(n, left)))
                left -= min(n, left)
        give += [(a, *x) for x in sorted(taken, key=lambda x: (rule == "boundary" and x[0] not in routed, x[0]))]
    moves = Counter()
    fill = sorted((t for t in load if first[t] < target), key=lambda t: (-first[t], t) if rule == "first" else t)
    for a, key, n in give:
        for b in fill:
            part = min(n, target - load[b])
            if part > 0:
                moves[a, b, key] += part
                load[b] += part
                n -= part
    return dict(moves)


@pytest.mark.parametrize("rule", prefix_sum.RULES)
def test_prefix_sum_plans_step_by_step(spark, rule):
    rng = random.Random(4)
    for nodes in (2, 3, 5, 8):
        hist = [(rng.randrange(nodes) // rng.choice((1, 2, 3)), k, rng.choice((1, 5, 40, 300))) for k in range(rng.randrange(4, 14))]
        routed = [k for _, k, _ in hist if rng.random() < 0.4]
        df = spark.createDataFrame(hist, "task int, key long, count long")
        known = spark.createDataFrame([(k,) for k in routed], "key long")
        got = {(m["from_task"], m["to_task"], m["key"]): m["count"] for m in prefix_sum.plan_moves(df, nodes, rule, known).collect()}
        assert got == step_by_step(hist, nodes, rule, routed)


@pytest.mark.parametrize("rule", prefix_sum.RULES)
def test_prefix_sum_plans_with_two_donors(spark, rule):
    hist = spark.createDataFrame(HIST, "task int, key long, count long")
    plan = prefix_sum.plan_moves(hist, 5, rule)
    moves = plan.collect()
    assert all(m["count"] > 0 and m["from_task"] != m["to_task"] for m in moves)
    after = prefix_sum.histogram_after(hist, plan)
    assert after.groupBy("key").sum("count").count() == 6
    load = {r["task"]: r["load"] for r in stats.node_load(after, 5).collect()}
    assert sum(load.values()) == 1700 and max(load.values()) <= (374 if rule == "band" else int(341 * 1.01 + 1))
    ends = {r["task"]: r["n"] for r in prefix_sum.end_checks(plan).collect()}
    assert ends == Counter(m["to_task"] for m in moves)


def test_greedy_reads_overloaded_nodes_and_routed_keys_alone(spark):
    hist = spark.createDataFrame(HIST, "task int, key long, count long")
    part, load = greedy.collect_histogram(hist, 5, spark.createDataFrame([(5,)], "key long"))
    assert part == {0: {0: 900, 1: 40}, 1: {2: 700, 3: 20}, 2: {}, 3: {5: 10}, 4: {}} and load == {0: 940, 1: 720, 2: 30, 3: 10, 4: 0}
    whole = {t: {k: n for a, k, n in HIST if a == t} for t in range(5)}
    for name, planner in greedy.PLANNERS.items():
        assert planner(part, [5], load) == planner(whole, [5]), name


def test_routed_keys_go_back_first():
    """A key that a routing table scattered returns to its hash owner, or else to another node that has it."""
    hist = {0: {5: 30, 7: 20, 1: 60}, 1: {5: 2}, 2: {7: 1}, 3: {}, 4: {}}
    moves = {(a, b, k): n for a, b, k, n in greedy.split_last(hist, [7, 5])}
    assert moves[0, 2, 7] == 20 and 7 % 5 == 2 and moves.get((0, 1, 5)) is None
    first = greedy.first_fit(hist, [5])
    assert any(k == 5 for *_, k, _ in [(a, b, k, n) for a, b, k, n in first])


def test_no_plan_for_balanced_or_empty_histograms(spark):
    even = spark.createDataFrame([(0, 1, 10), (1, 2, 10)], "task int, key long, count long")
    assert prefix_sum.plan_moves(even, 2).count() == 0
    assert prefix_sum.plan_moves(even.limit(0), 2).count() == 0


def test_migration_moves_what_the_plan_says(spark):
    rows = spark.range(60).selectExpr("id", "0 task", "cast(7 as bigint) key", "if(id % 3 = 0, 'R', 'S') side")
    plan = spark.createDataFrame([(0, 1, 7, 21), (0, 2, 7, 14)], "from_task int, to_task int, key long, count long")
    moved = migrate.migrate(rows, plan, ["id"])
    assert moved.count() == 60
    assert Counter(r["task"] for r in moved.collect()) == {0: 25, 1: 21, 2: 14}
    q = migrate.quotas(migrate.side_counts(rows), plan).first()
    assert q["quota_r"] + q["quota_s"] == 35 and q["quota_r"] == 17


def test_migration_of_the_newest_rows_in_small_buckets(spark):
    rows = spark.range(60).selectExpr("id", "0 task", "cast(7 as bigint) key", "if(id % 2 = 0, 'R', 'S') side")
    plan = spark.createDataFrame([(0, 1, 7, 9), (0, 2, 7, 6)], "from_task int, to_task int, key long, count long")
    for size in (1, 7, 1000):
        new = {r["id"] for r in migrate.migrate(rows, plan, ["id"], newest=True, size=size).where("task <> 0").collect()}
        old = {r["id"] for r in migrate.migrate(rows, plan, ["id"], size=size).where("task <> 0").collect()}
        assert old == {*range(0, 16, 2), *range(1, 15, 2)} and new == {*range(58, 42, -2), *range(59, 45, -2)}


def test_upsert_takes_the_last_of_each_id(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    got = migrate.upsert(make((1, "a"), (2, "a"), (3, "a")), make((2, "b"), (3, "b")), make((3, "c"), (4, "c")), "id")
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "c")}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10), st.integers(0, 10), st.integers(1, 20))
def test_quota_rule(r, s, count):
    if count > r + s:
        return
    half, small, large = count // 2, min(r, s), max(r, s)
    q = count - small if small < half else max(min(large, half + 1), count - small)
    assert 0 <= count - q <= small and q <= large


# R, S, V -> best case, rows, cols, short edge, cells on it, nodes
GOLDENS = {
    (20, 20, 250000): ("ru", 1, 1, "col", 1, 1), (100, 100, 100): ("ru", 2, 2, "col", 2, 4), (250, 90, 100): ("ru", 5, 2, "col", 5, 10),
    (90, 250, 100): ("ru", 2, 5, "col", 2, 10), (640, 320, 160): ("ru", 8, 4, "col", 8, 32), (640, 320, 170): ("ru", 8, 4, "col", 6, 30),
    (1000, 700, 300): ("sl", 8, 4, "row", 4, 32), (700, 1000, 300): ("rl", 4, 8, "col", 4, 32), (110000, 95000, 150000): ("ru", 2, 1, "col", 2, 2),
    (300000, 100000, 150000): ("su", 3, 2, "row", 2, 6), (400000, 150000, 150000): ("ru", 6, 2, "col", 5, 11),
}


@pytest.mark.parametrize("case", sorted(GOLDENS))
def test_grid_sizes(case):
    g = size_grid(*case)
    assert (g["case"], g["rows"], g["cols"], g["short"], g["last"], g["nodes"]) == GOLDENS[case]


PARTS = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)).map(lambda p: (min(p) / 20, max(p) / 20)), max_size=5)


@given(PARTS, PARTS)
def test_interval_algebra(x, y):
    assert abs(length(intersect(normalise(x), normalise(y))) + length(subtract(x, normalise(y))) - length(normalise(x))) < 1e-9


@pytest.mark.parametrize("old,new", [(Grid(2, 2), Grid(3, 3, "col", 2)), (Grid(4, 3, "col", 2), Grid(2, 2)), (Grid(1, 1), Grid(4, 6, "row", 2)), (Grid(3, 2), Grid(3, 2))])
def test_grid_change_gives_each_cell_its_part(old, new):
    plan = change_grid(old, new, 1000, 600)
    match, had, want = match_cells(old, new, 1000, 600), holdings(old), holdings(new)
    for cell, node in plan.nodes.items():
        for side in "RS":
            have = (had[match[cell]].r if side == "R" else had[match[cell]].s) if cell in match else []
            got = normalise(have + [(a, b) for _, to, s, a, b in plan.sends if to == node and s == side])
            left = subtract(got, [(a, b) for n, s, a, b in plan.discards if n == node and s == side])
            should = want[cell].r if side == "R" else want[cell].s
            assert abs(length(left) - length(should)) < 1e-9 and abs(length(intersect(left, should)) - length(should)) < 1e-9
    missing = len(range(new.last or new.rows, new.rows)) if new.short == "col" else len(range(new.last or new.cols, new.cols))
    assert abs(sum(b - a for *_, a, b in plan.special) - missing / (new.rows if new.short == "col" else new.cols)) < 1e-9


@pytest.mark.parametrize("grid", [Grid(1, 1), Grid(3, 4), Grid(4, 3, "col", 2), Grid(4, 3, "row", 1), Grid(2, 5, "row", 3), Grid(5, 1, "col", 2), Grid(1, 4, "row", 3), Grid(6, 7, "col", 5)])
def test_every_pair_meets_once(spark, grid):
    from pyspark.sql import functions as F

    rows = spark.range(40)
    r = gridop.assign(rows.withColumnRenamed("id", "r"), grid, "R", F.col("r")).drop("special")
    s = gridop.assign(rows.withColumnRenamed("id", "s"), grid, "S", F.col("s")).drop("special")
    met = r.join(s, "node").groupBy("r", "s").count()
    assert met.count() == 1600 and met.where("count <> 1").count() == 0


def test_rescale_to_what_a_node_holds():
    assert [tuple(round(v, 9) for v in p) for p in rescale([(0.1, 0.3), (0.4, 0.9)], 0.25, 0.5)] == [(0.0, 0.2), (0.6, 1.0)]


@pytest.mark.parametrize("old,new", [(Grid(2, 2), Grid(3, 3, "col", 2)), (Grid(4, 3, "col", 2), Grid(2, 2)), (Grid(1, 1), Grid(3, 4, "row", 2))])
def test_every_pair_meets_once_after_a_change(spark, old, new):
    rows = spark.range(37)
    held = pieces(old, change_grid(old, new, 37, 37), 37, 37)
    r = gridop.held_rows(gridop.with_position(rows.withColumnRenamed("id", "r"), "r"), held, "R").select("r", "node")
    s = gridop.held_rows(gridop.with_position(rows.withColumnRenamed("id", "s"), "s"), held, "S").select("s", "node")
    met = r.join(s, "node").groupBy("r", "s").count()
    assert met.count() == 37 * 37 and met.where("count <> 1").count() == 0
    assert gridop.held_rows(rows.withColumn("position", rows.id), [], "R").count() == 0
