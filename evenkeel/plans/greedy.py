"""Planners that decide step by step, over a collected histogram of overloaded nodes and their keys (control state, not rows).

Histograms are ``{task: {key: count}}``; a plan is a list of (from_task, to_task, key, count).  Ids break ties in
ascending order, and rows are conserved: what finds no room stays where it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import node_load

Histogram = dict[int, dict[int, int]]
Plan = list[tuple[int, int, int, int]]
PLAN_DDL = "from_task int, to_task int, key long, count long"


def collect_histogram(hist: DataFrame, nodes: int, routed: DataFrame | None = None) -> tuple[Histogram, dict[int, int]]:
    """What the planners look at: keys of overloaded nodes and, of the others, those of `routed` (key); and the load of every node.

    No other key can move, so that what is collected is bounded by the keys of overloaded nodes and the routing table."""
    load = {r["task"]: r["load"] for r in node_load(hist, nodes).collect()}
    _, ul = _limits(load)
    part = hist.where(F.col("task").isin([t for t, n in load.items() if n > ul]))
    if routed is not None:
        part = part.unionByName(hist.join(routed.select("key").distinct(), "key", "left_semi").select(*hist.columns)).distinct()
    out: Histogram = {t: {} for t in load}
    for r in part.select("task", "key", "count").toLocalIterator():
        out[r["task"]][r["key"]] = r["count"]
    return out, load


def as_table(spark: SparkSession, plan: Plan) -> DataFrame:
    return spark.createDataFrame(plan, PLAN_DDL)


def subset_near(items: list[tuple[int, int]], goal: int, within: int) -> list[int]:
    """Keys of (key, count) pairs whose counts sum to at most `goal` and at least goal - within, as near to goal as can be;
    none if no subset does.  Sums are found by dynamic programming up to the goal: listed while they are few, as the bits
    of a number beyond, which is exact too and takes items * goal / 64 steps and some goal / 8 bytes for each halving of items."""
    if goal <= 0:
        return []
    items = [x for x in items if 0 < x[1] <= goal]
    reach: dict[int, tuple[int, int] | None] = {0: None}  # sum -> (sum before, position of the item)
    for i, (_, count) in enumerate(items):
        for total in sorted(reach, reverse=True):
            if total + count <= goal and total + count not in reach:
                reach[total + count] = (total, i)
        if goal in reach:
            break
        if len(reach) > max(1000, goal // 5000):  # from here on a number of that many bits is faster
            return _subset_by_bits(items, goal, within)
    best = max(reach)
    if best == 0 or best < goal - within:
        return []
    keys, at = [], best
    while (step := reach[at]) is not None:
        keys.append(items[step[1]][0])
        at = step[0]
    return keys[::-1]


def _reach(sums: int, items: list[tuple[int, int]], goal: int) -> int:
    """Bit s of the result: the items, or some of them, bring a sum in `sums` to s, up to the goal; stops when that is met."""
    mask = (1 << goal + 1) - 1
    for _, count in items:
        sums |= sums << count & mask
        if sums >> goal:
            break
    return sums


def _subset_by_bits(items: list[tuple[int, int]], goal: int, within: int) -> list[int]:
    best = _reach(1, items, goal).bit_length() - 1
    return _trace(1, items, best)[0] if best > 0 and best >= goal - within else []


def _trace(sums: int, items: list[tuple[int, int]], total: int) -> tuple[list[int], int]:
    """The keys that bring a sum in `sums` to `total`, each taken only if the items before do not reach it, and that sum."""
    sums &= (1 << total + 1) - 1
    if sums >> total:
        return [], total
    if len(items) == 1:
        return [items[0][0]], total - items[0][1]
    half = len(items) // 2
    late, at = _trace(_reach(sums, items[:half], total), items[half:], total)
    early, start = _trace(sums, items[:half], at)
    return early + late, start


class _State:
    def __init__(self, hist: Histogram, load: dict[int, int] | None = None):
        self.hist = {t: dict(sorted(k.items())) for t, k in sorted(hist.items())}
        self.load = {t: sum(k.values()) for t, k in self.hist.items()} if load is None else dict(sorted(load.items()))
        self.moves: dict[tuple[int, int, int], int] = defaultdict(int)

    def move(self, a: int, b: int, key: int, n: int) -> None:
        if n <= 0 or a == b:
            return
        self.hist[a][key] -= n
        if not self.hist[a][key]:
            del self.hist[a][key]
        self.hist[b][key] = self.hist[b].get(key, 0) + n
        self.load[a] -= n
        self.load[b] += n
        self.moves[a, b, key] += n

    def plan(self) -> Plan:
        return [(a, b, k, n) for (a, b, k), n in sorted(self.moves.items()) if n > 0]


def _limits(load: dict[int, int], theta: float = 0.01) -> tuple[int, int]:
    mean = sum(load.values()) // len(load) + 1
    return mean, int(mean * (1 + theta) + 1)


def split_last(hist: Histogram, routed: Iterable[int] = (), load: dict[int, int] | None = None, tolerance: int = 20, fit: int = 10) -> Plan:
    """Move whole keys where that is enough and split keys only for the rest.

    For each overloaded node: keys that a routing table already scatters go back to their hash owner or another
    replica, or a node with room, smallest first; then a subset of the other keys that meets the excess, exactly or within
    `tolerance`, is placed on the fullest nodes whose gap it meets within `fit`; what is still
    above the bound is split over the nodes in order.
    """
    s = _State(hist, load)
    bl, ul = _limits(s.load)
    scattered = set(routed)
    over = [t for t in s.load if s.load[t] > ul]
    for a in over:
        for key, n in sorted(((k, n) for k, n in s.hist[a].items() if k in scattered), key=lambda x: (x[1], x[0])):
            if s.load[a] - n < bl:
                break
            room = [t for t in s.load if t != a and s.load[t] + n <= bl]
            if room:
                owner = key % len(s.load)
                holders = [t for t in room if key in s.hist[t]]
                s.move(a, owner if owner in room else min(holders or room, key=lambda t: (s.load[t], t)), key, n)
    for a in over:
        whole = [(k, n) for k, n in s.hist[a].items() if k not in scattered]
        goal = s.load[a] - bl
        down, up = sorted(whole, key=lambda x: (-x[1], x[0])), sorted(whole, key=lambda x: (x[1], x[0]))
        chosen = next((c for within in (0, tolerance) for order in (down, up) if (c := subset_near(order, goal, within))), [])
        left = [(k, s.hist[a][k]) for k in chosen]
        for b in sorted((t for t in s.load if s.load[t] < bl), key=lambda t: (-s.load[t], t)):
            got = subset_near(left, bl - s.load[b], fit)
            for k in got:
                s.move(a, b, k, s.hist[a][k])
            left = [x for x in left if x[0] not in set(got)]
        for k, n in left:  # whole keys that meet no gap go where they still fit
            fits = [t for t in s.load if t != a and s.load[t] + n <= bl]
            if fits:
                s.move(a, min(fits, key=lambda t: (s.load[t], t)), k, n)
    _split(s, over, bl)
    return s.plan()


def _split(s: _State, over: Iterable[int], bl: int) -> None:
    """Fill nodes in order with parts of keys until each donor is at the bound or no node has room."""
    for a in over:
        for key in sorted(s.hist[a]):
            for b in sorted(s.load):
                room = min(s.load[a] - bl, s.hist[a].get(key, 0), bl - s.load[b])
                if b != a and room > 0:
                    s.move(a, b, key, room)


def first_fit(hist: Histogram, routed: Iterable[int] = (), load: dict[int, int] | None = None) -> Plan:
    """Like split_last without subset search: whole keys, routed ones first, to the first node with room; then splits.
    A remainder under a thousandth of the bound stays."""
    s = _State(hist, load)
    bl, ul = _limits(s.load)
    scattered = set(routed)
    over = [t for t in s.load if s.load[t] > ul]
    for a in over:
        for key in sorted(s.hist[a], key=lambda k: (k not in scattered, k)):
            n = s.hist[a][key]
            if s.load[a] - n >= bl:
                fits = [t for t in sorted(s.load) if t != a and s.load[t] + n <= bl]
                if fits:
                    s.move(a, fits[0], key, n)
    _split(s, [a for a in over if s.load[a] - bl >= bl / 1000], bl)
    return s.plan()


PLANNERS = {"last": split_last, "fit": first_fit}


def after(hist: Histogram, plan: Plan) -> Histogram:
    s = _State(hist)
    for a, b, k, n in plan:
        s.move(a, b, k, n)
    return s.hist
