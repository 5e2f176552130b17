"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts with few edges between them, and a small
network learns the part of a vector from the parts of its neighbours.  The network then places every
row of the table in its most probable part and routes a query to its several most probable parts, where
all rows are ranked by their exact cosine.  How many parts are asked is measured on the sample.

There are as many parts as the rows need at `rows_per_part` each.  What one network cannot part so finely is parted again:
each large part has a network of its own, learned by an executor from a bounded sample of its rows.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: Candidate vectors that a task holds at once.
CHUNK = 8192
#: Parts that one network tells apart at most.
MOST_PARTS = 128


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Positions of the k nearest others of each unit vector."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a : a + block]
        out[a : a + block] = top
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: halves along the widest direction, then moves
    of vertices to the part most of their neighbours are in, while there is room."""
    label = np.zeros(len(x), dtype=np.int64)
    count = 1
    while count < parts:
        nxt = label * 2
        for p in range(count):
            at = np.flatnonzero(label == p)
            if len(at) < 2:
                continue
            y = x[at] - x[at].mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ axis, kind="stable")
            nxt[at[order[len(at) // 2 :]]] += 1
        label, count = nxt, count * 2
    n, room = len(x), int(np.ceil(slack * len(x) / count))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((n, count), dtype=np.int32)
        np.add.at(votes, (both[:, 0], label[both[:, 1]]), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=count)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[want[v]] < room:
                size[want[v]] += 1
                size[label[v]] -= 1
                label[v] = want[v]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """One hidden layer and a probability for each part; `probes` parts are asked for a query."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 7) -> Router:
    """Fit to the distribution over parts of each vector by cross entropy, with Adam."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= 0.003 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, probes=1)


def learn(sample: np.ndarray, parts: int, k: int = 10, recall: float = 0.97, nearest: int = 5) -> Router:
    """Graph, partition and network of a sample, and the fewest parts to ask for that recall on it.

    A part has four vectors of the sample at least, so that a small sample has fewer parts, down to one."""
    x = unit(sample)
    while parts > 1 and len(x) < 4 * parts:
        parts //= 2
    if parts <= 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    label = balanced_partition(x, graph, parts)
    parts = int(label.max()) + 1
    # a third of the sample is routed without having been learned
    test = np.arange(len(x)) % 3 == 2
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1 / graph.shape[1])
    target = 0.7 * target + 0.3 * np.eye(parts)[label]
    router = train_router(x[~test], target[~test])
    order = np.argsort(-router.logits(x), axis=1)
    place, rank = order[:, 0], np.argsort(order, axis=1)
    asked = np.flatnonzero(test)
    nearest = min(nearest, len(x) - 1)
    need = np.empty((len(asked), nearest), dtype=np.int64)
    for i in range(0, len(asked), 512):
        at = asked[i : i + 512]
        sims = x[at] @ x.T
        sims[np.arange(len(at)), at] = -np.inf
        near = np.argpartition(-sims, nearest - 1, axis=1)[:, :nearest]
        need[i : i + 512] = rank[at][np.arange(len(at))[:, None], place[near]]
    router.probes = next((n for n in range(1, parts) if (need < n).mean() >= recall), parts)
    return router


@dataclass
class Index:
    """A router, and those of the parts that are parted again.  A cell is a part, or a part of a part."""

    top: Router
    below: dict[int, Router]

    def cells(self, x: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of unit vectors: their most probable cell each, or all that a query asks."""
        k = self.top.probes if probes else 1
        order = np.argsort(-self.top.logits(x), axis=1, kind="stable")[:, :k]
        rows, parts = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
        out_r, out_c = [], []
        for p in np.unique(parts):
            at = rows[parts == p]
            if (router := self.below.get(int(p))) is None:
                out_r.append(at)
                out_c.append(np.full(len(at), p * MOST_PARTS))
            else:
                near = np.argsort(-router.logits(x[at]), axis=1, kind="stable")[:, : router.probes if probes else 1]
                out_r.append(np.repeat(at, near.shape[1]))
                out_c.append((p * MOST_PARTS + near).ravel())
        rows, cells = np.concatenate(out_r), np.concatenate(out_c)
        order = np.lexsort((cells, rows))
        return rows[order], cells[order]


def parts_for(rows: int, rows_per_part: int) -> int:
    """A power of two, so that a part has `rows_per_part` rows at most if one network can tell so many apart."""
    return min(MOST_PARTS, 1 << max(0, math.ceil(math.log2(max(1, rows / rows_per_part)))))


def _learn_below(placed: DataFrame, sizes: dict[int, int], rows_per_part: int, sample: int, k: int, recall: float) -> dict[int, Router]:
    """Routers of the parts with more than twice the rows that a part should have, each learned by an executor from some `sample`
    of its vectors, those with the smallest hashes.  They are as many as parts at most, and of a fixed size each."""
    big = {p: n for p, n in sizes.items() if n > 2 * rows_per_part}
    if not big:
        return {}
    share = F.create_map(*[c for p, n in big.items() for c in (F.lit(p), F.lit(min(1.0, sample / n)))])
    small = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < F.lit(1 << 30) * F.try_element_at(share, F.col("part"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        router = learn(np.array(frame["v"].tolist()), parts_for(big[part], rows_per_part), recall=recall, nearest=k)
        return pd.DataFrame({"part": [part], "router": [pickle.dumps(router)]})

    found = placed.where(F.col("part").isin(list(big)) & small).groupBy("part").applyInPandas(run, "part int, router binary")
    return {r["part"]: pickle.loads(bytes(r["router"])) for r in found.collect()}


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as doubles; repeated rows once."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good) & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _router_pass(shared, probes: bool):
    """Add cells (a list: those that a query asks, or the most probable one) to batches whose last column is v."""

    def run(batches):
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                rows, cells = index.cells(unit(_matrix(batch.column(batch.num_columns - 1))), probes)
                ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cells"])

    return run


def _cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, on the original vectors unless their squares leave the range."""
    a, b = (q * q).sum(axis=1), (c * c).sum(axis=1)
    out = (q * c).sum(axis=1) / (np.sqrt(a) * np.sqrt(b))
    odd = ~((a > 1e-280) & (a < 1e280) & (b > 1e-280) & (b < 1e280))
    if odd.any():
        out[odd] = (unit(q[odd]) * unit(c[odd])).sum(axis=1)
    return out


def _ranker(top: int):
    """Rows (cell, chunk, kind, key, ids, v) sorted by the first three: candidates are held, queries go through."""
    schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def settle(cand, queries):
        if not cand or not queries:
            return
        c = np.array([x[1] for x in cand])
        uc = unit(c)
        for i in range(0, len(queries), 512):
            q = np.array([x[1] for x in queries[i : i + 512]])
            s = unit(q) @ uc.T
            k = min(top + 6, s.shape[1])
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            # whatever ties with the last of these is weighed too
            edge = np.take_along_axis(s, near, 1).min(axis=1)
            out = []
            for r in range(len(q)):
                at = np.flatnonzero(s[r] >= edge[r] - 1e-12)
                score = _cosines(np.repeat(q[r : r + 1], len(at), axis=0), c[at])
                best = sorted((-sc, vec) for sc, j in zip(score.tolist(), at.tolist(), strict=True) for vec in cand[j][0])[:top]
                out += [(queries[i + r][0], vec, -sc) for sc, vec in best]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        at, cand, queries = None, [], []
        for batch in batches:
            for cell, chunk, kind, key, ids, v in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (cell, chunk) != at:
                    yield from settle(cand, queries)
                    at, cand, queries = (cell, chunk), [], []
                if kind == 0:
                    cand.append((ids, v))
                else:
                    queries.append((key, v))
                    if len(queries) == 2048:
                        yield from settle(cand, queries)
                        queries = []
        yield from settle(cand, queries)

    return run


def build_index(reps: DataFrame, rows: int, parts: int | None, rows_per_part: int, sample: int, recall: float, k: int) -> tuple[Index, DataFrame]:
    """The index of distinct vectors (ids, v), learned from `sample` of them, and the vectors with their cell."""
    spark = reps.sparkSession
    seen = reps.orderBy(F.xxhash64("v"), "ids").limit(sample).select("v").collect()
    index = Index(learn(np.array([r["v"] for r in seen]), parts or parts_for(rows, rows_per_part), recall=recall, nearest=k), {})
    one = lambda shared: reps.mapInArrow(_router_pass(shared, False), "ids array<long>, v array<double>, cells array<int>").select(F.col("cells")[0].alias("cell"), "ids", "v")
    placed = materialise(one(spark.sparkContext.broadcast(index)), "ann_index")
    if parts is None and index.top.parts == MOST_PARTS:
        part = F.floor(F.col("cell") / MOST_PARTS).cast("int")
        sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # parts at most
        index.below = _learn_below(placed.withColumn("part", part).select("part", "v"), sizes, rows_per_part, sample, k, recall)
        if index.below:
            placed = materialise(one(spark.sparkContext.broadcast(index)), "ann_index")
    return index, placed


def _search(placed: DataFrame, routed: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """(key, vec_id, score): the `top` nearest of each query (key, v, cell) in each chunk of its cells."""
    cand = placed.join(chunks, "cell").select(
        "cell", F.pmod(F.xxhash64(F.col("ids")[0]), "chunks").cast("int").alias("chunk"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "ids", "v"
    )
    asked = routed.join(chunks, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "key", F.lit(None).cast("array<long>").alias("ids"), "v"
    )
    met = cand.unionByName(asked).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind")
    return met.mapInArrow(_ranker(top), "key long, vec_id long, score double")


def nearest_neighbours(
    rows: DataFrame, every: int = 50, k: int = 5, parts: int | None = None, rows_per_part: int = 2048, sample: int = 6000, recall: float = 0.97,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, its own row left out.

    Nearest by cosine, ties to the smaller id.  The partition is learned on the `sample` distinct vectors with the smallest
    hashes; every row is indexed.  Parts grow with the rows, unless set: a table of no more than `rows_per_part` distinct vectors is
    one part, and parts that are too large are parted again.  A query whose cells hold fewer than k others is asked of all cells.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id and
    vectors whose length isn't the most frequent one.  Equal vectors are ranked once, for their k + 1 smallest ids, repeated
    rows count once.  Only the id and vector columns are read, so that others may have any name; an empty table gives no rows.
    """
    spark = rows.sparkSession
    good = valid_vectors(rows, id_col, vec_col)
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], empty)
    good = good.where(F.size("v") == dims["d"])
    low = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    reps = good.withColumn("r", low).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    reps = materialise(reps.select("ids", "v"), "ann_vectors")
    total = reps.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    index, placed = build_index(reps, total["n"], parts, rows_per_part, sample, recall, k)
    # a cell of many rows is ranked in several chunks; one row for each cell
    chunks = placed.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = materialise(chunks, "ann_cells")
    queries = good.where(F.col("vec_id") % every == 0)
    asked = materialise(queries.groupBy("v").agg(F.min("vec_id").alias("key")), "ann_asked")
    routed = asked.select("key", "v").mapInArrow(_router_pass(spark.sparkContext.broadcast(index), True), "key long, v array<double>, cells array<int>")
    found = materialise(_search(placed, routed.select("key", "v", F.explode("cells").alias("cell")), chunks, k + 1), "ann_found")
    enough = found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, total["ids"])).select("key")
    short = materialise(asked.join(enough, "key", "left_anti"), "ann_short")
    if not short.isEmpty():
        every_cell = F.explode(F.lit([r["cell"] for r in chunks.collect()]))  # some thousand numbers at most
        found = found.join(enough, "key", "left_semi").unionByName(_search(placed, short.select("key", "v", every_cell.alias("cell")), chunks, k + 1))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    best = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    names = queries.select(F.col("vec_id").alias("query_id"), F.col("v")).distinct().join(asked, "v").select("query_id", "key")
    out = names.join(best, "key").select(
        "query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x")
    )
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
