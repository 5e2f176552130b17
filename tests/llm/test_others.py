"""WARC archives, neighbours and the pipeline."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import ann, warc

PAGES = "page_id long, url string, html string, digest string, first long"


@pytest.fixture(scope="module")
def pages(spark):
    big, mid = "é<p>" * 40, "z" * 100
    rows = [(9, "http://a\r\nX: y", big), (4, "u", big), (4, "u", big), (None, None, big), (7, None, None), (8, "", ""), (1, "u", "z" * 99), (2, "u", "z" * 99), (3, "u", mid), (5, "v", mid), (None, "w", "q" * 300), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    return spark.createDataFrame([(*r, "d", 0) for r in rows], PAGES)


def test_warc_round_trip(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in rows:
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    expected = []
    for i, b in rows:
        ref = first.get(b)
        again = ref is not None and ref != i
        expected.append(repr((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ref if again else None)))
    assert sorted(repr(tuple(r)) for r in warc.warc_round_trip(pages).collect()) == sorted(expected)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=300), st.booleans()), max_size=5), st.data())
def test_reader_frames_records_and_sees_damage(items, data):
    raw = b"".join(warc.record_bytes(i, "u", p, 0, again) for i, (p, again) in enumerate(items))
    got = list(warc.read_records(io.BytesIO(raw)))
    assert [(r.payload_bytes, r.payload) for r in got] == [(len(p), b"" if again else p) for p, again in items]
    if raw:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(raw[: data.draw(st.integers(1, len(raw) - 1))]) if len(items) == 1 else io.BytesIO(raw[:-1])))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.data())
def test_reader_sees_flipped_bytes_and_false_digests(payload, data):
    """A byte flipped in the archive, in a payload under its digest, or in a digest: never another payload without an error."""
    raw = warc.record_bytes(1, "u", payload, None, False)
    at = data.draw(st.integers(0, len(raw) - 1))
    bent = raw[:at] + bytes([raw[at] ^ data.draw(st.integers(1, 255))]) + raw[at + 1 :]
    try:
        got = [r.payload for r in warc.read_records(io.BytesIO(bent))]
    except warc.WarcError:
        got = [payload]
    assert got == [payload]  # a flip in the member's own head, such as its time, changes nothing
    plain = zlib.decompress(raw, 31)
    body = plain.index(b"\r\n\r\n", plain.index(b"HTTP/1.1")) + 4
    spots = [body + data.draw(st.integers(0, len(payload) - 1)), plain.index(b"Block-Digest: sha256:") + 25, plain.index(b"Payload-Digest: sha256:") + 27]
    for spot in spots:
        other = bytes([plain[spot] ^ 1])
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(plain[:spot] + other + plain[spot + 1 :]))))


def test_revisits_name_the_record_they_refer_to():
    first, again = (next(warc.read_records(io.BytesIO(warc.record_bytes(i, "u", b"x" * 200, ref, ref is not None)))) for i, ref in ((3, None), (9, 3)))
    assert again.headers["warc-refers-to"] == first.headers["warc-record-id"] != again.headers["warc-record-id"]
    for bad in (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\n\r\n", b"no head"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in rows:
        if q % every == 0:
            s = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum()))
            out[q] = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != q][:k]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 0.0, 0.0]), (205, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (250, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in good + bad + good[:3]], "vec_id long, embedding array<float>, v int, part string")
    got = ann.nearest_neighbours(df, every=10)
    near = {}
    for r in got.orderBy("query_id", "rank").collect():
        near.setdefault(r.query_id, []).append(r.vec_id)
    f32 = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in good]
    assert near == brute(f32, 10, 5)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def clusters(n, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    return [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]


def recall(got, want, k=5):
    near = {}
    for r in got.collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(near[q]) == min(k, len(v)) for q, v in want.items())
    return sum(len(near[q] & set(v)) for q, v in want.items()) / sum(map(len, want.values()))


def test_recall_on_clusters(spark):
    rows = clusters(3000)
    want = brute([(i, np.array(v)) for i, v in rows], 50, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(ann.nearest_neighbours(df, parts=16, sample=1000), want) >= 0.9
    router = ann.learn(np.array([v for _, v in rows[:1000]]), 16)
    assert router.probes < 12


def test_parts_are_parted_again(spark, monkeypatch):
    """One network tells four parts apart here: each has a network of its own, and queries ask few of all cells."""
    rows = clusters(4000)
    want = brute([(i, np.array(v)) for i, v in rows], 50, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "MOST_PARTS", 4)
    reps = ann.materialise(df.selectExpr("array(vec_id) ids", "cast(embedding as array<double>) v"), "test")
    index, placed = ann.build_index(reps, 4000, None, 150, 800, 0.97, 5)
    cells = placed.groupBy("cell").count().collect()
    assert index.top.parts == 4 and len(index.below) >= 3 and len(cells) > 8 and sum(r["count"] for r in cells) == 4000
    asked = index.cells(ann.unit(np.array([v for _, v in rows])), True)[1]
    assert len(asked) / 4000 < 0.7 * len(cells)
    assert recall(ann.nearest_neighbours(df, rows_per_part=150, sample=800), want) >= 0.9


def test_parts_grow_with_the_rows():
    assert [ann.parts_for(n, 2048) for n in (0, 1, 2048, 2049, 10_256, 51_282, 10**9)] == [1, 1, 1, 2, 8, 32, 128]


def test_cells_with_too_few_rows_are_made_up_for(spark, monkeypatch):
    """Whatever a router asks, a query has k others as long as there are so many."""
    rows = clusters(600)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    learn = ann.learn

    def narrow(*args, **more):
        router = learn(*args, **more)
        router.probes = 1
        return router

    monkeypatch.setattr(ann, "learn", narrow)
    got = ann.nearest_neighbours(df, every=1, k=40, parts=32)
    per = got.groupBy("query_id").count().collect()
    assert len(per) == 600 and {r["count"] for r in per} == {40}


def test_router_of_odd_vectors(spark):
    """Over 128 distinct vectors, so that there are several parts, beside those that take no part."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(2000, [1e-160, 0.0, 1e-160, 0.0]), (2010, [1e30, 1e30, 0.0, 0.0])]
    bad = [(3000, None), (3010, []), (3020, [0.0] * 4), (3030, [1.0, None, 0.0, 0.0]), (3040, [float("nan"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (3050, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in good + bad + good[:3]], "vec_id long, embedding array<double>, v int, cell string, part int")
    got = ann.nearest_neighbours(df, every=10, parts=8)
    want = brute([(i, np.array(v) / np.abs(v).max()) for i, v in good], 10, 5)
    assert {r.query_id for r in got.collect()} == set(want) and recall(got, want) >= 0.9


def test_partition_is_balanced():
    x = ann.unit(np.random.default_rng(1).normal(size=(800, 8)))
    label = ann.balanced_partition(x, ann.neighbour_graph(x, 10), 8)
    size = np.bincount(label, minlength=8)
    assert size.min() > 0 and size.max() <= np.ceil(1.1 * 100)


def test_queries_are_registered():
    from evenkeel.llm.queries import QUERIES

    assert sorted(QUERIES) == sorted(["pipeline", *(q for n in range(1, 11) for q in QUERIES if q.startswith(f"op{n}_"))]) and len(QUERIES) == 11
