"""Operators on texts against brute force over odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm import byte_bpe, language_id, licenses, ngram_join, packing, quality_rules, substring_dedup, token_store
from evenkeel.llm._tokens import TextEncoder

from .conftest import rows_of

WORD_BPE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def words(text):
    return (text or "").encode().split()


def ids_of(text):
    return np.array([*WORD_BPE.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128


def test_ngram_join(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    sets = [shingles(t) for _, t in docs]
    link = lambda a, b: a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    n, expected = len(docs), []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            new = [b for b in range(n) if b not in seen and link(x, b)]
            seen |= set(new)
            todo += new
        known = [docs[b][0] for b in seen if docs[b][0] is not None]
        expected.append(repr((docs[a][0], min(known, default=None), sum(bool(link(a, b)) for b in range(n)))))
    assert rows_of(ngram_join.ngram_jaccard_join(odd_docs), "doc_id", "class_id", "n_links") == sorted(expected)


def test_ngram_join_of_a_large_group(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(300)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [shingles(t) for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert {r.class_id for r in got} == {0} and [r.n_links for r in sorted(got, key=lambda r: r.doc_id)] == want


@pytest.mark.parametrize("docs,size", [(1, 1 << 30), (3, 1 << 30), (40, 500)])
def test_ngram_join_in_blocks_and_by_bands(spark, monkeypatch, docs, size):
    """A chain of texts that each resemble the next ones alone, a family of near copies, and pairs: verified by block and by band."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", size)
    chain = [" ".join(f"c{j}" for j in range(12 * i, 12 * i + 300)) for i in range(40)]
    base = [f"w{i}" for i in range(300)]
    family = [" ".join([*base[: 9 * i], f"x{i}", *base[9 * i + 1 :]]) for i in range(30)]
    rows = list(enumerate(chain + family + [f"{t} end" for t in family[:5]] + chain[:3]))
    got = sorted(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    sets = [shingles(t) for _, t in rows]
    assert [r.n_links for r in got] == [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert {r.class_id for r in got} == {0, 40}


def test_stages_stand_any_column_name(spark, odd_docs):
    """Extra columns with the names of outputs and helpers, and with odd characters."""
    names = ["score", "lang_pred", "k_id", "row", "rep", "m_fp", "stays", "id", "words", "cls", "class_id", "n_links", "start", "mask", "spans", "kept_text", "n_removed",
             "n_words", "n_repeat_words", "base_failed", "rule", "kept", "_t", "_w", "t", "k1", "k2", "text_", "a b", "c.d", "e`f", "batch_id", "offset"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    labels = spark.createDataFrame([(5, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    for stage in (language_id.language_stage, lambda d: quality_rules.quality_stage(d, labels), ngram_join.near_duplicate_stage, substring_dedup.substring_dedup_stage):
        out, none = stage(docs), stage(docs.where(F.lit(False)))
        assert out.columns == docs.columns
        assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
        assert none.columns == docs.columns and none.collect() == []
    assert packing.pack(docs).count() == packing.pack(odd_docs).count() and packing.pack(docs.where(F.lit(False))).collect() == []


def test_near_duplicate_stage(odd_docs):
    kept = ngram_join.near_duplicate_stage(odd_docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd_docs.columns and ids[5] == 2 and ids[6] == ids[7] == ids[8] == 0 and ids[0] == ids[1] == 1


def windows(docs, width):
    return Counter(tuple(w[i : i + width]) for _, t in docs for w in [words(t)] for i in range(len(w) - width + 1))


@pytest.mark.parametrize("batches,most", [(1, None), (2, None), (5, None), (3, 1), (5, 2)])
def test_substring_dedup(odd_docs, batches, most):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    count, expected = windows(docs, 35), []
    for i, t in docs:
        w = words(t)
        gone = {j + k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append(repr((i, len(w), len(gone), hashlib.sha256(kept).hexdigest())))
    got = substring_dedup.substring_digest(substring_dedup.substring_dedup(odd_docs, batches=batches, most=most))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected)


SPAN = ("mhash", "k1", "k2", "start", "cnt")


def texts_of(docs):
    return substring_dedup._keyed(docs, "doc_id", "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))


@pytest.mark.parametrize("most", [None, 1, 3])
def test_index_compacts_and_reopens(odd_docs, spark, tmp_path, most):
    """Four batches, each in another object of the same folder: the runs merge, and the matches are those of one batch."""
    texts = texts_of(odd_docs)
    seen = []
    for b in range(4):
        index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/log", 35, buckets=2, fanout=2, most=most)
        index.add(texts.where(f"pmod(k2, 4) = {b}"))
        seen.append([run.level for run in index.runs])
        index.close()
    assert seen == [[0], [1], [1, 0], [2]]
    index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/log", 99, buckets=7, most=most)
    assert (index.width, index.buckets, index.fanout) == (35, 2, 2) and len(index.adds) == 4
    assert bool(index.runs[0].hot) == (most == 1)
    whole = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/one", 35, buckets=2, most=10**9)
    whole.add(texts)
    assert rows_of(index.matches(), *SPAN) == rows_of(whole.matches(), *SPAN) != []
    assert rows_of(index.spans(index.runs[0]), *SPAN) == rows_of(whole.spans(whole.runs[0]), *SPAN)
    # a later batch meets the merged run, and only its keys are matched there
    more = spark.createDataFrame([(1, "new words here " + odd_docs.where("doc_id = 10").first().text)], "doc_id long, text string")
    got = index.add(texts_of(more))
    masks = {(r.k1, r.k2): r.spans for r in substring_dedup.repeated_spans(texts.unionByName(texts_of(more)), got.distinct(), 35).collect()}
    assert (more_key := tuple(texts_of(more).first())[:2]) in masks and len(masks) > 1 and more_key not in {tuple(r)[:2] for r in texts.collect()}


def test_compaction_merges_without_a_shuffle(odd_docs, spark, tmp_path):
    index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/log", 35, buckets=2, fanout=2)
    for b in range(2):
        index.add(texts_of(odd_docs).where(f"pmod(k2, 2) = {b}"))
    (run,) = index.runs
    assert run.level == 1 and len(list((tmp_path / "log" / run.name).glob("part-*.parquet"))) == 2
    assert [p.name for p in (tmp_path / "log").glob("run-*")] == [run.name]


def test_digests_take_all_words():
    words = [b"a", b"bc", b"", b"d" * 500, b"e"]
    raw = substring_dedup._digests(words, np.array([0, 1, 0]), np.array([2, 4, 5]))
    want = [hashlib.blake2b(b" ".join(words[a : a + n]), digest_size=16).digest() for a, n in ((0, 2), (1, 4), (0, 5))]
    assert raw == b"".join(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(9, 20))
def test_spans_cover_each_window_once(letters, width):
    v = np.array(letters, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
    key, start, count, _ = substring_dedup.spans_of(v, width)
    at = [int(s) + i for s, c in zip(start, count, strict=True) for i in range(c)]
    assert at == list(range(max(0, len(letters) - width + 1)))
    same = defaultdict(set)
    for k, s, c in zip(key.tolist(), start.tolist(), count.tolist(), strict=True):
        for i in range(s, s + c):
            same[tuple(letters[i : i + width])].add(k)
    assert all(len(x) == 1 for x in same.values())


def test_byte_bpe_over_many_rows_and_blocks(odd_docs):
    whole = {(r["doc_id"], bytes(r["ids"])) for r in byte_bpe.bpe_encode(odd_docs).collect()}
    docs = odd_docs.coalesce(1)
    for row_bytes, block_bytes in ((1, 1 << 30), (1500, 4000), (1, 1)):
        got = byte_bpe.bpe_encode(docs, decode=True, row_bytes=row_bytes, block_bytes=block_bytes).collect()
        assert len(got) == odd_docs.count() and {(r["doc_id"], bytes(r["ids"])) for r in got} == whole
        assert sorted(bytes(r["decoded"]) for r in got) == sorted((r["text"] or "").encode() for r in odd_docs.collect())


def test_byte_bpe(odd_docs):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in odd_docs.collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), "<u4")
        expected.append(repr((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())))
    assert rows_of(byte_bpe.bpe_digest(odd_docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_chunks_give_the_ids_of_the_whole(text):
    assert TextEncoder("word_bpe_49k.json").ids(text.encode("utf-8", "replace")).tolist() == WORD_BPE.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def test_library_is_asked_for_a_word_once(monkeypatch):
    monkeypatch.setattr(TextEncoder, "WORDS", 200)
    enc, asked, ids = TextEncoder("word_bpe_49k.json"), Counter(), TextEncoder._ids
    monkeypatch.setattr(enc, "_ids", lambda text, *own: asked.update(text.split()) or ids(enc, text, *own))
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    common = [name(i) for i in range(60)]
    marks = ["", ".", "***", "!!", ",&&&", "'\""]
    for turn in range(20):
        words = common + [name(1000 + 50 * turn + k) for k in range(50)]
        text = " ".join(w + marks[(i + turn) % 6] for i, w in enumerate(words))
        assert enc.ids(text.encode()).tolist() == WORD_BPE.encode(text, add_special_tokens=False).ids
    assert {asked[w] for w in common} == {1}  # the store has been full several times
    assert all(w.isalpha() or not any(map(str.isalpha, w)) for w in asked)  # letters and marks apart


def test_packing(odd_docs):
    pieces = packing.pack(odd_docs).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32 and 1 << p.bucket == p.length
    whole = Counter(ids_of(r.text).tobytes() for r in odd_docs.collect())
    built, at = Counter(), b""
    for p in pieces:  # pieces of a document are neighbours
        at = bytes(p.ids) if p.start == 0 else at + bytes(p.ids)
        if p.start + p.length == p.doc_tokens:
            built[at] += 1
    assert built == whole
    fill = Counter((p.bucket, p.batch_id) for p in pieces)
    assert all(n <= max(1, (1 << 16) >> b) for (b, _), n in fill.items())


def test_token_store(odd_docs):
    got = token_store.token_store_round_trip(odd_docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r in odd_docs.collect() for x in [ids_of(r.text)])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_store_sees_damage(odd_docs, spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    manifest = token_store.write_store(odd_docs, folder)
    assert token_store.read_store(spark, folder).count() == odd_docs.count()
    path = tmp_path / "store" / manifest["packs"][0]["path"]
    raw = bytearray(path.read_bytes())
    raw[-3] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="zstd|StoreError|root|decompress"):
        token_store.read_store(spark, folder).collect()


@given(st.lists(st.integers(0, 49407), max_size=3000), st.integers(1, 500))
@settings(max_examples=50, deadline=None)
def test_cuts_follow_content(ids, shift):
    ends = token_store.cut_points(np.array(ids, "<u4"))
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(ids)
    sizes = np.diff([0, *ends])
    assert all(s <= token_store.MOST for s in sizes) and all(s >= token_store.LEAST for s in sizes[:-1])


def plain_grams(text, bits=16):
    """Buckets of all n-grams of one to three characters, one by one."""
    codes, whole = [ord(c) for c in text.lower()], (1 << 32) - 1
    for order in (1, 2, 3):
        for i in range(len(codes) - order + 1):
            h = 0
            for c in codes[i : i + order]:
                h = (h ^ c) * 0x9E3779B1 & whole
                h ^= h >> 15
            yield ((h + order) * 0x85EBCA77 & whole) >> (32 - bits)


def test_language_by_a_plain_naive_bayes(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdé ", "bb": "bcdefß ", "cc": "cdefgж "}
    rows = [(i, lang, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(5, 120)))) for i in range(60) for lang in [rng.choice(sorted(letters))]]
    train_rows, asked = rows[:40], [t for _, _, t in rows[40:]] + ["b", "", None, "12", "日本 text", "bcd" * 400]
    model = language_id.train(spark.createDataFrame(train_rows, "key long, lang string, text string"))
    counts = {lang: Counter() for lang in letters}
    for _, lang, t in train_rows:
        counts[lang].update(plain_grams(t))
    logp = {lang: (lambda b, c=c, n=sum(c.values()) + 0.5 * (1 << 16): math.log((c[b] + 0.5) / n)) for lang, c in counts.items()}
    for t, name, score in zip(asked, *model.predict(asked), strict=True):
        if t is None or not any(map(str.isalpha, t)):
            assert (name, score) == ("und", 0.0)
            continue
        total = {lang: sum(map(f, plain_grams(t))) for lang, f in logp.items()}
        best = max(sorted(total), key=total.get)
        odds = 1 / sum(math.exp(x - total[best]) for x in total.values())
        assert name == best and abs(score - odds) < 1e-3


def test_language(odd_docs, spark):
    rows = [(i, t, lang, None, 1, "", "", 0, 0) for i in range(60) for lang, t in [("aa", "baba gagu bab"), ("bb", "zyx xyzzy wyx")][i % 2 :][:1]]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    model = language_id.train_on(docs)
    got = language_id.identify(docs.select("doc_id", "text"), model).collect()
    assert len(got) == docs.count()
    for r, (_, t) in zip(got, [(x.doc_id, x.text) for x in docs.collect()], strict=True):
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
    assert all(r.lang_pred == ("aa", "bb")[r.doc_id % 2] for r in got[-60:])
    long = "baba gagu " * 300_000
    assert model.predict([long]) [0] == ["aa"] and abs(language_id.gram_counts(long, 16).sum() - (3 * len(long) - 3)) == 0
    assert language_id.language_stage(docs).columns == docs.columns


def test_quality_statistics(odd_docs):
    got = quality_rules.quality_rules(odd_docs, [])
    expected = []
    for r in odd_docs.collect():
        w = [x.decode() for x in words(r.text)]
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        expected.append(repr((r.doc_id, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for x in w for ch in x), len(lines) - len(set(lines)), len(rep), failed, not failed)))
    assert rows_of(got, "doc_id", *quality_rules.BASE, "base_failed", "kept") == sorted(expected)


def test_rules_are_learned_and_hold():
    rng = np.random.default_rng(1)
    x = {f: rng.random(900) for f in quality_rules.FEATURES}
    bad = ((x["symbol_share"] > 0.7) & (x["upper_share"] <= 0.5)) | (x["dup_line_share"] > 0.9)
    held = np.arange(900) % 3 == 0
    rules = quality_rules.learn_rules(x, bad, held)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= r.holds(x)
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).mean() < 0.01


def test_quality_expression_is_native(odd_docs, spark):
    rule = quality_rules.Rule((quality_rules.Condition("symbol_share", True, 0.5), quality_rules.Condition("word_length", False, 3.0)))
    plan = quality_rules.quality_rules(odd_docs, [rule])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    labels = spark.createDataFrame([(None, 0), (3, None), (5, 1), (15, 0)], "doc_id long, quality int")
    assert quality_rules.quality_stage(odd_docs, labels).columns == odd_docs.columns
    assert quality_rules.fit(odd_docs, labels.limit(0)) == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in it. The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


def test_licences(spark):
    import duckdb

    rows = [(1, MIT), (2, "x.\nReleased under the MIT License."), (None, None), (3, ""), (4, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (5, "a license for nothing"), (5, "as, is; licens"), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "The permission, warranty and word of nothing.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df)
    assert {r.doc_id: r.licences for r in got.collect() if r.licences} == {1: "MIT", 2: "MIT", 4: "Apache-2.0,CC-BY-NC-4.0", 6: "GPL-3.0"}
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    assert rows_of(got, "doc_id", "n_hints", "sentence_ids", "licences") == sorted(map(repr, duckdb.sql(f"SELECT doc_id, n_hints, sentence_ids, licences FROM ({licenses.oracle()})").fetchall()))


@pytest.mark.parametrize("op", [
    ngram_join.ngram_jaccard_join, lambda d: substring_dedup.substring_digest(substring_dedup.substring_dedup(d)), byte_bpe.bpe_digest, packing.pack,
    token_store.token_store_round_trip, lambda d: language_id.identify(d.select("doc_id", "text"), language_id.train_on(d)),
    lambda d: quality_rules.quality_rules(d, []), licenses.scan_licenses, ngram_join.near_duplicate_stage, substring_dedup.substring_dedup_stage,
])
def test_empty_tables(no_docs, op):
    assert op(no_docs).count() == 0
