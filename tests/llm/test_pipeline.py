"""Each stage of the corpus pipeline against a plain version of it, and the learned quality rules on real rows."""

import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import language_id, quality_rules

from .test_texts import ids_of, shingles, windows, words

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    chars, n = sum(map(len, w)), len(w)
    count = lambda chars: sum(c in chars for c in text)
    per = lambda a, b: a / max(b, 1)
    return {
        "symbol_share": per(count("#*$%&|<>"), chars), "upper_share": per(sum(unicodedata.category(c) == "Lu" for c in text), chars), "mark_share": per(count("!?"), chars),
        "digit_share": per(count("0123456789"), chars), "stop_rate": per(count(".,"), n), "word_length": per(chars, n),
        "dup_line_share": per(len(lines) - len(set(lines)), len(lines)), "repeat_share": per(len(repeated), n), "failed": n < 50 or 100 * len(repeated) > 50 * n,
    }


def plain_verdicts(docs, labels):
    """Ids kept: not failing the base limits, and no rule that the learner finds in plainly computed statistics."""
    stats = [(i, plain_statistics(t)) for i, t in docs]
    known = defaultdict(list)
    for i, q in labels:
        known[i].append(q)
    seen = sorted(((i, q, s) for i, s in stats for q in known.get(i, ()) if q is not None and not s["failed"]), key=lambda x: x[:2])
    x = {f: np.array([s[f] for *_, s in seen]) for f in quality_rules.FEATURES}
    bad, held = np.array([q == 0 for _, q, _ in seen]), np.array([i * 2654435761 % 3 == 0 for i, *_ in seen])
    rules = quality_rules.learn_rules(x, bad, held)
    whole = {f: np.array([s[f] for _, s in stats]) for f in quality_rules.FEATURES}
    hit = np.zeros(len(stats), bool)
    for r in rules:
        hit |= r.holds(whole)
    return [not s["failed"] and not h for (_, s), h in zip(stats, hit, strict=True)]


def test_verdicts_of_the_query(spark):
    from evenkeel.llm.queries import op3_quality_rules

    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    got = {r.doc_id: r.kept for r in op3_quality_rules(spark, folder).select("doc_id", "kept").collect()}
    want = plain_verdicts(docs, labels)
    assert got == {i: k for (i, _), k in zip(docs, want, strict=True)} and 0 < sum(want) < len(want)
    quality = dict(labels)
    base = {i: plain_statistics(t)["failed"] for i, t in docs}
    judged = [(got[i], q) for i, q in quality.items() if i in got and not base[i]]
    assert sum(k == (q == 1) for k, q in judged) >= 0.95 * len(judged)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_rows_and_columns(spark, stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (before, after) in list(stages.items())[:-1]:
        a, b = rows(before), rows(after)
        assert tuple(after.columns) == corpus_pipeline.COLUMNS and len(b) == after.count() and set(b) <= set(a) and len(b) > 0, name
        if name != "substring_dedup":
            assert all(tuple(b[i]) == tuple(a[i]) for i in b), name
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"][1].count()


def test_language(stages):
    before, after = stages["language_id"]
    known = language_id.identify(before, language_id.train_on(before)).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    assert set(rows(after)) == set(rows(known))
    assert set(rows(after)) <= {i for i, r in rows(before).items() if any(map(str.isalpha, r.text or ""))}


def test_quality(spark, stages):
    before, after = stages["quality_rules"]
    docs = [(i, r.text) for i, r in rows(before).items()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert set(rows(after)) == {i for (i, _), k in zip(docs, plain_verdicts(docs, labels), strict=True) if k}


def test_near_duplicates(stages):
    before, after = stages["ngram_jaccard_join"]
    sets = {i: shingles(r.text) for i, r in rows(before).items()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(rows(after)) == {find(i) for i in ids} and len(rows(after)) < len(ids)


def test_repeated_passages(stages):
    before, after = stages["substring_dedup"]
    docs = [(i, r.text) for i, r in rows(before).items()]
    count, want = windows(docs, 35), {}
    for i, t in docs:
        w = words(t)
        gone = {j + k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        if len(gone) < len(w):
            want[i] = kept if gone else t
    got = rows(after)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for i, r in got.items() if r.text != dict(docs)[i])


def test_packing(stages):
    before, after = stages["packing"]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(rows(before))
    for i, r in rows(before).items():
        ids, at = ids_of(r.text), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        assert sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
