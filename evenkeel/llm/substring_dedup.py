"""Substring deduplication over a log-structured fingerprint index.

A window is `width` consecutive words.  The windows of a text are cut into *spans*: maximal runs of
consecutive windows whose smallest `GRAM`-word hash is the same, `MOST` windows at most.  Equal windows
have equal smallest hashes, so all occurrences of a window meet under one key.  A batch becomes an
immutable run of spans, bucketed and sorted by that key; it is merge-joined with the runs before it, and runs of a
level are compacted into one of the next level.

Equal texts are one place in the index, found by their digest before anything else; a text that has copies repeats in full.
What the index matches is verified on the words: a span whose words occur twice repeats in full; where one key
has several contents, one occurrence of each is expanded into its windows, whose words are compared in turn.  Words are
compared by a 128-bit BLAKE2 digest of them all, as texts are by their MD5.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete
from ._common import (
    WORD_PATTERN, WordHasher, drop_table, materialise, materialise_bucketed, mix, open_bucketed, own_exchange, scratch_path, setting, text_bytes, whole_rows,
    window_hashes, write_bucketed,
)

GRAM = 8
MOST = 28
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    if n:
        out[1:] = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    return out


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P with P[i] = sum of w[j] * B^j, and the powers: a range is the difference, scaled to the text's end."""
    p = _powers(len(words))
    out = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * p[:-1], out=out[1:])
    return out, p


def _range_hash(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * inverse[start])


def _inverse_powers(n: int) -> np.ndarray:
    inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    if n:
        out[1:] = np.cumprod(np.full(n, inv, dtype=np.uint64))
    return out


def spans_of(words: np.ndarray, width: int):
    """(key, start, count, inner) of each span of a text given by its word hashes; inner: it may hold a window twice."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    gram = min(GRAM, width)
    h = window_hashes(words, gram)
    reach, low, have = width - gram + 1, h, 1
    while have * 2 <= reach:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < reach:
        low = np.minimum(low[: n], low[reach - have : reach - have + n])
    low = low[:n]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = low[1:] != low[:-1]
    first = np.flatnonzero(new)
    lens = np.diff(np.append(first, n))
    if (lens > MOST).any():  # a text that repeats itself word by word
        at = np.arange(n) - np.repeat(first, lens)
        first = np.flatnonzero(at % MOST == 0)
        lens = np.diff(np.append(first, n))
    inner = np.zeros(len(first), dtype=bool)
    if len(np.unique(h)) < len(h):
        prefix, _ = _prefix(words)
        start = np.arange(n)
        whole = _range_hash(prefix, _inverse_powers(len(words)), start, start + width)
        span = np.repeat(np.arange(len(first)), lens)
        order = np.lexsort((whole, span))
        same = (whole[order][1:] == whole[order][:-1]) & (span[order][1:] == span[order][:-1])
        inner[span[order][1:][same]] = True
    return low[first], first, lens, inner


_SPAN = pa.schema([("mhash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("cnt", pa.int8()), ("tie", pa.bool_())])
SPAN_DDL = "mhash long, k1 long, k2 long, start int, cnt tinyint, tie boolean"
_PLACE = ("k1", "k2", "start")


def _span_writer(width: int):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            parts, at = [], []
            for i, text in enumerate(batch.column(2)):
                got = spans_of(hasher.hashes((text.as_py() or b"").split()), width)
                if len(got[0]):
                    parts.append(got)
                    at.append(np.full(len(got[0]), i))
            if parts:
                at = np.concatenate(at)
                key, first, lens, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(k1[at].astype(np.int64)), pa.array(k2[at].astype(np.int64)),
                        pa.array(first.astype(np.int32)), pa.array(lens.astype(np.int8)), pa.array(inner),
                    ],
                    schema=_SPAN,
                )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the two halves of the text's digest as content address; equal texts share it, nulls too."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), *also)
    digest = F.md5("text")
    half = lambda a: F.coalesce(F.conv(F.substring(digest, a, 16), 16, -10).cast("long"), F.lit(0))
    return raw.select("doc_id", half(1).alias("k1"), half(17).alias("k2"), "text", *also)


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """Each text once: k1, k2, copies and the other columns of one of its rows; bucketed by its address.

    Copies are put together before the shuffle, so that a task sends a text once, however many rows have it."""
    others = [c for c in keyed.columns if c not in ("k1", "k2")]
    one = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in others])
    return materialise_bucketed(one, "texts", int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k1", "k2")


@dataclass
class Run:
    """An immutable run: a bucketed table of spans, and beside it, unsorted, the spans of its most frequent keys, whose list is
    shorter than the number of buckets."""

    level: int
    name: str
    hot: list[int]


@dataclass
class SubstringIndex:
    """Runs of spans in a shared folder, each immutable, bucketed and sorted by its key, and what batches matched.

    The folder's last manifest names the runs and the matches, so that another session goes on where one ended; files
    that it does not name belong to a step that did not end.  There are as many buckets as shuffle partitions, unless set;
    a key with more rows than a bucket has on average (or than `most`) is kept apart, so that no bucket takes them all.  Width,
    buckets and fanout of an existing index are those it was made with.
    """

    spark: SparkSession
    path: str
    width: int = 35
    buckets: int | None = None
    fanout: int = 4
    most: int | None = None
    #: runs, oldest first, and the folders with the matches of each batch
    runs: list[Run] = field(default_factory=list)
    adds: list[str] = field(default_factory=list)
    #: the session's names of the runs' tables
    _tables: dict[str, str] = field(default_factory=dict)
    _version: int = 0

    def __post_init__(self) -> None:
        if self.buckets is None:
            self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        known = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if known:
            said = json.loads(self.spark.read.text(f"{self.path}/{known[-1]}", wholetext=True).first()[0])
            self._version = int(known[-1][9:-5])
            self.width, self.buckets, self.fanout, self.adds = said["width"], said["buckets"], said["fanout"], said["adds"]
            self.runs = [Run(**run) for run in said["runs"]]

    def _commit(self) -> None:
        """Write the next manifest; it counts once it has its name."""
        self._version += 1
        said = json.dumps({"width": self.width, "buckets": self.buckets, "fanout": self.fanout, "runs": list(map(asdict, self.runs)), "adds": self.adds})
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = make(f"{self.path}/.draft-{uuid.uuid4().hex}"), make(f"{self.path}/manifest-{self._version:08d}.json")
        files = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(draft, False)
        out.write(said.encode())
        out.close()
        if not files.rename(draft, final):
            raise RuntimeError(f"another writer made {final.getName()}")

    def table(self, run: Run) -> DataFrame:
        """The bucketed spans of a run."""
        if run.name not in self._tables:
            self._tables[run.name] = open_bucketed(self.spark, f"{self.path}/{run.name}", "spans", SPAN_DDL, self.buckets, "mhash")
        return self.spark.table(self._tables[run.name])

    def apart(self, run: Run) -> DataFrame:
        """The spans of a run's frequent keys."""
        if not run.hot:
            return self.spark.createDataFrame([], SPAN_DDL)
        return self.spark.read.schema(SPAN_DDL).parquet(f"{self.path}/{run.name}-apart")

    def spans(self, run: Run) -> DataFrame:
        """All spans of a run."""
        return self.table(run).unionByName(self.apart(run)) if run.hot else self.table(run)

    def _frequent(self, spans: DataFrame, rows: int) -> list[int]:
        """Keys with more rows than a bucket has on average: fewer than buckets."""
        limit = max(1, rows // self.buckets) if self.most is None else self.most
        return sorted(r["mhash"] for r in spans.groupBy("mhash").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect())

    def _write(self, level: int, bucketed: DataFrame, apart: DataFrame, hot: list[int]) -> Run:
        run = Run(level, f"run-{uuid.uuid4().hex[:12]}", hot)
        self._tables[run.name] = write_bucketed(bucketed, f"{self.path}/{run.name}", "spans", self.buckets, "mhash")
        if hot:
            apart.write.option("compression", "zstd").parquet(f"{self.path}/{run.name}-apart")
        return run

    def _first_run(self, batch: DataFrame) -> Run:
        path = scratch_path(self.spark, "spans_raw")
        batch.select("k1", "k2", "text").mapInArrow(_span_writer(self.width), SPAN_DDL).write.option("compression", "zstd").parquet(path)
        raw = self.spark.read.schema(SPAN_DDL).parquet(path)
        hot = self._frequent(raw, raw.count())
        known = F.col("mhash").isin(hot)
        run = self._write(0, raw.where(~known).repartition(self.buckets, "mhash"), raw.where(known), hot)
        delete(self.spark, path)
        return run

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of different texts (k1, k2, text) and return the spans that it matched.

        The batch's run is merge-joined with each run before it by their common bucketing: no run is shuffled; frequent keys
        are few and looked up by their list.  The matched spans are those of the batch whose key it or a run before has
        elsewhere, or that may hold a window twice, and those of the runs whose key the batch has.  A text that was added
        before is the same place.
        """
        run = self._first_run(batch)
        key = F.col("mhash")
        own = self.table(run)
        keys = own.groupBy("mhash").agg(F.count("*").alias("n"), F.max("tie").alias("t"))
        hits, parts = keys.withColumn("t", F.col("t") | key.isin([h for r in self.runs for h in r.hot])), [self.apart(run)] if run.hot else []
        for old in self.runs:
            table = self.table(old)
            has = table.select(key.alias("o")).distinct().withColumn("met", F.lit(True))
            hits = hits.join(has, hits["mhash"] == has["o"], "left").select("mhash", "n", (F.col("t") | F.coalesce("met", F.lit(False))).alias("t"))
            parts.append(table.join(keys.select("mhash"), "mhash", "left_semi"))
            if run.hot:
                parts.append(table.where(key.isin(run.hot)))
            if old.hot:
                met = [h for h in old.hot if h in set(run.hot)] + [r["mhash"] for r in keys.where(key.isin(old.hot)).select("mhash").collect()]
                parts.append(self.apart(old).where(key.isin(met)))
        parts.append(own.join(hits.where("n > 1 or t").select("mhash"), "mhash", "left_semi"))
        found = f"matches-{uuid.uuid4().hex[:12]}"
        reduce(DataFrame.unionByName, parts).write.option("compression", "zstd").parquet(f"{self.path}/{found}")
        self.runs.append(run)
        self.adds.append(found)
        self._commit()
        self.compact()
        return self._matches([found])

    def _matches(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(SPAN_DDL).parquet(*[f"{self.path}/{n}" for n in names])

    def matches(self) -> DataFrame:
        """The spans that any batch matched, once each."""
        if not self.adds:
            return self.spark.createDataFrame([], SPAN_DDL)
        return self._matches(self.adds).distinct()

    def _merge(self, due: list[Run]) -> Run:
        """One run of several, bucket by bucket; only rows of keys that are frequent in some of them and not in all together are shuffled."""
        key, hot = F.col("mhash"), sorted({h for run in due for h in run.hot})
        # rows, unlike column batches, are united bucket by bucket
        sort = lambda df: df.sortWithinPartitions("mhash")
        if not hot:
            merged, apart = [sort(self.table(run)) for run in due], self.spark.createDataFrame([], SPAN_DDL)
        else:
            some = reduce(DataFrame.unionByName, [self.apart(run) for run in due if run.hot] + [self.table(run).where(key.isin(hot)) for run in due])
            some = materialise(some, "spans_apart")
            hot = self._frequent(some, sum(self.spans(run).count() for run in due))
            apart, merged = some.where(key.isin(hot)), [sort(self.table(run).where(~key.isin(sorted({h for r in due for h in r.hot})))) for run in due]
            merged.append(sort(some.where(~key.isin(hot)).repartition(self.buckets, "mhash")))
        with setting(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
            return self._write(due[0].level + 1, reduce(DataFrame.unionByName, merged), apart, hot)

    def compact(self) -> None:
        """Merge the runs of each level that has `fanout` of them."""
        level = 0
        while any(run.level >= level for run in self.runs):
            due = [run for run in self.runs if run.level == level]
            if len(due) >= self.fanout:
                at = self.runs.index(due[0])
                merged = self._merge(due)
                self.runs = [run for run in self.runs if run not in due]
                self.runs.insert(at, merged)
                self._commit()
                for run in due:
                    drop_table(self.spark, self._tables.pop(run.name))
                    delete(self.spark, f"{self.path}/{run.name}")
                    delete(self.spark, f"{self.path}/{run.name}-apart")
            level += 1

    def close(self) -> None:
        """Forget the session's names of the runs; their files stay."""
        while self._tables:
            drop_table(self.spark, self._tables.popitem()[1])


def _digests(words: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """16 bytes for each range of words: a digest of all of them, one space apart."""
    line = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return b"".join([blake2b(line[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), (at[starts + sizes] - 1).tolist(), strict=True)])


def _arrays(spans, *names: str) -> list[np.ndarray]:
    return [spans.field(n).to_numpy(zero_copy_only=False) for n in names]


def _emit(parts: list[list[np.ndarray]], schema: pa.Schema, most: int = 50_000):
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
    for i in range(0, len(cols[0]) if cols else 0, most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _digester(width: int, windows: bool):
    """(k1, k2, text, spans) to the spans with the digest of their words (d1, d2), or to their windows, bit by bit."""
    kinds = [("d1", pa.int64()), ("d2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32())]
    schema = pa.schema([*kinds, ("bit", pa.int8()), ("alone", pa.bool_())] if windows else [("mhash", pa.int64()), *kinds, ("cnt", pa.int8()), ("tie", pa.bool_())])

    def run(batches):
        for batch in batches:
            parts, held = [], 0
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (text, spans) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                words = (text.as_py() or b"").split()
                start, cnt, kind = _arrays(spans.values, "start", "cnt", "alone" if windows else "tie")
                cnt = cnt.astype(np.int64)
                if windows:
                    bit = np.arange(int(cnt.sum())) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                    start, kind = np.repeat(start, cnt), np.repeat(kind, cnt)
                    raw = _digests(words, start + bit, np.full(len(start), width))
                else:
                    raw = _digests(words, start, cnt + width - 1)
                d = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
                place = [d[:, 0], d[:, 1], np.full(len(d), k1[i]), np.full(len(d), k2[i]), start]
                parts.append([*place, bit, kind] if windows else [*_arrays(spans.values, "mhash"), *place, cnt, kind])
                held += len(d)
                if held >= 50_000:
                    yield from _emit(parts, schema)
                    parts, held = [], 0
            yield from _emit(parts, schema)

    return run


def _ask(texts: DataFrame, spans: DataFrame, *cols: str) -> DataFrame:
    """k1, k2, text and the spans asked of it; texts stay in their buckets.  A text has no more spans than words."""
    asked = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct(*cols)).alias("spans"))
    return texts.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("k1", "k2", "text", "spans")


def repeated_spans(texts: DataFrame, matched: DataFrame, width: int) -> DataFrame:
    """k1, k2 and spans: an array of (start, cnt, mask), the windows of a text that occur at another place too, from the spans
    that the index matched, verified on the words.  A mask has a bit for each such window; -1 stands for all `cnt`."""
    said = _ask(texts, matched, "mhash", "start", "cnt", "tie").mapInArrow(
        _digester(width, False), "mhash long, d1 long, d2 long, k1 long, k2 long, start int, cnt tinyint, tie boolean"
    )
    said = materialise(said, "spans_said")
    same = ["mhash", "d1", "d2"]
    found = materialise(said.groupBy(*same).agg(F.count("*").alias("n"), F.max("tie").alias("tie"), F.min(F.struct(*_PLACE, "cnt")).alias("at")), "spans_found")
    # spans that repeat in full: all their places
    whole = said.join(found.where("n > 1").select(*same), same, "left_semi").select(*_PLACE, "cnt").withColumn("mask", F.lit(-1))
    # keys of several contents: one place of each content is expanded
    several = found.groupBy("mhash").agg(F.count("*").alias("contents")).where("contents > 1").select(own_exchange("mhash").alias("x"))
    found = found.withColumn("x", own_exchange("mhash"))
    mixed = found.join(several, "x", "left_semi").unionByName(found.where("tie and n = 1").join(several, "x", "left_anti"))
    asked = mixed.select((F.col("n") == 1).alias("alone"), "at.*")
    win = _ask(texts, asked, "start", "cnt", "alone").mapInArrow(
        _digester(width, True), "d1 long, d2 long, k1 long, k2 long, start int, bit tinyint, alone boolean"
    )
    win = materialise(win, "windows")
    again = win.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select(own_exchange("d1").alias("x"), "d2")
    parts = win.where("alone").withColumn("x", own_exchange("d1")).join(again, ["x", "d2"], "left_semi").groupBy(*_PLACE).agg(
        F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"), F.lit(MOST).cast("tinyint").alias("cnt")
    )
    spans = whole.unionByName(parts.select(*_PLACE, "cnt", "mask"))
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "cnt", "mask")).alias("spans"))


def _remover(width: int, first: str = "doc_id"):
    def run(batches):
        for batch in batches:
            out = {first: batch.column(0), "n_words": [], "n_removed": [], "kept_text": []}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans or ():
                    a, mask = s["start"], s["mask"]
                    if mask < 0:  # all its windows
                        gone[a] += 1
                        gone[a + s["cnt"] + width - 1] -= 1
                    else:
                        for i in range(s["cnt"]):
                            if mask >> i & 1:
                                gone[a + i] += 1
                                gone[a + i + width] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [out[first], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.binary())],
                names=list(out),
            )

    return run


def _n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def substring_dedup(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 35, batches: int = 3, fanout: int = 2, carry: bool = False,
    most: int | None = None,
) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_text (UTF-8 bytes of the kept words, joined by one space).

    The different texts arrive in `batches` batches, by a hash; each becomes a run of the index and is matched with the
    runs before it and itself, and `fanout` runs of a level are compacted into one (`most`: SubstringIndex).  A word goes if a window over
    it starts anywhere else too, on either side of a match and within one text.  A null or empty text has no words; a
    text of fewer than `width` words loses none; repeated rows and equal texts repeat each other's
    windows.  Only the id and text columns are read, so that others may have any name, unless `carry` asks for whole rows
    in a column `row`: rows whose text has copies and is not shorter than a window, of which nothing is left, are then left
    out.  An empty table gives no rows.
    """
    spark, first = docs.sparkSession, "row" if carry else "doc_id"
    also = docs.select(F.col(id_col), F.col(text_col), whole_rows(docs).alias("row")) if carry else docs
    keyed = _keyed(also, id_col, text_col, ("row",) if carry else ())
    texts = distinct_texts(keyed)
    index = SubstringIndex(spark, scratch_path(spark, "substring-index"), width, fanout=fanout, most=most)
    for b in range(batches):
        index.add(texts.where(F.pmod("k2", F.lit(batches)) == b))
    spans = repeated_spans(texts, materialise(index.matches(), "spans_matched"), width)
    schema = StructType([texts.schema[first]]).add("n_words", "long").add("n_removed", "long").add("kept_text", "binary")
    alone = texts.where("copies = 1").join(spans, ["k1", "k2"], "left").select(first, "text", "spans").mapInArrow(_remover(width, first), schema)
    # a text with copies repeats in full: its rows need no text but where it is shorter than a window
    short = F.col("n_words") < width
    copied = texts.where("copies > 1").select(own_exchange("k1").alias("c1"), F.col("k2").alias("c2"), "text", _n_words(F.col("text")).alias("n_words"))
    words = F.array_join(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD_PATTERN), F.lit(0)), " ")
    copied = copied.select("c1", "c2", "n_words", F.when(short, F.lit(0).cast("long")).otherwise(F.col("n_words")).alias("n_removed"), F.when(short, F.coalesce(words, F.lit(""))).otherwise("").cast("binary").alias("kept_text"))
    at = own_exchange("k1").alias("k1")
    rows = keyed.select(at, "k2", first)
    if carry:  # whole rows travel for the short ones alone; of the others nothing is left
        rows, copied = keyed.where(_n_words(F.col("text")) < width).select(at, "k2", first), copied.where("n_removed = 0")
    again = rows.join(copied, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select(first, "n_words", "n_removed", "kept_text")
    return alone.unionByName(again)


def substring_dedup_stage(docs: DataFrame, width: int = 35) -> DataFrame:
    """Documents without the repeated passages, columns kept: a text that loses words becomes its kept words, joined by
    one space, with n_chars to match; texts that lose nothing stay as they are, null and empty ones too, and those that
    lose all of their words go.  Extra columns may have any name; an empty table gives no rows."""
    names = docs.columns
    out = substring_dedup(docs, width=width, carry=True)
    out = out.where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text").cast("string")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(changed, F.length(F.col("kept_text").cast("string"))).otherwise(F.col("row.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def substring_digest(df: DataFrame) -> DataFrame:
    """The digest columns of substring_dedup's rows; one for each of them."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
