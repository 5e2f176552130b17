"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of labelled rows are summed by executors; the matrix of log probabilities, whose size is the
number of hash buckets times the number of languages, is broadcast, and whole batches of texts are
scored with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import text_bytes, whole_rows

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Characters in a piece of a text, and n-grams that are scored at a time.
PIECE, BATCH = 1 << 20, 1 << 20


def _grams(codes: np.ndarray, bits: int):
    """Bucket of the n-gram that starts at each character, for each order; near the end the orders are shorter."""
    h = np.zeros(len(codes), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            return
        h = (h[:n] ^ codes[order - 1 :][:n]) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        if order in ORDERS:
            yield (((h + np.uint32(order)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pieces(text: str):
    """Overlapping slices of a text that hold each of its n-grams once, with the number of starts each owns."""
    over = max(ORDERS) - 1
    for i in range(0, len(text), PIECE):
        yield text[i : i + PIECE + over], min(PIECE, len(text) - i)


def gram_counts(text: str, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, dtype=np.int64)
    for part, own in _pieces(text):
        for g in _grams(_codes(part), bits):
            out += np.bincount(g[:own], minlength=1 << bits)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counter(bits: int):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                total += gram_counts((text.as_py() or b"").decode("utf-8", "replace"), bits)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema
            )

    return run


@dataclass
class LanguageModel:
    langs: list[str]
    bits: int
    #: log probability in each language (row) of each bucket (column)
    logp: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Most probable language, the first by name of equals, and its probability among those learned.

        A batch is a sparse matrix of n-gram counts, a row for each piece of a text, stored by rows: its product with the
        matrix of log probabilities is taken for the whole batch."""
        known = [i for i, t in enumerate(texts) if self.langs and t is not None and has_letter(t)]
        total = np.zeros((len(texts), len(self.langs)))
        owners, columns, sizes, pending = [], [], [], 0
        for i in known:
            for part, own in _pieces(texts[i]):
                grams = np.concatenate([g[:own] for g in _grams(_codes(part), self.bits)])
                owners.append(i)
                columns.append(grams)
                sizes.append(len(grams))
                pending += len(grams)
                if pending >= BATCH:
                    self._add(total, owners, columns, sizes)
                    owners, columns, sizes, pending = [], [], [], 0
        if owners:
            self._add(total, owners, columns, sizes)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            odds = np.exp(total[known] - total[known].max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            for i, k, score in zip(known, best.tolist(), (odds.max(axis=1) / odds.sum(axis=1)).tolist(), strict=True):
                names[i], scores[i] = self.langs[k], score
        return names, scores

    def _add(self, total: np.ndarray, owners: list[int], columns: list[np.ndarray], sizes: list[int]) -> None:
        """Add to the rows `owners` of total the product of a sparse matrix in compressed rows with the log probabilities."""
        at, starts = np.concatenate(columns), np.cumsum([0, *sizes[:-1]])
        for lang in range(len(self.langs)):
            np.add.at(total[:, lang], owners, np.add.reduceat(self.logp[lang][at], starts, dtype=np.float64))


def train(labelled: DataFrame, bits: int = 16, most: int = 20_000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows (key, lang, text); null languages are left out.

    `most` bounds the labelled keys that are used, those with the smallest hashes; the model then has
    2 ** bits rows and a column for each language.
    """
    rows = labelled.where("lang is not null")
    chosen = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(most).distinct()
    rows = rows.join(F.broadcast(chosen), "key", "left_semi")  # `most` keys at most
    found = rows.select("lang", text_bytes().alias("text")).mapInArrow(_counter(bits), "lang string, bucket int, n long")
    sums = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # buckets times languages at most
    langs = sorted({r["lang"] for r in sums})
    counts = np.full((1 << bits, len(langs)), smoothing, dtype=np.float64)
    column = {x: i for i, x in enumerate(langs)}
    for r in sums:
        counts[r["bucket"], column[r["lang"]]] += r["n"]
    return LanguageModel(langs, bits, np.ascontiguousarray(np.log(counts / counts.sum(axis=0)).astype(np.float32).T))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with lang_pred and score for each row, by its text alone.

    A null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned.  Columns that are
    not in `keep` may have any name; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*(F.col(c) for c in keep), text_bytes(text_col).alias("__text"))
    schema = StructType([*src.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            names, scores = m.predict([None if (b := t.as_py()) is None else b.decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"]
            )

    return src.mapInArrow(run, schema)


def held_out():
    """Rows that training never sees: the CRC-32 of the id's digits leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame) -> LanguageModel:
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull())
    return train(rows.select(F.col("doc_id").alias("key"), "lang", "text"))


def language_stage(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose text is in a learned language with at least that probability among those learned, columns unchanged.

    Null texts and texts without a letter go; a text of more than a few words nearly always has one language far ahead of the
    others, so that little else does.  Rows are judged by themselves, repeated ones and null ids included.  Whole rows
    travel in one column, so that theirs may have any name; an empty table, or one without a label, gives no rows.
    """
    rows = docs.select(whole_rows(docs).alias("row"), F.col("text"))
    scored = identify(rows, train_on(docs), keep=("row",))
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
