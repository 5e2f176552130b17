"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many full sequences as fit,
then the binary digits of the rest, largest first.  Each piece is a sequence of its own, so that no
sequence crosses documents and none is padded; sequences of one length form a bucket, cut into
batches of a fixed number of tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_bytes
from ._tokens import encoder, slices


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two that sum to n, largest first, none above `most`, itself a power of two."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()), ("batch_id", pa.int64())]
)


def _packer(tokenizer: str, end_id: int, most: int, batch_tokens: int):
    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        base = TaskContext.get().partitionId() << 33
        made, filled = 0, [0] * most.bit_length()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([own, end])
                at = 0
                for n in binary_lengths(len(ids), most):
                    raw = ids[at : at + n].tobytes()
                    bucket = n.bit_length() - 1
                    number = base + (filled[bucket] // max(1, batch_tokens // n))
                    rows.append((doc_id, at, n, raw, zlib.crc32(raw), len(ids), base + made, 0, bucket, number))
                    filled[bucket] += 1
                    made += 1
                    at += n
            for i in range(0, len(rows), 5000):
                cols = list(zip(*rows[i : i + 5000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    return run


def pack(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, most: int = 2048, batch_tokens: int = 1 << 16,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """One row for each sequence: doc_id, start, length, ids (little-endian 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset, bucket (binary logarithm of the length), batch_id (unique within its bucket).

    Each document ends with `end_id`.  A null or empty text is that id alone: one sequence of length 1.
    Rows with a null or repeated id are packed like others.  Nothing is shuffled: a task numbers its
    sequences above its partition number, and leaves at most one unfilled batch for each bucket.
    """
    if most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    ddl = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"
    return src.mapInArrow(_packer(tokenizer, end_id, most, batch_tokens), ddl)
