"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens; blocks of documents carry the sequence of their pre-tokens as numbers into
the block's own dictionary, so that what is shuffled is each word once for each block, with its
position in that dictionary.  A block is written in rows of a few MB of text, each with the words that are new
in it.  All occurrences of a word meet in one partition, sorted; it is encoded once there; ids are
joined back once for each block, and its rows are reassembled one by one.  Decoding joins the ids with the
token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, materialise_bucketed, text_bytes
from ._tokens import slices, vocabulary

#: Bytes of text and words of its dictionary after which a block is closed, and bytes of text of one of its rows; a longer text
#: is a row of its own.
BLOCK_BYTES, BLOCK_WORDS, ROW_BYTES = 64 << 20, 600_000, 4 << 20
#: Texts of more characters are cut without a list of their pre-tokens.
LONG = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter():
    """A pattern of all pre-tokens of a text.  White space is the Unicode property, as for the library."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class _Dictionary(dict):
    """Numbers of words in the order of their first use; `fresh` has those that no row has told yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, pattern, text: str) -> np.ndarray:
        if len(text) > LONG:
            return np.fromiter((self[m.group()] for m in pattern.finditer(text)), dtype=np.uint32)
        found = pattern.findall(text)
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint32, count=len(found))


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("seq", pa.binary()),
        ("first", pa.int32()), ("words", pa.list_(pa.binary())),
    ]
)


def _blocks(row_bytes: int, block_bytes: int):
    def run(batches):
        pattern, pack = splitter(), zstandard.ZstdCompressor(level=3)
        base, made = TaskContext.get().partitionId() << 24, 0
        words, no, block_size = _Dictionary(), 0, 0
        ids, parts, row_size = [], [], 0

        def row():
            seq = np.concatenate(parts)
            planes = np.ascontiguousarray(seq.view(np.uint8).reshape(-1, 4).T).tobytes()
            fresh, words.fresh = words.fresh, []
            values = [base + made, no, ids, [len(p) for p in parts], pack.compress(planes), len(words) - len(fresh), list(map(str.encode, fresh))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py() or b""
                if ids and row_size + len(raw) > row_bytes:
                    yield row()
                    ids, parts, row_size, no = [], [], 0, no + 1
                    if block_size + len(raw) > block_bytes or len(words) > BLOCK_WORDS:
                        words, made, no, block_size = _Dictionary(), made + 1, 0, 0
                parts.append(words.numbers(pattern, raw.decode("utf-8", "replace")))
                ids.append(doc_id)
                row_size, block_size = row_size + len(raw), block_size + len(raw)
        if ids:
            yield row()

    return run


def _pack(values) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs; the first byte says how many."""
    x = np.asarray(values, dtype=np.uint32)
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, dtype=f"<u{p[0]}", offset=1).astype("<u4") for p in parts] or [np.empty(0, "<u4")])


def _word_encoder(vocab: str):
    """Rows (word, block, at) sorted by word to rows (block, ats, lens, ids), packed for each block."""
    schema = pa.schema([("block", pa.int64()), ("ats", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        import tiktoken

        pattern = r"(?s).+"  # a word is one piece already
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(vocabulary(vocab)), special_tokens={})
        held: dict[int, list] = {}
        last, ids, n = None, b"", 0

        def flush():
            rows = [
                {"block": b, "ats": _pack(x[0]), "lens": _pack(x[1]), "ids": _pack(np.frombuffer(b"".join(x[2]), "<u4"))} for b, x in held.items()
            ]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for word, block, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if word != last:
                    last, ids = word, np.array(enc._encode_single_piece(word), dtype="<u4").tobytes()
                x = held.get(block)
                if x is None:
                    x = held[block] = ([], [], [])
                x[0].append(at)
                x[1].append(len(ids) >> 2)
                x[2].append(ids)
                n += 1
            if n > 300_000:
                yield flush()
                held.clear()
                n = 0
        if held:
            yield flush()

    return run


def _gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of values[s : s + n] over starts and lens."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return values[shift + np.arange(total)]


class TokenBytes:
    """The token-byte table of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.lens = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        return _gather(self.bytes, self.starts[ids], self.lens[ids]).tobytes()


def _assembler(vocab: str, decode: bool):
    """Over rows (block, no, doc_ids, sizes, seq, parts) sorted by the first two; parts, the block's dictionary, comes with no 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.binary())] if decode else [])])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        table = TokenBytes(read_ranks(vocabulary(vocab))) if decode else None
        at, ids, lens, starts = (None, -1), None, None, None
        for batch in slices(batches, 1):
            block, no, doc_ids, sizes = (batch.column(i)[0].as_py() for i in range(4))
            if no == 0:
                parts = batch.column(5)[0].as_py() or ()
                ats, got, ids = (_unpack([p[c] for p in parts]) for c in ("ats", "lens", "ids"))
                got = got.astype(np.int64)
                lens, starts = np.zeros(len(ats), np.int64), np.zeros(len(ats), np.int64)
                lens[ats], starts[ats] = got, np.cumsum(got) - got
            elif at != (block, no - 1):
                raise ValueError(f"row {no} of block {block} came after {at}")
            at = (block, no)
            planes = np.frombuffer(unpack.decompress(batch.column(4)[0].as_py()), dtype=np.uint8)
            seq = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
            stream = _gather(ids, starts[seq], lens[seq]) if len(seq) else np.empty(0, "<u4")
            ends = np.concatenate([[0], np.cumsum(lens[seq])])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64)
            out = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends)), _pieces(stream.astype("<u4", copy=False).view(np.uint8), 4 * ends)]
            if decode:
                raw = np.frombuffer(table.decode(stream), dtype=np.uint8)
                out.append(_pieces(raw, np.concatenate([[0], np.cumsum(table.lens[stream])])[ends]))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def _pieces(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in an array of bytes."""
    if ends[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def bpe_encode(
    docs: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken", text_col: str = "text", id_col: str = "doc_id", decode: bool = False,
    row_bytes: int = ROW_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), and with decode, decoded: the bytes of
    those ids by the token-byte table.

    Each match of the pre-token pattern is encoded by itself, without special tokens.  A null or empty
    text has no ids.  Rows are carried through their block, so that null and repeated ids need no care;
    a word may be of any length.  Only the id and text columns are read, so that others may have any name; an empty
    table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    ddl = "block long, no int, doc_ids array<long>, sizes array<long>, seq binary, first int, words array<binary>"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with arrow_rows(docs.sparkSession, 1000):
        blocks = materialise_bucketed(src.mapInArrow(_blocks(row_bytes, block_bytes), ddl), "bpe_blocks", parts, "block")
    words = blocks.select("block", "first", F.posexplode("words").alias("i", "word")).select("word", "block", (F.col("first") + F.col("i")).alias("at"))
    coded = words.repartition("word").sortWithinPartitions("word").mapInArrow(
        _word_encoder(vocab), "block long, ats binary, lens binary, ids binary"
    )
    found = coded.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("ats", "lens", "ids")).alias("parts"))
    # the dictionary goes along with the first row of its block alone
    met = blocks.join(found, (F.col("block") == F.col("of")) & (F.col("no") == 0), "left").select("block", "no", "doc_ids", "sizes", "seq", "parts")
    out = "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decode else "")
    return met.sortWithinPartitions("block", "no").mapInArrow(_assembler(vocab, decode), out)


def bpe_decode(encoded: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Add decoded (binary) to rows (doc_id, n_tokens, ids): every id joined with its bytes, in order; null ids are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        table = TokenBytes(read_ranks(vocabulary(vocab)))
        for batch in slices(batches, 500):
            text = [table.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], schema=schema)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to; nulls and empty texts as for bpe_encode."""
    back = bpe_encode(docs, decode=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
