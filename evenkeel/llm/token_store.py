"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks at places that its content alone
decides; a chunk is stored once under the SHA-256 of its bytes.  A recipe lists a document's chunks; recipes lie
in files in ascending doc_id order.  The Merkle root of each recipe, of each recipe file and of each chunk file,
and that of all of them in the manifest, verify what is read back.

Files (integers little-endian):
* ``chunks-*.pack``: for each chunk digest (32 bytes), n_ids u32, size u32, and the ids' byte planes
  (see squeeze), each a zstd frame without magic number.
* ``recipes-*.rec``: for each document has_id u8, doc_id i64, n_tokens u64, n_chunks u32, Merkle root (32 bytes), digests.
* ``MANIFEST.json``: files in order with counts and roots, and the root over these.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_rows, filesystem, materialise, remove, scratch_path, text_bytes
from ._tokens import encoder, slices

#: Ids that the rolling hash sees, and the mean, least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 128, 4096
_CHUNK, _RECIPE = "<32sII", "<BqQI32s"


class StoreError(ValueError):
    """What is read back isn't what was written."""


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over digests; leaves and nodes are told apart, an odd node moves up."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        nodes = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = nodes + level[len(nodes) * 2 :]
    return level[0]


def cut_streams(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of id streams that lie one after the other: where the rolling hash of the last WINDOW ids
    is 0 modulo MEAN, no chunk under LEAST ids but a stream's last, none above MOST.

    All streams are hashed at once: a window that begins in the stream before ends within LEAST ids of its own
    stream's start, where nothing is cut.
    """
    h = ids.astype(np.uint64)
    h += np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width, power = 1, 0xD6E8FEB86659FD93
    while width < WINDOW:  # a power of two: windows of twice the width from two of the width
        h[width:] += h[:-width] * np.uint64(power)
        width, power = 2 * width, power * power % (1 << 64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(40)
    places = np.flatnonzero(h % np.uint64(MEAN) == 0) + 1
    bounds = [*np.searchsorted(places, starts).tolist(), len(places)]
    places, starts = places.tolist(), [*(int(x) for x in starts), len(ids)]
    return [_ends([p - a for p in places[i:j]], b - a) for a, b, i, j in zip(starts, starts[1:], bounds, bounds[1:])]


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cut_streams(ids, np.zeros(1, dtype=np.int64))[0]


def _ends(places: list[int], n: int) -> list[int]:
    ends, at = [], 0
    for p in places:
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if LEAST <= p - at and p <= n:
            at = p
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS))


def decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def squeeze(pack, planes: list, used: int) -> bytes:
    """The byte planes of a chunk's ids, each compressed with a code of its own; upper planes without a bit are left out."""
    parts = [pack.compress(x) for x in planes[:used]]
    return struct.pack(f"<B{used - 1}H", used, *map(len, parts[:-1])) + b"".join(parts)  # a plane has MOST bytes at most


def unsqueeze(unpack, data: bytes) -> bytes:
    used = data[0]
    sizes = struct.unpack_from(f"<{used - 1}H", data, 1)
    at, out = 1 + 2 * (used - 1), []
    for k in range(used):
        end = at + sizes[k] if k < used - 1 else len(data)
        out.append(np.frombuffer(unpack.decompress(data[at:end]), np.uint8))
        at = end
    planes = np.zeros((len(out[0]), 4), dtype=np.uint8)
    for k, p in enumerate(out):
        planes[:, k] = p
    return planes.tobytes()


def _chunker(tokenizer: str, end_id: int):
    """(doc_id, text) to (doc_id, n_tokens, digests, chunks): the chunks that this task hasn't seen before."""
    fields = [pa.field("digest", pa.binary()), pa.field("n", pa.int64()), pa.field("data", pa.binary())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("chunks", pa.list_(pa.struct(fields)))])

    def run(batches):
        enc, pack = encoder(tokenizer), compressor()
        end, seen = np.array([end_id], dtype="<u4"), set()
        for batch in slices(batches):
            recipes, ends_of, fresh = [], [0], []
            pieces = [x for own in enc.encode(batch.column(1).to_pylist()) for x in (own, end)]
            stream = np.concatenate(pieces)
            sizes = [len(x) + 1 for x in pieces[::2]]
            starts = np.cumsum(sizes) - sizes
            raw = memoryview(stream).cast("B")
            used = max(1, (int(stream.max(initial=0)).bit_length() + 7) // 8)
            planes = [memoryview((stream >> (8 * k)).astype(np.uint8)) for k in range(used)]
            for a, ends in zip(starts.tolist(), cut_streams(stream, starts), strict=True):
                digests, at = [], 0
                for p in ends:
                    i, j = a + at, a + p
                    d = hashlib.sha256(raw[4 * i : 4 * j]).digest()
                    digests.append(d)
                    if d not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(d)
                        own = max(1, (int(stream[i:j].max()).bit_length() + 7) // 8)
                        fresh.append((d, p - at, squeeze(pack, [x[i:j] for x in planes], own)))
                    at = p
                recipes.append(b"".join(digests))
                ends_of.append(len(fresh))
            cols = list(zip(*fresh, strict=True)) or [(), (), ()]
            chunks = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], fields=fields)
            chunks = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(recipes, pa.binary()), chunks], schema=schema)

    return run


_FILE = pa.schema([("ordinal", pa.int64()), ("path", pa.string()), ("items", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())])
_FILE_DDL = "ordinal long, path string, items long, tokens long, root binary"


def _file_row(path: str, items: int, tokens: int, roots: list[bytes]) -> pa.RecordBatch:
    row = {"ordinal": TaskContext.get().partitionId(), "path": path, "items": items, "tokens": tokens, "root": merkle(roots)}
    return pa.RecordBatch.from_pylist([row], schema=_FILE)


def _pack_writer(folder: str):
    """Rows (digest, n, data) dealt by digest to one pack for each task; a digest is written once."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        path, out, seen, tokens = f"chunks-{uuid.uuid4().hex}.pack", None, set(), 0
        order = []
        for batch in batches:
            for d, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if d in seen:
                    continue
                seen.add(d)
                order.append(d)
                out = out or fs.open_output_stream(f"{root}/{path}", compression=None)
                out.write(struct.pack(_CHUNK, d, n, len(data)) + data)
                tokens += n
        if out is not None:
            out.close()
            yield _file_row(path, len(order), tokens, order)

    return run


def _recipe_writer(folder: str):
    """Rows (doc_id, n_tokens, digests) in order to one recipe file for each task."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        path, out, roots, tokens = f"recipes-{uuid.uuid4().hex}.rec", None, [], 0
        for batch in batches:
            for doc_id, n, digests in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts = [digests[i : i + 32] for i in range(0, len(digests), 32)]
                roots.append(merkle(parts))
                out = out or fs.open_output_stream(f"{root}/{path}", compression=None)
                out.write(struct.pack(_RECIPE, doc_id is not None, doc_id or 0, n, len(parts), roots[-1]) + digests)
                tokens += n
        if out is not None:
            out.close()
            yield _file_row(path, len(roots), tokens, roots)

    return run


def write_store(
    docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, text_col: str = "text", id_col: str = "doc_id"
) -> dict:
    """Encode every text, append end_id, and write the store; returns its manifest, which is also written.

    A null text is empty: its stream is end_id alone.  Rows with null ids come first, rows with equal ids
    in any order; all of them are written.  Files left by lost tasks are in no manifest.  The manifest
    has a row for each file, of which there are as many as partitions.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    cut = src.mapInArrow(
        _chunker(tokenizer, end_id), "doc_id long, n_tokens long, digests binary, chunks array<struct<digest: binary, n: long, data: binary>>"
    )
    with arrow_rows(spark, 1000):
        cut = materialise(cut, "token_chunks")
    chunks = cut.select(F.explode("chunks").alias("c")).select("c.*").repartition("digest")
    packs = materialise(chunks.mapInArrow(_pack_writer(folder), _FILE_DDL), "token_packs").collect()
    ordered = cut.select("doc_id", "n_tokens", "digests").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    recipes = materialise(ordered.mapInArrow(_recipe_writer(folder), _FILE_DDL), "token_recipes").orderBy("ordinal").collect()
    remove(spark, cut)  # both kinds of files are written
    rows = lambda found: [{"path": r["path"], "items": r["items"], "tokens": r["tokens"], "root": bytes(r["root"]).hex()} for r in found]
    manifest = {"end_id": end_id, "tokenizer": tokenizer, "packs": rows(packs), "recipes": rows(recipes)}
    manifest["root"] = _manifest_root(manifest)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/MANIFEST.json", compression=None) as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _manifest_root(manifest: dict) -> str:
    return merkle([bytes.fromhex(x["root"]) for part in ("packs", "recipes") for x in manifest[part]]).hex()


def _exactly(stream, n: int) -> bytes:
    out = stream.read(n)
    if len(out) != n:
        raise StoreError("a file ends within an entry")
    return out


def _recipe_reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary()))])

    def run(batches):
        fs, top = filesystem(folder)
        for batch in batches:
            for number, path, items, base, root in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows, roots, at = [], [], base
                with fs.open_input_stream(f"{top}/{path}", compression=None) as f:
                    for k in range(items):
                        has, doc_id, n, parts, own = struct.unpack(_RECIPE, _exactly(f, struct.calcsize(_RECIPE)))
                        raw = _exactly(f, 32 * parts)
                        digests = [raw[i : i + 32] for i in range(0, len(raw), 32)]
                        if merkle(digests) != own:
                            raise StoreError(f"{path}: a recipe doesn't match its root")
                        roots.append(own)
                        rows.append((doc_id if has else None, at, n, number, k, own, digests))
                        at += n
                        if len(rows) == 1000 or k == items - 1:
                            cols = list(zip(*rows, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
                            rows = []
                    if f.read(1) or merkle(roots) != root:
                        raise StoreError(f"{path} doesn't match its root")

    return run


def _pack_reader(folder: str):
    def run(batches):
        fs, top = filesystem(folder)
        for batch in batches:
            for path, items, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, seen, size = [], [], 0
                with fs.open_input_stream(f"{top}/{path}", compression=None) as f:
                    for k in range(items):
                        d, n, length = struct.unpack(_CHUNK, _exactly(f, struct.calcsize(_CHUNK)))
                        found.append((d, n, _exactly(f, length)))
                        seen.append(d)
                        size += length
                        if size > 4 << 20 or k == items - 1:
                            cols = list(zip(*found, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["digest", "n", "data"])
                            found, size = [], 0
                    if f.read(1) or merkle(seen) != root:
                        raise StoreError(f"{path} doesn't match its root")

    return run


def _assembler(batches):
    unpack = decompressor()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        rows, size = [], 0
        parts = batch.column(4)
        places, data, bounds = parts.values.field(0).to_pylist(), parts.values.field(1).to_pylist(), parts.offsets.to_pylist()
        for doc_id, start, n, root, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), bounds[:-1], bounds[1:], strict=True):
            raw = [unsqueeze(unpack, data[i]) for i in sorted(range(a, b), key=places.__getitem__)]
            digests = [hashlib.sha256(x).digest() for x in raw]
            if merkle(digests) != root or sum(map(len, raw)) != 4 * n:
                raise StoreError(f"document {doc_id}: the chunks don't match its root")
            rows.append((doc_id, start, n, b"".join(raw)))
            size += 4 * n
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a store, each verified; ids are little-endian 32-bit integers,
    start counts the ids of all documents before."""
    fs, top = filesystem(folder)
    with fs.open_input_stream(f"{top}/MANIFEST.json", compression=None) as f:
        manifest = json.loads(f.read())
    if _manifest_root(manifest) != manifest["root"]:
        raise StoreError("the manifest doesn't match its root")
    base, recipes = 0, []
    for i, r in enumerate(manifest["recipes"]):
        recipes.append((i, r["path"], r["items"], base, bytes.fromhex(r["root"])))
        base += r["tokens"]
    packs = [(p["path"], p["items"], bytes.fromhex(p["root"])) for p in manifest["packs"]]
    told = spark.createDataFrame(recipes, "number long, path string, items long, base long, root binary").repartition(max(1, len(recipes)))
    docs = told.mapInArrow(
        _recipe_reader(folder), "doc_id long, start long, n_tokens long, file long, row long, root binary, digests array<binary>"
    )
    chunks = spark.createDataFrame(packs, "path string, items long, root binary").repartition(max(1, len(packs)))
    chunks = chunks.mapInArrow(_pack_reader(folder), "digest binary, n long, data binary").select("digest", "data")
    refs = docs.select("doc_id", "start", "n_tokens", "file", "row", "root", F.posexplode("digests").alias("at", "digest"))
    once = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)  # noqa: E731  # a document's values travel with its first chunk
    refs = refs.select(*map(once, ("doc_id", "start", "n_tokens", "root")), "file", "row", "at", "digest")
    # the planner takes chunks for small, as the list of packs is; they grow with the input and are never broadcast
    met = refs.join(chunks.hint("merge"), "digest", "left").groupBy("file", "row").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "start", "n_tokens", "root")],
        F.collect_list(F.struct("at", "data")).alias("parts"),
    )
    return met.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(_assembler, "doc_id long, start long, n_tokens long, ids binary")


def token_store_round_trip(docs: DataFrame) -> DataFrame:
    """All documents written to a store and read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone.  Repeated rows are stored one by one, their chunks once; rows without an id come
    first.  Extra columns are not read, and an empty table gives no rows."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_store(docs, folder)
    back = read_store(docs.sparkSession, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
