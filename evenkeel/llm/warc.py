"""WARC archives: a writer that revisits equal payloads, and a sequential reader.

Every record is a gzip member of its own.  The reader goes through an archive from front to back in
bounded memory: it inflates step by step, frames each record by its Content-Length and verifies the
digests of its block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import filesystem, materialise, scratch_path

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 100
#: Bytes of an archive after which a task starts another.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
#: Headers that the reader goes by.
NEEDED = ("warc-type", "content-length", "warc-block-digest", "warc-payload-digest")


class WarcError(ValueError):
    """An archive that isn't framed as it says, or whose digests don't match."""


def _b32(digest: bytes) -> str:
    return "sha256:" + base64.b32encode(digest).decode()


def record_id(page_id: int | None, payload: bytes) -> str:
    """The identifier of a response, which those that revisit it can tell from its page and their own payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{hashlib.sha256(payload).hexdigest()}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member: an HTTP response with its payload, or the response's head alone if it is revisited."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if revisit or page_id is None else record_id(page_id, payload)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url or "" if c.isprintable())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _b32(hashlib.sha256(payload).digest())),
        ("WARC-Block-Digest", _b32(hashlib.sha256(block).digest())),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, payload)), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    raw = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes

    @property
    def payload_bytes(self) -> int:
        """Length of the full payload, which a revisit states and doesn't hold."""
        for line in self.http.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                return int(line.split(b":", 1)[1])
        return len(self.payload)


class _Members:
    """The inflated bytes of one gzip member after another, read in steps."""

    def __init__(self, stream):
        self.stream, self.raw, self.z = stream, b"", None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(READ_BYTES)
        self.z = zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bytes:
        """Some further bytes of this member; none at its end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    raise WarcError("the archive ends within a record")
            try:
                out = self.z.decompress(self.raw, READ_BYTES)
            except zlib.error as e:
                raise WarcError(f"a record that does not inflate: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""


def read_records(stream) -> Iterator[Record]:
    """Records of an archive in order; raises WarcError at the first that is damaged."""
    members = _Members(stream)
    while members.next_member():
        buf = bytearray()
        while (cut := buf.find(b"\r\n\r\n")) < 0:
            step = members.more()
            if not step:
                raise WarcError("a record without the end of its head")
            buf += step
        lines = bytes(buf[:cut]).split(b"\r\n")
        if lines[0] != VERSION:
            raise WarcError(f"not a record: {lines[0][:40]!r}")
        headers = {k.decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        if missing := [n for n in NEEDED if n not in headers]:
            raise WarcError(f"a record without {', '.join(missing)}")
        if not headers["content-length"].isdecimal():
            raise WarcError(f"a Content-Length of {headers['content-length'][:40]!r}")
        size = int(headers["content-length"])
        del buf[: cut + 4]
        while len(buf) < size + 4:
            step = members.more()
            if not step:
                raise WarcError("a record shorter than its Content-Length")
            buf += step
        if members.more() or bytes(buf[size:]) != b"\r\n\r\n":
            raise WarcError("a record longer than its Content-Length")
        block = bytes(buf[:size])
        http, _, payload = block.partition(b"\r\n\r\n")
        if _b32(hashlib.sha256(block).digest()) != headers["warc-block-digest"]:
            raise WarcError("a block that doesn't match its digest")
        if headers["warc-type"] == "response" and _b32(hashlib.sha256(payload).digest()) != headers["warc-payload-digest"]:
            raise WarcError("a payload that doesn't match its digest")
        yield Record(headers, http, payload)


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page (page_id, url, html) into archives in a shared folder; rows (path, records, bytes) of them.

    Of pages with equal payloads of at least LEAST_REVISIT bytes those with the smallest page_id are
    stored, others revisit it; a null html is an empty payload.  Repeated rows are all written; equal
    rows that have the smallest id are all responses.  Null ids come after all others and revisit too,
    unless no row of the group has an id.  An archive that a lost task left behind is in no row of the result.
    """
    raw = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    # small payloads share no digest, so that they are dealt evenly
    src = src.withColumn("digest", F.when(long, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    groups = src.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    dealt = src.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")
    )

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, path, records, size = None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, payload, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, records, size = fs.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                raw = record_bytes(page_id, url, payload, first, revisit)
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "records", "bytes"])

    return materialise(dealt.mapInArrow(run, "path string, records long, bytes long"), "warc_manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all archives in a manifest.

    Of a revisit, length and digest are those of the payload that it refers to, and payload is empty; a page without an id has
    a null page_id.  An empty manifest gives no rows; a damaged archive, or one with fewer records than the manifest says,
    is an error.
    """
    files = max(1, manifest.count())
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def number(x: str) -> int | None:
        return int(x) if x else None

    def flush(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
                        rows.append((number(h["x-page-id"]), h["warc-target-uri"], r.payload_bytes, digest, h["warc-type"], number(h.get("x-refers-to-page-id", "")), r.payload))
                        size, seen = size + len(r.payload), seen + 1
                        if size >= 4 << 20 or len(rows) >= 2000:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)
                if seen != records:
                    raise WarcError(f"{path} holds {seen} records of {records}")

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("path", "records").repartition(files).mapInArrow(run, ddl)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """All pages written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and repeated ids, null htmls and ties are as write_warc says; extra columns are not read, and an empty table gives
    no rows."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
