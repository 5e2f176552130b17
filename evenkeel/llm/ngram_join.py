"""N-gram Jaccard self-join by MinHash banding.

Texts are word sets of five consecutive words.  Bands of MinHash values are shuffled; texts that share a band value are
candidates, and every candidate pair is verified once on the full n-gram sets, in blocks, inside tasks: links
are counted and joined to classes without writing a row for each pair.

A component of collisions that fits in a block is verified as a whole.  For a larger one the cheaper way in
bytes is taken: as a whole, in pairs of blocks, or band group by band group, where a pair belongs to the first band it
shares.  Long chains of weak collisions fall to the second way, families of near copies to the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, WordHasher, components, materialise, mix, text_bytes, whole_rows, window_hashes

#: Texts and bytes of a verification block, about; a pair of blocks is what one task holds.
BLOCK_DOCS, BLOCK_BYTES = 512, 2 << 20


def choose_bands(threshold: float, recall: float = 0.999, most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows a band for which a pair at the threshold is found with at least that
    probability by no more than `most` hash functions."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches that recall with so few hash functions")
    return best


def shingle_set(words: list[bytes], width: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct n-gram hashes; a text of fewer words than the width is one n-gram, one without words none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(hasher.hashes(words), min(width, len(words))))


def _signer(width: int, bands: int, rows: int):
    def run(batches):
        rng = np.random.default_rng(20240229)
        a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        hasher = WordHasher()
        for batch in batches:
            out, size = [], []
            for text in batch.column(2):
                raw = text.as_py() or b""
                size.append(len(raw))
                s = shingle_set(raw.split(), width, hasher)
                if not len(s):
                    out.append(None)
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(0, len(s), 1024):
                    np.minimum(low, (s[i : i + 1024, None] * a[None, :]).min(axis=0), out=low)
                key = salt.copy()
                for k in range(rows):
                    key = mix(key ^ low[k::rows])
                out.append(key.view(np.int64))
            flat = [x for x in out if x is not None]
            ends = np.cumsum([0] + [0 if x is None else bands for x in out]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)),
                mask=pa.array([x is None for x in out], pa.bool_()),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(size, pa.int64())], names=["doc_id", "fp", "bands", "size"])

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of two lists of positions whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = np.bincount(column, minlength=len(values)) > 1  # an n-gram of one text alone adds to no intersection
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, step = int(shared.sum()), 4096
    inter = np.zeros((len(left), len(right)))
    cuts = np.searchsorted(column, np.arange(0, n + step, step))
    for k in range(len(cuts) - 1):
        lo, hi = cuts[k], cuts[k + 1]
        m = np.zeros((len(sets), min(step, n - k * step)), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - k * step] = 1
        inter += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    return inter >= threshold * union - 1e-9


def _verifier(width: int, threshold: float):
    """Over rows (grp, band, bi, bj, nid, copies, side, bands, text) sorted by the first four: one row (nid, links, root) for each
    text with a link in that block pair.  In a group of a band, pairs that share an earlier band are left to it."""
    schema = pa.schema([("nid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def settle(band: int, group: list, hasher: WordHasher):
        seen, docs = set(), []
        for nid, copies, side, bands, text in group:  # repeated rows of one text
            if nid not in seen:
                seen.add(nid)
                docs.append((nid, copies, side, shingle_set((text or b"").split(), width, hasher), bands))
        if len(docs) < 2:
            return None
        docs.sort(key=lambda d: d[0])
        nid = np.array([d[0] for d in docs], dtype=np.int64)
        copies = np.array([d[1] for d in docs], dtype=np.int64)
        side = np.array([d[2] for d in docs])
        one = np.arange(len(docs))
        if (side == 2).all():  # a block with itself
            left = right = one
        else:
            left, right = one[side == 0], one[side == 1]
            if not len(left) or not len(right):
                return None
        hit = _links([d[3] for d in docs], left, right, threshold)
        if band > 0:
            keys = np.array([d[4][:band] for d in docs])
            for b in range(band):
                hit &= keys[left, b][:, None] != keys[right, b][None, :]
        full = np.zeros((len(docs), len(docs)), dtype=bool)
        full[np.ix_(left, right)] = hit
        full |= full.T
        np.fill_diagonal(full, False)
        linked = full.any(axis=1)
        if not linked.any():
            return None
        root = one.copy()
        while True:
            low = np.minimum(root, np.where(full, root[None, :], len(docs)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.RecordBatch.from_arrays(
            [pa.array(nid[linked]), pa.array((full @ copies)[linked]), pa.array(nid[root][linked])], schema=schema
        )

    def run(batches):
        hasher, at, group = WordHasher(), None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            rest = list(zip(*(batch.column(i).to_pylist() for i in range(4, 9)), strict=True))
            for key, item in zip(keys, rest, strict=True):
                if key != at:
                    if group and (done := settle(at[1], group, hasher)) is not None:
                        yield done
                    at, group = key, []
                group.append(item)
        if group and (done := settle(at[1], group, hasher)) is not None:
            yield done

    return run


def _blocks(n: str, size: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("long")


def _memberships(texts: DataFrame) -> DataFrame:
    """(nid, groups): the groups in which a text is verified, as structs (grp, band, blocks); band -1 is a whole component.

    A text is in one group of each band at most, which bounds its list.
    """
    keyed = texts.select("nid", "size", F.posexplode("bands").alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.min("nid").alias("hub"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    met = keyed.select("nid", "band", "key").join(hubs, ["band", "key"]).select("nid", "band", "key", "hub", _blocks("n", "bytes").alias("blocks"), "bytes")
    met = materialise(met, "ngram_groups")
    comp = components(materialise(met.select(F.col("nid").alias("u"), F.col("hub").alias("v")).distinct(), "ngram_edges"))
    comp = materialise(comp.join(texts.select(F.col("nid").alias("node"), "size"), "node"), "ngram_comp")
    whole = comp.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    whole = whole.select("root", _blocks("n", "bytes").alias("blocks"), (F.col("bytes") * _blocks("n", "bytes")).alias("cost"))
    # bytes that travel if a large component is verified by its groups
    groups = met.where(F.col("nid") == F.col("hub")).select("hub", (F.col("bytes") * F.col("blocks")).alias("b"))
    by_band = groups.join(comp, F.col("hub") == F.col("node")).groupBy("root").agg(F.sum("b").alias("band_cost"))
    whole = whole.join(by_band, "root").select("root", "blocks", (F.col("band_cost") < F.col("cost")).alias("split"))
    chosen = materialise(comp.join(whole, "root").select("node", "root", "blocks", "split"), "ngram_chosen")
    entire = chosen.where("not split").select(F.col("node").alias("nid"), F.struct(F.col("root").alias("grp"), F.lit(-1).alias("band"), "blocks").alias("g"))
    apart = met.join(chosen.where("split").select(F.col("node").alias("nid")), "nid", "left_semi")
    apart = apart.select("nid", F.struct(F.col("key").alias("grp"), "band", "blocks").alias("g"))
    return entire.unionByName(apart).groupBy("nid").agg(F.collect_list("g").alias("groups"))


def _classes(docs: DataFrame, text_col: str, id_col: str, width: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, fp, bands, size), and different texts with words (m_fp, rep, cls, class_id, n_links)."""
    bands, rows = choose_bands(threshold, recall)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    src = src.withColumn("fp", F.unhex(F.md5("text"))).select("doc_id", "fp", "text")
    signed = materialise(
        src.mapInArrow(_signer(width, bands, rows), "doc_id long, fp binary, bands array<long>, size long"), "ngram_signed"
    )
    # exact copies become one text
    texts = signed.where("bands is not null").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")
    )
    texts = materialise(texts.withColumn("nid", F.monotonically_increasing_id()), "ngram_texts")

    cand = _memberships(texts).join(texts, "nid")
    cand = cand.select("groups", "nid", F.col("fp").alias("c_fp"), "rep", "copies", "bands")
    rows_ = src.join(cand, (F.col("fp") == F.col("c_fp")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    rows_ = rows_.select(F.explode("groups").alias("g"), "nid", "copies", "bands", "text").select("g.*", "nid", "copies", "bands", "text")
    rows_ = rows_.withColumn("blk", F.pmod(F.xxhash64("nid", "grp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows_ = rows_.select(
        "grp", "band", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "nid", "copies",
        F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1).alias("side"),
        F.when(F.col("band") > 0, F.col("bands")).alias("bands"), "text",
    )
    order = ("grp", "band", "bi", "bj")
    checked = rows_.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verifier(width, threshold), "nid long, links long, root long")
    checked = materialise(checked, "ngram_checked")
    links = checked.groupBy("nid").agg(F.sum("links").alias("links"))
    cls = components(checked.select(F.col("nid").alias("u"), F.col("root").alias("v")))
    cls = cls.select(F.col("node").alias("nid"), F.col("root").alias("cls"))

    member = texts.select("nid", "fp", "rep", "copies").join(cls, "nid", "left").join(links, "nid", "left")
    member = member.withColumn("cls", F.coalesce("cls", "nid"))
    named = member.groupBy("cls").agg(F.min("rep").alias("class_id"))
    member = member.join(named, "cls").select(
        F.col("fp").alias("m_fp"), "rep", "cls", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed, member


def ngram_jaccard_join(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, threshold: float = 0.8, recall: float = 0.999
) -> DataFrame:
    """One row for each input row: doc_id, class_id, n_links, is_representative.

    class_id is the smallest id of the texts connected by links (Jaccard similarity of the sets of
    `width`-word n-grams at the threshold or above); n_links counts the other rows that a row is linked
    to, exact copies included.  A text of one to four words is one n-gram.  A null text or one without
    words is linked to nothing and is its own class.  Rows with equal texts share a class, repeated rows
    and null ids included; a class whose ids are all null has a null class_id.  Only the id and text
    columns are read, so that other columns may have any name; an empty table gives no rows.
    """
    signed, member = _classes(docs, text_col, id_col, width, threshold, recall)
    return signed.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("fp")).alias("fp")).join(
        member, F.col("fp") == F.col("m_fp"), "left"
    ).select(
        "doc_id", F.when(F.col("m_fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    ).withColumn("is_representative", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def near_duplicate_stage(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Keep one document of each class, that with the smallest id and of those the smallest digest; columns unchanged.

    Equal rows (the same id and text) count once.  Texts without words are in no class: they stay, and so do rows without an
    id, which cannot stand for a class.  Whole rows travel in one column, so that theirs may have any name; an empty
    table gives no rows.
    """
    _, member = _classes(docs, "text", "doc_id", width, threshold, recall)
    first = member.where("rep is not null").groupBy("cls").agg(F.min(F.struct("rep", "m_fp")).alias("k")).select(F.lit(True).alias("stays"), "k.*")
    rows = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text"))
    rows = rows.select("row", "id", F.unhex(F.md5("text")).alias("fp"), F.coalesce(F.col("text").cast("string").rlike(WORD_PATTERN), F.lit(False)).alias("words"))
    kept = rows.join(first, (F.col("id") == F.col("rep")) & (F.col("fp") == F.col("m_fp")), "left").where("stays or id is null or not words")
    return kept.dropDuplicates(["id", "fp"]).select("row.*")
