"""Substring dedup with fixed-block anchors.

Non-overlapping blocks of 10 words of every document are the index, every rolling window of 10 words probes it, and
hits are extended to windows of 20 words and so to maximal exact repeats. A window of 20 words always holds a whole
block of 10 of the document it first stands in, so no repeat is missed.

Documents are dealt once into chunks of some MB by a hash of id and text. Four passes run over chunks or hash buckets:
  probe   a chunk's distinct 10-word hashes, as 30-bit remainders with two flags, one row for each hash bucket that has any;
  match   in a bucket: hashes that occur twice or more and are an indexed block somewhere (one bit a hash);
  extend  a chunk's windows of 20 words around hits: 96-bit hashes with the first document that has them;
  first   in a bucket: hashes whose first document lies in another chunk (one bit a hash);
and the last pass covers words and writes one row per document. No pairs are made: a passage with many copies costs
one row entry a chunk. The shuffle of the texts is the same in all three passes over chunks, and Spark reuses it.
Rows are cut out of sorted arrays, so a chunk costs time in proportion to its words, however many buckets there are; with
so many that each has one hash of a chunk, a row is a hash, as in any shuffle of hashes.

Edge cases: a null text has no words; texts under 20 words lose nothing; documents with equal ids are ordered by chunk
and text; a null id comes before all others; a very long text is hashed piece by piece, but its chunk holds about 100 bytes
for each of its words, so that texts of some 50 MB need larger executors than 3 GB; rows that are equal in id and text fall
into one chunk; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, total_bytes
from .text_kernels import _join, gram_hashes, word_hashes, word_spans

#: Words of a window; a block has half as many.
WINDOW = 20
#: Bytes of text in a chunk, and bytes of text for each hash bucket.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
#: Bytes of text whose words are hashed at once; what of a hash a probe keeps.
HASH_BYTES, _REMAINDER = 4 << 20, np.uint32(0x3FFFFFFF)
_NULL_ID = -(1 << 63)


class _Spans:
    """Where the members of each bucket stand in an array sorted by bucket; buckets without members are not there."""

    def __init__(self, bucket: np.ndarray):
        self.buckets, starts = np.unique(bucket, return_index=True)
        self.cuts = np.append(starts, len(bucket))

    def of(self, bucket: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.buckets, bucket))
        return int(self.cuts[k]), int(self.cuts[k + 1])

    def packed(self, values: np.ndarray) -> pa.Array:
        """The bytes of each bucket's values."""
        offsets = (self.cuts * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.buckets), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed values, and how many each row has."""
    rows = column.combine_chunks()
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data.copy().view(kind), np.diff(offsets) // np.dtype(kind).itemsize


class _Chunk:
    """The words of a chunk's documents in (id, text) order, and the hashes of their blocks and windows."""

    def __init__(self, docs: pa.Table, window: int, buckets: int):
        ids = docs.column("doc_id").to_pylist()
        texts = [t.encode() if t is not None else b"" for t in docs.column("text").to_pylist()]
        keys = [_NULL_ID if i is None else i for i in ids]
        order = sorted(range(len(ids)), key=lambda i: (keys[i], texts[i]))
        self.ids, self.keys = [ids[i] for i in order], np.array([keys[i] for i in order], dtype=np.int64)
        self.texts = [texts[i] for i in order]
        self.window, self.block, self.buckets = window, window // 2, buckets
        self.buf, self.starts, self.ends, self.bounds = word_spans(self.texts)
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.left = self.bounds[1:][self.doc] - np.arange(n)  # words from here to the end of the document
        self.in_doc = np.arange(n) - self.bounds[:-1][self.doc]
        grams = gram_hashes(self._words(0), self.block)
        self.grams = grams
        self.at = np.flatnonzero(self.left[: len(grams)] >= self.block)
        self.unique, self.inverse, self.count = np.unique(grams[self.at], return_inverse=True, return_counts=True)
        bucket = ((self.unique >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.spans = _Spans(bucket[self.order])

    def _words(self, seed: int) -> np.ndarray:
        """Hashes of all words, of about 4 MB of text at a time."""
        out, i = [np.empty(0, dtype=np.uint64)], 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + HASH_BYTES)))
            low, high = self.starts[i], self.ends[j - 1]
            out.append(word_hashes(self.buf[low:high], self.starts[i:j] - low, self.ends[i:j] - low, seed))
            i = j
        return np.concatenate(out)

    def probes(self) -> list[pa.Array]:
        """bucket, and its hashes as remainders with two flags: stands on a block border; occurs twice or more here."""
        blocks = np.unique(self.grams[self.at[self.in_doc[self.at] % self.block == 0]])
        aligned = np.zeros(len(self.unique), dtype=np.uint32)
        aligned[np.searchsorted(self.unique, blocks)] = 1
        low = (self.unique.astype(np.uint32) & _REMAINDER) | aligned << 30 | (self.count > 1).astype(np.uint32) << 31
        return [pa.array(self.spans.buckets), self.spans.packed(low[self.order])]

    def extend(self, hits: dict[int, bytes]):
        """Set .spots, .wide, .first, .place: windows around hits, their distinct hashes and where these stand first."""
        hit = np.zeros(len(self.unique), dtype=bool)
        for b, bits in hits.items():
            i, j = self.spans.of(b)
            hit[self.order[i:j]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=j - i).astype(bool)
        near = np.zeros(len(self.grams) + 1, dtype=np.int64)
        near[1 + self.at] = hit[self.inverse]
        near = np.cumsum(near)
        spots = np.flatnonzero(self.left >= self.window)
        self.spots = spots[near[spots + self.window - self.block + 1] > near[spots]]
        a = self._wide(self.grams, 0)
        self.wide, self.first, self.place = np.unique(a, return_index=True, return_inverse=True)
        if len(self.spots):
            b = self._wide(gram_hashes(self._words(1), self.block, 1), 1)[self.first]
        else:
            b = np.empty(0, dtype=np.uint64)
        bucket = (b % np.uint64(self.buckets)).astype(np.int32)
        self.check = (b >> np.uint64(32)).astype(np.uint32)
        self.wide_order = np.lexsort((self.first, bucket))
        self.wide_spans = _Spans(bucket[self.wide_order])

    def _wide(self, grams: np.ndarray, seed: int) -> np.ndarray:
        return _join(grams[self.spots], grams[self.spots + self.window - self.block], seed)

    def windows(self) -> list[pa.Array]:
        """bucket, hashes, check hashes, ids of the first document."""
        owner, order, spans = self.keys[self.doc[self.spots[self.first]]], self.wide_order, self.wide_spans
        return [pa.array(spans.buckets), *[spans.packed(x[order]) for x in (self.wide, self.check, owner)]]

    def covered(self, later: dict[int, bytes]) -> np.ndarray:
        """Whether each word lies in a window that also starts earlier."""
        again = np.zeros(len(self.wide), dtype=bool)
        for b, bits in later.items():
            i = self.wide_order[slice(*self.wide_spans.of(b))]
            again[i] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(i)).astype(bool)
        repeat = again[self.place] | (self.first[self.place] != np.arange(len(self.spots)))
        step = np.zeros(len(self.starts) + 1, dtype=np.int32)
        starts = self.spots[repeat]
        np.add.at(step, starts, 1)
        np.add.at(step, starts + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _marks(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True)
    return {b: bits for k, b, bits in rows if k == kind}


def _match(table: pa.Table) -> pa.Table:
    """Of one bucket: per chunk, which of its hashes occur twice or more and are a block."""
    low, sizes = _unpacked(table.column("low"), np.uint32)
    _, inverse = np.unique(low & _REMAINDER, return_inverse=True)
    often = np.bincount(inverse, weights=1 + (low >> 31)) >= 2
    block = np.bincount(inverse, weights=low >> 30 & 1) > 0
    return _bits(table, (often & block)[inverse], sizes, 0)


def _first(table: pa.Table) -> pa.Table:
    """Of one bucket: per chunk, which of its hashes stand first in another chunk."""
    table = table.sort_by("chunk")
    hashes, sizes = _unpacked(table.column("wide"), np.uint64)
    check, owner = _unpacked(table.column("check"), np.uint32)[0], _unpacked(table.column("owner"), np.int64)[0]
    order = np.argsort(owner, kind="stable")  # by document, then chunk
    order = order[np.argsort(hashes[order], kind="stable")]
    ranked = hashes[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.zeros(len(hashes), dtype=bool)
    later[order] = ~head & (check[leader] == check[order])
    return _bits(table, later, sizes, 1)


def _bits(table: pa.Table, mask: np.ndarray, sizes: np.ndarray, kind: int) -> pa.Table:
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(mask)])
    some = np.flatnonzero(total[ends] > total[ends - sizes])
    packed = [np.packbits(mask[ends[i] - sizes[i] : ends[i]]).tobytes() for i in some.tolist()]
    rows = table.select(["chunk", "bucket"]).take(pa.array(some))
    return pa.table({"chunk": rows.column("chunk"), "kind": pa.array([kind] * len(some), pa.int32()), "bucket": rows.column("bucket"), "bits": pa.array(packed, pa.binary())})


_MARKS = "chunk int, kind int, bucket int, bits binary"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_repeats (maximal covered runs), kept_sha256[, kept_text].

    The number of chunks and of buckets grows with the bytes of text, so that either fits a task at any size.
    """
    spark = docs.sparkSession
    size = total_bytes(docs, text_col)
    chunks = max(2 * partitions(spark), -(-size // CHUNK_BYTES))
    buckets = max(32, -(-size // BUCKET_BYTES))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("chunk"))

    def rows_of(table: pa.Table, columns: list[pa.Array], names: list[str]) -> pa.Table:
        chunk = np.full(len(columns[0]), table.column("chunk")[0].as_py() if table.num_rows else 0, dtype=np.int32)
        return pa.table([pa.array(chunk), *columns], names=["chunk", *names])

    def probe(table: pa.Table) -> pa.Table:
        return rows_of(table, _Chunk(table, window, buckets).probes(), ["bucket", "low"])

    def extend(table: pa.Table, marks: pa.Table) -> pa.Table:
        columns = [pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 3]
        if marks.num_rows:
            chunk = _Chunk(table, window, buckets)
            chunk.extend(_marks(marks, 0))
            columns = chunk.windows()
        return rows_of(table, columns, ["bucket", "wide", "check", "owner"])

    def cover(table: pa.Table, marks: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, buckets)
        covered = None
        if marks.num_rows:
            chunk.extend(_marks(marks, 0))
            covered = chunk.covered(_marks(marks, 1))
        n_words, n_removed, n_repeats, digest, kept_text = [], [], [], [], []
        for k, text in enumerate(chunk.texts):
            words = text.split()
            gone = covered[chunk.bounds[k] : chunk.bounds[k + 1]] if covered is not None else None
            removed = int(gone.sum()) if gone is not None else 0
            kept = b" ".join(compress(words, (~gone).tolist()) if removed else words)
            n_words.append(len(words))
            n_removed.append(removed)
            n_repeats.append(int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()) if removed else 0)
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode())
        out = {"doc_id": pa.array(chunk.ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_repeats": pa.array(n_repeats, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {}))

    by_chunk = dealt.groupBy("chunk")
    probes = by_chunk.applyInArrow(probe, "chunk int, bucket int, low binary")
    hits = probes.groupBy("bucket").applyInArrow(_match, _MARKS)
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend, "chunk int, bucket int, wide binary, check binary, owner binary")
    later = windows.groupBy("bucket").applyInArrow(_first, _MARKS)
    schema = "doc_id long, n_words long, n_removed long, n_repeats long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return by_chunk.cogroup(hits.unionByName(later).groupBy("chunk")).applyInArrow(cover, schema)
