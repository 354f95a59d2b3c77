"""SimHash near-dedup through pivot distance tables.

Fingerprints link at MAX_BITS or fewer differing bits. REFERENCES are reference fingerprints, and the pivot table, written
once, holds the Hamming distance of each fingerprint to each of them, block of bits by block of bits (a block's distances
are packed in one long; over all blocks they add up to the distance as a whole). In a block the distances of x and y to a
reference differ by at most the bits in which x and y differ there, and these add up to MAX_BITS at most over the blocks.
So a linked pair has all coordinates equal in all but MAX_BITS of the blocks: the cells of the table for each choice of
(blocks - MAX_BITS) blocks bring candidates together, and no pair of other cells is looked at. Of the candidates, those with
a difference above MAX_BITS in any of the eight distances as a whole (from the table too) are discarded, and the Hamming
distance verifies the rest. One distance as a whole is no key by itself: random fingerprints have |d(x, r) -
d(y, r)| <= 4 in 57 of 100 cases, so that sixteen references would still leave one chance pair of 8,000, of a square.
The number of blocks grows with the number of fingerprints, so that chance candidates stay below their number.

Equal fingerprints are one node. A cell with more than TILE members is parted again: what its members may differ in lies in
the other blocks, whose bits are cut into blocks anew. Members are then compared in tiles of bounded size, and a tile
gives a star for each group that it finds connected, never all its pairs. Components come from minimum labels with
pointer jumping.

Edge cases: texts without words (null, empty) have fingerprint zero and link like any other; fewer words than a shingle
are one shingle; a very long text is hashed by slices of its words; rows without an id get a fingerprint and no component, and link nothing;
repeated rows are copies; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .text_kernels import pieces
from .url_filter import BROADCAST_BLOCKS, bloom_blocks, possible

#: Words of a shingle, bits that linked fingerprints may differ in, members of a key in one part of a tile.
SHINGLE, MAX_BITS, TILE = 4, 4, 1024
#: References of the pivot table.
REFERENCES = tuple(x - (1 << 64) if x >> 63 else x for x in ((0x9E3779B97F4A7C15 * (2 * i + 1) ** 5) % (1 << 64) for i in range(8)))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, in the order of the text."""
    import xxhash

    digest, out, last = xxhash.xxh64_intdigest, [], []
    for piece in pieces(text.encode()):
        words = last + piece.lower().split()  # lower() of bytes changes A-Z only
        last = words[max(0, len(words) - shingle + 1) :]
        if len(words) < shingle:
            continue
        joined_words = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
        out.append(np.array([digest(joined_words[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64))
    if not out:
        return np.array([digest(b" ".join(last), 42)] if last else [], dtype=np.uint64)
    return np.concatenate(out)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed long."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): majority bits of the XXH64 of each word shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(x or "", shingle)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_count(n: int, max_bits: int = MAX_BITS) -> int:
    """Blocks at which n random fingerprints give fewer than n chance candidates over all cells; max_bits + 3 at least."""
    for blocks in range(max_bits + 3, 17):
        if n * comb(blocks, max_bits) < 2 ** (64 * (blocks - max_bits) / blocks + 1):
            return blocks
    return 16


def cut_bits(bits: list[int], blocks: int) -> list[int]:
    """The bits cut into so many blocks: masks as signed longs."""
    cuts = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def coordinates(fp: Column, mask: Column) -> Column:
    """Distances of a block's bits to the references, four or more bits each, as one long."""
    width = 64 // len(REFERENCES)
    return reduce(Column.bitwiseOR, [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r)).bitwiseAND(mask)).cast("long"), width * i) for i, r in enumerate(REFERENCES)])


def pivot_table(nodes: DataFrame, blocks: int) -> DataFrame:
    """id, fp, dist (the distances to the references, a byte each), c0, c1, ...: the coordinates by block."""
    away = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long") for r in REFERENCES]
    dist = reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * i) for i, d in enumerate(away)])
    return nodes.select("id", "fp", dist.alias("dist"), *[coordinates(F.col("fp"), F.lit(m)).alias(f"c{i}") for i, m in enumerate(cut_bits(list(range(64)), blocks))])


def split_again(large: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """Rows of too large cells (choice, cell, fp, ...) in cells of the blocks that they may still differ in."""
    rows, picks = [], list(combinations(range(blocks), blocks - max_bits))
    for i, pick in enumerate(picks):
        masks = cut_bits(list(range(64)), blocks)
        rest = [b for j in range(blocks) if j not in pick for b in range(64) if masks[j] >> b & 1]
        inner = cut_bits(rest, blocks)
        rows += [(i, k, [inner[j] for j in again]) for k, again in enumerate(picks)]
    plan = F.broadcast(large.sparkSession.createDataFrame(rows, "choice int, again int, masks array<long>"))
    inside = F.xxhash64("cell", "again", *[coordinates(F.col("fp"), F.col("masks")[j]) for j in range(blocks - max_bits)])
    return large.join(plan, "choice").withColumn("cell", inside).drop("again", "masks")


def sizes_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """The written sizes n of the keys with two members or more; counted with map-side combine."""
    return written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")


def dealt(rows: DataFrame, sizes: DataFrame, key: list[str], node: str, tile: int, payload: list[str]) -> DataFrame:
    """Members of the keys in sizes, each once for every tile of its key that it belongs to (p, q: the tile, part: its own).

    A key's members are dealt into parts of about `tile`; a tile is two parts, or one with itself. Most rows' keys are not in
    sizes: a Bloom filter of those that are, broadcast up to a bounded size, takes the others out before the join shuffles.
    """
    blooms, blocks = bloom_blocks(sizes.select(F.xxhash64(*key).alias("key")), sizes.count())
    if blocks <= BROADCAST_BLOCKS:
        probes = rows.select(F.struct(*rows.columns).alias("row"), F.xxhash64(*key).alias("key"))
        rows = possible(probes, blooms, blocks).select("row.*")
    parts = sizes.withColumn("parts", F.expr(f"cast(ceil(n / {tile}) as int)")).drop("n")
    member = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return member.select(*key, *payload, "part", other).select(*key, *payload, "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))


def gathered(members: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """One row a tile: m, an array of struct<payload..., part>."""
    tiles = members.groupBy(*key, "p", "q").agg(F.collect_list(F.struct(*payload, "part")).alias("m"))
    return tiles.where("size(m) > 1").select("m")


def tile_columns(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """The columns of each tile of a batch."""
    lists = batch.column(0)
    flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield [c[i:j] for c in columns]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the connected group of each of n members, from pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if np.array_equal(root, before):
            return root


def linked_groups(ids: np.ndarray, fps: np.ndarray, dist: np.ndarray, part: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(smallest id, other id) for the groups connected by links; between the two parts of a tile if it has two.

    A pair is discarded if it differs by more than max_bits in its distance to any reference; two references look at all
    pairs, the others at what these leave.
    """
    order = np.argsort(ids)
    ids, fps, part = ids[order], fps[order].view(np.uint64), part[order]
    away = np.ascontiguousarray(dist[order]).view(np.int8).reshape(-1, 8)
    first, second = np.ascontiguousarray(away[:, 0]), np.ascontiguousarray(away[:, 1])
    two, found = part.min() != part.max(), []
    for i in range(0, len(fps), 256):
        rows = slice(i, min(i + 256, len(fps)))
        keep = (np.abs(first[rows, None] - first[None, i:]) <= max_bits) & (np.abs(second[rows, None] - second[None, i:]) <= max_bits)
        a, b = np.nonzero(keep)
        a, b = a + i, b + i
        keep = (a < b) & ((part[a] != part[b]) | (not two))
        a, b = a[keep], b[keep]
        keep = (np.abs(away[a, 2:] - away[b, 2:]) <= max_bits).all(axis=1)
        a, b = a[keep], b[keep]
        keep = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        found.append(np.stack([a[keep], b[keep]]))
    a, b = np.concatenate(found, axis=1)
    root = joined(len(ids), a, b)
    other = np.flatnonzero(root != np.arange(len(ids)))
    return list(zip(ids[root[other]].tolist(), ids[other].tolist(), strict=True))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b (a < b): edges between the ids of nodes (id, fp) that connect all linked fingerprints.

    Cells are counted once; only what shares a cell is joined and shuffled again, and only too large cells are parted anew.
    """
    blocks = block_count(nodes.count(), max_bits)
    table = written(pivot_table(nodes, blocks), "pivots")
    picks = combinations(range(blocks), blocks - max_bits)
    cells = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), *[f"c{j}" for j in pick]).alias("cell")) for i, pick in enumerate(picks)])
    key, payload = ["choice", "cell"], ["id", "fp", "dist"]
    keyed = table.select(*payload, F.explode(cells).alias("k")).select(*payload, "k.choice", "k.cell")
    sizes = sizes_of(keyed, key)
    members = dealt(keyed, sizes.where(F.col("n") <= TILE), key, "fp", TILE, payload)
    large = sizes.where(F.col("n") > TILE)
    if not large.isEmpty():
        again = written(split_again(keyed.join(large.drop("n"), key), blocks, max_bits), "again")
        members = members.unionByName(dealt(again, sizes_of(again, key), key, "fp", TILE, payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for ids, fps, dist, part in tile_columns(batch):
                found.update(linked_groups(ids, fps, dist, part, max_bits))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return gathered(members, key, payload).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root of every id in edges (a, b): root is the smallest id that it is connected with.

    Each round takes the smallest label of the neighbours and then the label's label; rounds end when none changes.
    Every round is written to the shared folder. Joins are between written tables, so Spark can split a hot id.
    """
    edges = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("root")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        better = written(labels.join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        jump = better.select(F.col("id").alias("root"), F.col("root").alias("next"))
        labels = written(better.join(jump, "root").select("id", "old", F.least("root", "next").alias("root")), "labels")
        if labels.where("root <> old").isEmpty():
            return labels.select("id", "root")
        labels = labels.select("id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    roots = components(links(nodes, max_bits))
    named = written(nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id")), "roots")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
