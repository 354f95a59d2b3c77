"""Near copies: SimHash groups and bands of minimal shingles as candidates, exact Jaccard similarity of word shingles as the test.

SimHash alone cannot find all pairs at 0.8 or more: such sets differ in about 10 of 64 bits on average, and no choice of
bits that all such pairs share is selective. So there are two steps:
  groups   SimHash links (MAX_BITS) give each group's smallest member as the root of a star. Every edge of a star is tested
           exactly, and what holds is connected: large groups of close copies are done with, without their pairs.
  bands    a set has BANDS keys of ROWS minimal shingle hashes each; sets at similarity j share one with chance
           1 - (1 - j ** ROWS) ** BANDS, at 0.8 all but 5 in a million. Keys whose members are connected already bring nothing
           new and are dropped. In the others, sketches (SKETCH four-bit minima) are compared, in tiles of bounded size:
           pairs with fewer than ALIKE equal minima are unlike (at 0.8 all but 2 in 10,000 have more; at 0.42, 1 in 10
           million has). What the sketches link is a family; only its sets are made again from the texts and compared, pair by
           pair where not connected already, on bits of the shingles that the sets of a tile share.
Text that many documents share gives common keys, but no links of sketches, so its documents' sets are never shipped. A
family is dealt into parts of PART sets, and a set goes to as many tiles as its family has parts: a family of thousands of
texts that are alike at 0.7 to 0.8 and yet not connected costs the square of its parts. Only stars of connected groups leave a tile.

Shingles are told apart by 64-bit hashes, sets by 128 bits. Words are op7's (A-Z lowered, split at white space).

Edge cases: fewer words than a shingle are one shingle; texts without words are equal to each other; a very long text is
hashed piece by piece; rows without an id get no component and link nothing; repeated rows are copies; an empty table gives
no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, written
from .simhash import components, dealt, gathered, joined, links, majority, shingle_hashes, tile_columns
from .text_kernels import mix

#: Words of a shingle; sets of a family in one part of a tile. The similarity is 4/5, in whole numbers below.
SHINGLE, PART = 5, 512
#: Keys of a set, and minimal hashes of a key; minima of a sketch, how many of them alike sets have equal, members of a tile of sketches.
BANDS, ROWS, SKETCH, ALIKE, TILE = 40, 6, 128, 88, 1024
#: Shingles and rows that a worker holds before it hands them on; shingles whose minima are taken at once.
GROUP_SHINGLES, GROUP_ROWS, SLICE = 1 << 19, 1024, 1024
_SETS, _MARKS = "doc_id long, node long, check long, grams array<long>", "doc_id long, node long, check long, fp long, bands array<long>, sketch binary"
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def similar(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members with such an overlap have Jaccard similarity 4/5 or more."""
    return 9 * overlap >= 4 * (a + b)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Ids, shingle hashes in order, their sets and the sets' 128-bit digests, of some rows at a time."""
    import xxhash

    ids, lists, held = [], [], 0
    for i, (key, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True), 1):
        ids.append(key.as_py())
        lists.append(shingle_hashes(text.as_py() or "", SHINGLE))
        held += len(lists[-1])
        if held >= GROUP_SHINGLES or len(ids) >= GROUP_ROWS or i == batch.num_rows:
            sets = [np.unique(x) for x in lists]
            yield ids, lists, sets, np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
            ids, lists, held = [], [], 0


def sets_of(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text): the set of shingle hashes of each row and its digest (node, check)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, sets, digests in _hashed(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists(sets)], names=_names(_SETS))

    return docs.mapInArrow(releasing(run), _SETS)


def minima(own: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hashes over a set of shingles; without shingles the greatest number there is."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), SLICE):
        np.minimum(low, (own[i : i + SLICE, None] * _FACTORS[None, :]).min(axis=0), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """The keys of a set, from its minima."""
    keys = np.zeros(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + row)
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def sketch_of(low: np.ndarray) -> bytes:
    """Four bits of each of the first SKETCH minima, two in a byte."""
    bits = (mix(low[:SKETCH]) & np.uint64(15)).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).tobytes()


def alike(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches (rows of 64-bit words) of each pair have ALIKE or more equal minima."""
    differ = sketches[a] ^ sketches[b]
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    return SKETCH - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64) >= ALIKE


def marks(docs: DataFrame) -> DataFrame:
    """Per row: the digest of its set (node, check), its SimHash, its keys and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lists, sets, digests in _hashed(batch):
                columns = [ids, digests[:, 0], digests[:, 1], [majority(x) for x in lists]]
                lows = [minima(s) for s in sets]
                sketches = pa.array([sketch_of(low) for low in lows], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], _lists([bands_of(low) for low in lows]), sketches], names=_names(_MARKS))

    return docs.mapInArrow(releasing(run), _MARKS)


def _stars(root: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, other id) of the groups of ids in ascending order, given the place of each one's first member."""
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[other]], ids[other]


def alike_groups(ids: np.ndarray, comp: np.ndarray, sketches: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of what the sketches of a tile link across components; between the two parts of a tile if it has two."""
    order = np.argsort(ids)
    ids, comp, part = ids[order], comp[order], part[order]
    words = np.frombuffer(b"".join(sketches[order].tolist()), dtype=np.uint64).reshape(len(ids), -1)
    two, found = part.min() != part.max(), []
    for i in range(0, len(ids), 128):
        rows = np.arange(i, min(i + 128, len(ids)))
        keep = (comp[rows, None] != comp[None, i:]) & (rows[:, None] < np.arange(i, len(ids))[None, :])
        if two:
            keep &= part[rows, None] != part[None, i:]
        a, b = np.nonzero(keep)
        a, b = a + i, b + i
        keep = alike(words, a, b)
        found.append(np.stack([a[keep], b[keep]]))
    a, b = np.concatenate(found, axis=1)
    return _stars(joined(len(ids), a, b), ids)


def families(nodes: DataFrame) -> DataFrame:
    """family, id, comp of nodes (id, comp, bands, sketch): those whose sketches are linked across components."""
    payload = ["id", "comp", "sketch"]
    keyed = nodes.select(*payload, F.explode("bands").alias("key"))
    # All of this is combined before the shuffle; most keys stand in one set or one component, and their rows go no further.
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    members = dealt(keyed, written(sizes.select("key", "n"), "mixed"), ["key"], "id", TILE, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alike_groups(*tile) for tile in tile_columns(batch)]
            a, b = (np.concatenate([f[j] for f in found]) if found else np.empty(0, dtype=np.int64) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    linked = gathered(members, ["key"], payload).mapInArrow(releasing(run), "a long, b long").distinct()
    return components(linked).select(F.col("root").alias("family"), "id").join(nodes.select("id", "comp"), "id")


def similar_pairs(sets: list[np.ndarray], part: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets that are similar and not of one component; between the two parts of a tile if it has two."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # shingles of one set alone are in no overlap
    bits = np.zeros((len(sets), (int((count > 1).sum()) + 63) // 64 * 8), dtype=np.uint8)
    for row, own in zip(bits, np.split(inverse, np.cumsum(size)[:-1]), strict=True):
        at = column[own[count[own] > 1]]
        np.bitwise_or.at(row, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    words, two, found = bits.view(np.uint64), part.min() != part.max(), []
    for i in range(len(sets) - 1):
        other = np.arange(i + 1, len(sets))
        other = other[(comp[other] != comp[i]) & ((part[other] != part[i]) | (not two))]
        other = other[similar(np.minimum(size[other], size[i]), size[other], size[i])]
        overlap = np.bitwise_count(words[i] & words[other]).sum(axis=1, dtype=np.int64)
        other = other[similar(overlap, size[other], size[i])]
        found.append((np.full(len(other), i), other))
    return tuple(np.concatenate([f[j] for f in found]) if found else np.empty(0, dtype=np.int64) for j in (0, 1))


def sets_for(ids: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, grams: the written shingle sets of the nodes with these ids (a column id), made again from their texts."""
    wanted = written(nodes.join(ids, "id", "left_semi").select("node", "check", F.col("id").alias("doc_id")), "wanted")
    # Ids may repeat with other texts, and rows as they are: digests choose, and equal sets are combined before the shuffle.
    sets = sets_of(docs.join(wanted.select("doc_id"), "doc_id", "left_semi")).join(wanted, ["doc_id", "node", "check"], "left_semi")
    return written(sets.groupBy(F.col("doc_id").alias("id")).agg(F.first("grams").alias("grams")), "sets")


def _rows(table: pa.Table, *names: str) -> tuple[list[np.ndarray], ...]:
    """The sets of a tile's rows by id, and other columns in that order."""
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    grams = [x.values.to_numpy() for x in table.column("grams").combine_chunks().take(pa.array(order))]
    return grams, *[table.column(n).to_numpy()[order] for n in ("id", *names)]


def similar_to_root(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Those edges of stars (a, b) whose sets are similar. A star is dealt into parts of PART edges, each with the root's set."""
    parts = stars.groupBy("a").agg(F.expr(f"cast(ceil(count(1) / {PART}) as int)").alias("parts"))
    stars = stars.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    roots = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    shipped = stars.select("a", "part", F.col("b").alias("id")).unionByName(roots).join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        grams, ids = _rows(table)  # the root has the smallest id
        size = np.array([len(g) for g in grams], dtype=np.int64)
        overlap = np.array([len(np.intersect1d(grams[0], g, assume_unique=True)) for g in grams], dtype=np.int64)
        held = ids[1:][similar(overlap, size, size[0])[1:]]
        return pa.table([pa.array(np.full(len(held), ids[0])), pa.array(held)], names=["a", "b"])

    return shipped.groupBy("a", "part").applyInArrow(run, "a long, b long")


def similar_in_family(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b (a < b): edges that connect the similar nodes of each family, of rows (family, id, comp)."""
    payload = ["id", "comp"]
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    shipped = dealt(rows, sizes, ["family"], "id", PART, payload).join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        grams, ids, part, comp = _rows(table, "part", "comp")
        a, b = _stars(joined(len(ids), *similar_pairs(grams, part, comp)), ids)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return shipped.groupBy("family", "p", "q").applyInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable over pairs at 0.8 or more)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(marks(docs), "marks")
    nodes = marked.where("doc_id IS NOT NULL").groupBy("node", "check").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "bands", "sketch")])
    nodes = written(nodes, "nodes")

    def ends(edges: DataFrame) -> DataFrame:
        return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    stars = written(links(nodes.select("id", "fp")), "stars")
    close = written(similar_to_root(stars, sets_for(ends(stars), docs, nodes)), "close")
    parted = nodes.join(components(close), "id", "left").select("id", "bands", "sketch", F.coalesce("root", "id").alias("comp"))
    kin = written(families(written(parted, "parted")), "families")
    edges = close.unionByName(similar_in_family(kin, sets_for(kin.select("id"), docs, nodes)))
    named = nodes.join(components(edges), "id", "left").select("node", "check", F.coalesce("root", "id").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return marked.select("doc_id", "node", "check").join(written(named, "roots"), ["node", "check"], "left").select("doc_id", component.alias("component_id"))
