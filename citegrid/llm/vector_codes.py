"""Vector compression by product codes: Lloyd's rounds with trees over both the vector parts and the codebook entries.

Vectors become integers, floor(SCALE * x), cut into PARTS equal parts; each part position has a codebook. Blocks of vectors are
written once, each with one tree a part: boxes (least and greatest components), sums and counts of halves, quarters and so on.
A round ships the codebooks (of bounded size) to the tasks, which walk each block's tree together with a tree over
the entries, level by level. A pair of nodes whose boxes are further apart than some entry surely is from every vector of the
node goes. A node left with one entry is assigned as a whole, by its cached sums; where several are left at a leaf,
distances in integers decide, ties to the lower index. Sums by entry are added up in the task and then by Spark; to the
driver go entries * components numbers. The result does not depend on blocks or trees.

All arithmetic is exact: 64-bit integers up to WIDE in size, Python's integers beyond it. Components are held to +-LIMIT (x of
4.5e15), and errors to the greatest long.

Edge cases: vectors that are null, empty or hold null or non-finite components are dropped; so are those of another length
than the first kept one, or if the parts would not be equal; with fewer vectors than entries each starts an entry; rows without
an id are coded but start no entry; equal ids are coded each, and start entries in the order of their components; without any
vector that could start an entry there is no codebook and no row; null labels are one group; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import releasing, written

#: Parts of a vector, entries of a codebook, rounds, factor of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and of a leaf of its trees at most.
BLOCK, LEAF = 4096, 16
WIDE, LIMIT, LONG_MAX = 1 << 28, 1 << 62, (1 << 63) - 1


def is_wide(values: np.ndarray) -> bool:
    """Whether squares of differences may not fit 64 bits."""
    return bool(values.size) and max(-int(values.min()), int(values.max())) > WIDE


class Tree(NamedTuple):
    """A balanced tree over points in its own order: node 0 is the root, 2i + 1 and 2i + 2 are below i, node i holds points start[i] to end[i]."""

    depth: int
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def _ends(n: int, leaf: int) -> tuple[int, list[np.ndarray]]:
    """Depth of a tree over n points, and where the nodes of each level begin and end."""
    cuts, depth = np.array([0, n]), 0
    levels = [cuts]
    while -(-n >> depth) > leaf and n >> (depth + 1):
        middle = (cuts[:-1] + cuts[1:]) // 2
        cuts, depth = np.append(np.stack([cuts[:-1], middle], axis=1).ravel(), n), depth + 1
        levels.append(cuts)
    return depth, levels


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of a tree: halved at the median of the widest component until a node holds `leaf` points at most."""
    order = np.arange(len(points))
    for cuts in _ends(len(points), leaf)[1][:-1]:
        for a, b in pairwise(cuts.tolist()):
            own = points[order[a:b]]
            widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
    return order


def tree_over(points: np.ndarray, leaf: int) -> Tree:
    """Boxes and sums of the nodes over points in tree order."""
    depth, levels = _ends(len(points), leaf)
    running = np.concatenate([np.zeros_like(points[:1]), np.cumsum(points, axis=0)])
    start, end = np.concatenate([c[:-1] for c in levels]), np.concatenate([c[1:] for c in levels])
    low, high = ([f.reduceat(points, levels[-1][:-1], axis=0)] for f in (np.minimum, np.maximum))
    for _ in range(depth):
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
    return Tree(depth, start, end, np.concatenate(low), np.concatenate(high), running[end] - running[start])


def _squares(gap: np.ndarray) -> np.ndarray:
    return (gap * gap).sum(axis=-1)


def assign(points: np.ndarray, tree: Tree, book: Book) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The nearest entry of each point (in tree order), of equally near ones the first.

    Returns (node, entry) for the nodes assigned as a whole, and the places and entries of the other points.
    """
    above = book.tree
    whole, left, codes = [], [], []
    node, other = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    level = 0
    while len(node):
        nearest = _squares(np.maximum(0, np.maximum(tree.low[node] - above.high[other], above.low[other] - tree.high[node])))
        furthest = _squares(np.maximum(tree.high[node] - above.low[other], above.high[other] - tree.low[node]))
        first = np.flatnonzero(np.diff(node, prepend=-1))
        bound = np.minimum.reduceat(furthest, first)  # pairs of a node stand together
        keep = nearest <= np.repeat(bound, np.diff(np.append(first, len(node))))
        node, other = node[keep], other[keep]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        count = np.diff(np.append(first, len(node)))
        alone = np.repeat(count == 1, count) & (above.end[other] - above.start[other] == 1)
        whole += zip(node[alone].tolist(), book.order[above.start[other[alone]]].tolist(), strict=True)
        node, other = node[~alone], other[~alone]
        if not len(node):
            break
        if level >= tree.depth:
            if level >= above.depth:
                break
            down = [(node, 2 * other + 1), (node, 2 * other + 2)]
        elif level >= above.depth:
            down = [(2 * node + 1, other), (2 * node + 2, other)]
        else:
            down = [(2 * node + i, 2 * other + j) for i in (1, 2) for j in (1, 2)]
        node, other = (np.concatenate([d[i] for d in down]) for i in (0, 1))
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]
        level += 1
    first = np.flatnonzero(np.diff(node, prepend=-1))
    for i, j in pairwise([*first.tolist(), len(node)]):
        own = slice(tree.start[node[i]], tree.end[node[i]])
        near = np.sort(np.concatenate([book.order[above.start[o] : above.end[o]] for o in other[i:j]]))
        left.append(np.arange(own.start, own.stop))
        codes.append(near[np.argmin(_squares(points[own][:, None, :] - book.entries[near][None, :, :]), axis=1)])
    none = [np.empty(0, dtype=np.int64)]
    return whole, np.concatenate(left or none), np.concatenate(codes or none)


def nearest_entries(points: np.ndarray, tree: Tree, book: Book) -> np.ndarray:
    whole, left, codes = assign(points, tree, book)
    out = np.empty(len(points), dtype=np.int64)
    out[left] = codes
    for node, entry in whole:
        out[tree.start[node] : tree.end[node]] = entry
    return out


def entry_sums(points: np.ndarray, tree: Tree, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points of each entry; nodes assigned as a whole by their cached sums."""
    whole, left, codes = assign(points, tree, book)
    total, count = np.zeros(book.entries.shape, dtype=points.dtype), np.bincount(codes, minlength=len(book.entries))
    np.add.at(total, codes, points[left])
    if whole:
        node, entry = np.array(whole).T
        np.add.at(total, entry, tree.total[node])
        np.add.at(count, entry, tree.end[node] - tree.start[node])
    return total, count


class Book:
    """The entries of one part, with a tree over them."""

    def __init__(self, entries: np.ndarray, wide: bool):
        self.entries = entries.astype(object if wide else np.int64)
        self.order = tree_order(self.entries, 1)
        self.tree = tree_over(self.entries[self.order], 1)


def sha256_of(codebooks: np.ndarray) -> str:
    """Of the decimal integers by part, entry and component."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """The components of vectors as integers, one row a vector."""
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64).reshape(-1, width)


_TREE = "array<struct<points: binary, place: binary>>"


def blocks(rows: DataFrame, width: int, parts: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """rows (id, label, vector) as a written table of blocks: ids, labels, and per part the points in tree order and their places."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("trees", T._parse_datatype_string(_TREE))])
    kind = pa.list_(pa.struct([("points", pa.binary()), ("place", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                own, made = batch.slice(at, block), []
                for points in np.split(integers(own.column(2), width), parts, axis=1):
                    order = tree_order(points, leaf)
                    made.append({"points": points[order].astype(np.int64 if is_wide(points) else np.int32).tobytes(), "place": order.astype(np.int32).tobytes()})
                lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([made], kind)], names=schema.names)

    return written(rows.select("id", "label", "vector").mapInArrow(releasing(run), schema), "vector-blocks")


class _Read:
    """The parts of written blocks, as trees, and the codebooks in the form that each needs."""

    def __init__(self, codebooks: np.ndarray, leaf: int):
        self.codebooks, self.leaf, self.books, self.wide = codebooks, leaf, {}, is_wide(codebooks)

    def parts(self, trees: list[dict]) -> Iterator[tuple[int, np.ndarray, Tree, Book, np.ndarray]]:
        """Per part: its number, points, tree and book, and the places of its points in the block."""
        for part, stored in enumerate(trees):
            place = np.frombuffer(stored["place"], dtype=np.int32)
            narrow = len(stored["points"]) == 4 * len(place) * self.codebooks.shape[2]
            points = np.frombuffer(stored["points"], dtype=np.int32 if narrow else np.int64).reshape(len(place), -1)
            wide = self.wide or not narrow
            points = points.astype(object if wide else np.int64)
            if (part, wide) not in self.books:
                self.books[part, wide] = Book(self.codebooks[part], wide)
            yield part, points, tree_over(points, self.leaf), self.books[part, wide], place


_SUMS = "part int, entry int, component int, total decimal(38,0), n long"


def next_codebooks(made: DataFrame, codebooks: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """One round: every entry becomes the floor of its parts' mean; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, shape = _Read(codebooks, leaf), codebooks.shape
        total, count = np.zeros(shape, dtype=object), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for part, points, tree, book, _ in read.parts(trees.as_py()):
                    sums, n = entry_sums(points, tree, book)
                    total[part] += sums
                    count[part] += n
        part, entry = np.nonzero(count)
        keys = [np.repeat(x, shape[2]) for x in (part, entry)] + [np.tile(np.arange(shape[2]), len(part))]
        sums = pa.array([decimal.Decimal(x) for x in total[part, entry].ravel().tolist()], pa.decimal128(38, 0))
        columns = [*[pa.array(k, pa.int32()) for k in keys], sums, pa.array(np.repeat(count[part, entry], shape[2]), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SUMS.split(", ")])

    sums = made.select("trees").mapInArrow(releasing(run), _SUMS).groupBy("part", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = codebooks.copy()
    for r in sums.collect():  # a row for each component of the codebooks at most
        out[r["part"], r["entry"], r["component"]] = int(r["total"]) // r["n"]
    return out


def coded(made: DataFrame, codebooks: np.ndarray, leaf: int = LEAF) -> DataFrame:
    """id, label, code, error of every vector in the blocks."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", made.schema["labels"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Read(codebooks, leaf)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(row, 1).flatten() for c in (0, 1))
                codes, error = np.empty((len(ids), len(codebooks)), dtype=np.uint8), np.zeros(len(ids), dtype=object)
                for part, points, tree, book, place in read.parts(batch.column(2)[row].as_py()):
                    found = nearest_entries(points, tree, book)
                    codes[place, part] = found
                    error[place] += _squares(points - book.entries[found])
                digits, step = codes.tobytes().hex(), 2 * len(codebooks)
                code = [digits[i : i + step] for i in range(0, len(digits), step)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array([min(e, LONG_MAX) for e in error.tolist()], pa.int64())], names=schema.names)

    return made.mapInArrow(releasing(run), schema)


def product_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The written codes (id, label, code, error) of all vectors, and the codebooks (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: entries must be 1 to 256")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kept = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite)
    first = kept.where("id IS NOT NULL").orderBy("id", "vector")
    width = len(head[0]["vector"]) if (head := first.take(1)) else parts
    kept = kept.where(F.size("vector") == width)
    starts = [r["vector"] for r in first.where(F.size("vector") == width).take(entries)]
    made = blocks(kept if starts else kept.where("false"), width, parts)
    whole = integers(pa.array(starts, pa.list_(pa.float64())), width).reshape(len(starts), parts, width // parts)
    codebooks = np.ascontiguousarray(whole.transpose(1, 0, 2))
    for _ in range(rounds if starts else 0):
        codebooks = next_codebooks(made, codebooks)
    return written(coded(made, codebooks), "codes"), codebooks


def compressed_vectors(rows: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    codes, codebooks = product_codes(rows)
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by_label = written(by_label.withColumn("label_error", F.least("label_error", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")), "label-errors")
    joined = codes.join(by_label, F.equal_null(F.col("label"), F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(sha256_of(codebooks)).alias("codebooks_sha256"))
