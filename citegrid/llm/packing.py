"""Harmonic packing of token sequences.

A piece of length l belongs to class k = capacity div l, so that its length lies in (capacity/(k+1), capacity/k], and
a bin of class k takes exactly k pieces. Which bin a piece goes to follows from its rank within its class, so classes
are filled independently: each task ranks its own pieces, and one count a task and class turns these into global ranks.
Documents are cut where that saves padding: full bins first; a rest stays whole if it fills its class to 1/17 or
better, else a piece of the next class's capacity is cut off it. The at most one unfilled bin of each class are put
together first-fit (no more bins than there are classes, whatever the input).

Ids are those of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`: the string of an added token (here
`<|endoftext|>`) inside a text is that token's id.

Edge cases: a null or empty text is the single end token; a long text is encoded and cut like any other, with memory for
itself and its ids; repeated rows and equal ids are packed each; pieces of one length are ranked as their tasks read them, so
that which bin of a class each gets is not fixed by its content; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, written

#: Tokens of a sequence; a rest of r tokens stays whole if at most r / SLACK tokens of its class's share stay unused.
CAPACITY, SLACK = 1024, 16
_ENCODER: dict = {}


def _byte_chars() -> dict[str, int]:
    """Byte-level BPE writes each byte as one visible character: printable Latin-1 as itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """The byte-level BPE of a tokenizers file: a text to the bytes of its little-endian 32-bit ids.

    The file's added tokens are cut out of a text first and stand for themselves, as in `tokenizers`; what lies between
    them is encoded part by part with the file's vocabulary and merges, which tiktoken runs faster.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.added}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if not any(a in text for a in self.added):
            return array("I", self.encode(text)).tobytes()
        return b"".join([self.added.get(p) or array("I", self.encode(p)).tobytes() for p in self.cut(text)])


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _ENCODER:
        _ENCODER[path] = Encoder(path)
    return _ENCODER[path]


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of so many tokens."""
    out, rest = [capacity] * (tokens // capacity), tokens % capacity
    while rest:
        k = capacity // rest
        piece = rest if (capacity // k - rest) * SLACK <= rest else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, part int, place long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with their class k and their rank (part, place) in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, places, cuts = encoder(tokenizer), TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            doc, start, length, crc, total, klass, parts, place = out
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + b"\0\0\0\0")
                n, at = len(ids) // 4, 0
                if n not in cuts:
                    cuts[n] = cut(n, capacity)
                for size in cuts[n]:
                    k = capacity // size
                    doc.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    klass.append(k)
                    parts.append(part)
                    place.append(places.get(k, 0))
                    places[k] = place[-1] + 1
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int32() if j in (5, 6) else pa.int64()) for j, x in enumerate(out)], names=[x.split()[0] for x in _PIECES.split(", ")]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(run), _PIECES)


def _merge_rests(fills: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """First-fit decreasing over the one unfilled bin of each class: class to (bin, offset in it)."""
    bins: list[int] = []
    at = {}
    for k, fill in sorted(fills.items(), key=lambda x: (-x[1], x[0])):
        b = next((j for j, used in enumerate(bins) if used + fill <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        at[k] = b, bins[b]
        bins[b] += fill
    return at


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    To the driver go sums by class only, of which there are at most `capacity`.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    counts = made.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = made.join(counts.select("k", "part", before.alias("before")), ["k", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    classes, base = [], 0
    for k, n in sorted(totals.items()):
        classes.append((k, n // k, base))
        base += n // k
    bounds = spark.createDataFrame(classes, "k int, full long, base long")
    ranked = ranked.join(F.broadcast(bounds), "k").withColumn("bin", F.expr("rank div k"))
    fills = {r["k"]: r["fill"] for r in ranked.where("bin = full").groupBy("k").agg(F.sum("length").alias("fill")).collect()}
    rests = [(k, base + b, at) for k, (b, at) in _merge_rests(fills, capacity).items()]
    rest = spark.createDataFrame(rests, "k int, rest_id long, rest_at long")
    inside = F.sum("length").over(Window.partitionBy("k", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    last = F.col("bin") == F.col("full")
    return (
        ranked.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(F.broadcast(rest), "k", "left")
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.when(last, F.col("rest_id")).otherwise(F.col("base") + F.col("bin")).alias("sequence_id"),
            (F.when(last, F.col("rest_at")).otherwise(F.lit(0)) + F.col("inside")).alias("offset"),
        )
    )
