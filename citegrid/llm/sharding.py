"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking (native Spark only).

Law `rows`: every row gets a global number (its place in the order of id, then text), a keyed permutation of
0..n-1 scatters the numbers, and shard = p mod shards, slot = p div shards. Shards differ by one row at most,
slots are gapless, and both follow from the number, n and the seed alone.

Only id, size, checksum and a hash of the text are sorted and written, never texts.

Edge cases: a null text has size 1 and checksum 0 (as an empty one); a very long text is read once, for its size and sums;
null ids come first; rows that are equal in id and text are interchangeable and get different places, but are sorted by one
task; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank

#: Rounds of the Feistel network, and steps of the walk after which a row would be an error.
ROUNDS, WALK = 8, 64


def permuted(x: str, n: int, seed: int = 42) -> str:
    """SQL of the place of row number `x` among n under the keyed permutation.

    The network works on pairs (l, r) with l < a, r < b for the smallest near-square a * b >= n: each round adds a
    keyed hash of one half to the other, modulo its size, so it is a bijection of a * b values. Values of n or more
    walk on; fewer than a of them exist, so a walk of WALK steps is left with a chance under n ** (-WALK / 2), and
    for small n it cannot happen at all.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def perm(v: str) -> str:
        left = f"named_struct('l', (s.l + pmod(xxhash64(s.r, i, {seed}L), {a}L)) % {a}L, 'r', s.r)"
        right = f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64(s.l, i, {seed}L), {b}L)) % {b}L)"
        return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {v} div {b}L, 'r', {v} % {b}L), (s, i) -> if(i % 2 = 0, {left}, {right}), s -> s.l * {b}L + s.r)"

    steps = min(WALK, a * b - n + 1)
    return (
        f"aggregate(sequence(1, {steps}), {perm(x)}, (y, j) -> if(y < {n}L, y, {perm('y')}), "
        f"y -> if(y < {n}L, y, cast(raise_error('cycle walk too long') as bigint)))"
    )


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 42) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null under this law), row_number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    rows = global_rank(slim, [F.asc_nulls_first("doc_id"), F.asc("_tie")], "row_number")
    n = rows.count()
    return (
        rows.withColumn("_p", F.expr(permuted("row_number", n, seed)))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
            (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "row_number",
        )
    )
