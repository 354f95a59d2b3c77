"""Periodic runs of words, found by an online sparse dynamic program over diagonals.

A run is a stretch of words that repeat with a smallest period q, of max(MIN_WORDS, TIMES * q) words or more, that no word
beside it extends. The words are read once, from left to right. The diagonal of lag d holds how many words up to the present
one equal the word d places before; a word's earlier occurrences make their diagonals longer by one, every other diagonal
ends, and one that ends with d + matches >= max(MIN_WORDS, TIMES * d) gives its run at once. Of diagonals that end together
and began together the smallest lag is the period.

What keeps the diagonals sparse, and loses no run:
  seeds    a run's diagonal has SEED matches or more, so an earlier occurrence is one of the last SEED words together, and a
           diagonal starts where it reaches that many. Rows in which no SEED words occur twice are passed over as a whole.
  reach    a lag that the words left over cannot make long enough is not started, nor one whose run would need the same
           SEED words d places further on and has others there.
  periods  if a stretch of period d has a smaller period e too and d + e words or more, its period divides both (Fine and
           Wilf), so d is dropped. Thus a text of one word repeated has one diagonal, not one for each place.
A passage that stands R times in one text without a period costs R * R / 2 steps for its first words, not for all.

Words are told apart exactly where diagonals run; the pass over whole batches compares 64-bit hashes, whose collisions only
cost time.

Edge cases: a null or empty text has no words and no runs; a very long text is split piece by piece and needs about 200 bytes a
word; runs may overlap, and a word goes if any run holds it after its first period; repeated rows and equal or null ids are
looked at each; an empty table gives no rows; other columns are kept, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_kernels import gram_hashes, long_hashes, pieces

#: Words of a run at least, and periods of it.
MIN_WORDS, TIMES = 24, 3
#: Rows and bytes of text looked at together.
GROUP_ROWS, GROUP_BYTES = 1024, 4 << 20
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
Run = tuple[int, int, int]


def seed_words(min_words: int = MIN_WORDS, times: int = TIMES) -> int:
    """Matches that the diagonal of every run has: its length less its period."""
    return min(max(min_words - d, (times - 1) * d) for d in range(1, min_words + 1))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal words alike."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each n words in a row, equal for equal ones: two shorter ones, which may overlap, number a longer one."""
    size, out = 1, codes
    while size < n:
        step = min(size, n - size)
        _, out = np.unique(np.stack([out[:-step], out[step:]], axis=1), axis=0, return_inverse=True)
        out, size = out.reshape(-1), size + step
    return out


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, times: int = TIMES) -> list[Run]:
    """start, length and period of every run, by start and period."""
    n, seed = len(words), seed_words(min_words, times)
    if n < max(min_words, seed + 1):
        return []
    codes = numbered(words)
    gram, codes = grams(codes, seed).tolist(), codes.tolist()  # gram[i]: the words from i to i + seed
    places: dict[int, dict[int, list[int]]] = {}  # gram, the gram one word before it, their places
    active: dict[int, int] = {}  # lag: the place of its first match
    runs: list[Run] = []
    before, limit = -1, 8
    for i in range(seed - 1, n):
        at = i - seed + 1
        ended = [d for d in active if codes[i] != codes[i - d]]
        if ended:
            runs += _ended(active, ended, i, min_words, times)
        here = places.setdefault(gram[at], {})
        for other, starts in here.items():
            if other == before >= 0:
                continue  # one word longer: these diagonals run already
            for j in starts:
                d = at - j
                matches = max(min_words - d, (times - 1) * d)
                if at + matches <= n and (matches <= seed or gram[at + matches - seed] == gram[at + matches - seed - d]) and (d + seed > matches or gram[at + d] == gram[at]):
                    active[d] = at
        here.setdefault(before, []).append(at)
        before = gram[at]
        if len(active) > limit:
            _drop_multiples(active, i)
            limit = max(8, 2 * len(active))
    runs += _ended(active, list(active), n, min_words, times)
    return sorted((s, length, d) for s, length, d in runs)


def _ended(active: dict[int, int], ended: list[int], i: int, min_words: int, times: int) -> Iterator[Run]:
    """The runs of the diagonals that the word i ends; these leave."""
    seen = set()
    for d in sorted(ended):
        start = active.pop(d) - d
        if i - start >= max(min_words, times * d) and start not in seen:
            seen.add(start)
            yield start, i - start, d


def _drop_multiples(active: dict[int, int], i: int) -> None:
    """Drop lags whose stretch has a smaller lag's period as well, and is long enough for both."""
    kept: list[tuple[int, int]] = []
    for d, first in sorted(active.items()):
        if any(start <= first - d and i + 1 - first >= e for e, start in kept):
            del active[d]
        else:
            kept.append((d, first - d))


def has_seeds(texts: list[bytes], seed: int) -> np.ndarray:
    """Whether a text has `seed` words in a row that it has elsewhere too; by hashes, so rarely also where it has not."""
    hashes = [gram_hashes(long_hashes(t), seed) for t in texts]
    return np.array([len(h) > 1 and len(np.unique(h)) < len(h) for h in hashes], dtype=bool)


def split_words(data: bytes) -> list[bytes]:
    return [w for piece in pieces(data) for w in piece.split()]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """docs with runs (array of start, length, period, by start and period) and collapsed (the words kept, joined by one space)."""
    made = {"runs": T.ArrayType(RUN, False), "collapsed": T.StringType()}
    kept = [f for f in docs.schema if f.name.lower() not in made]
    names, seed = [f.name for f in kept], seed_words(min_words, times)

    def some(texts: list[bytes]) -> tuple[pa.Array, pa.Array]:
        runs, left = [], []
        for text, likely in zip(texts, has_seeds(texts, seed), strict=True):
            words = split_words(text)
            found = find_runs(words, min_words, times) if likely else []
            runs.append([dict(zip(RUN.names, run, strict=True)) for run in found])
            left.append(b" ".join(collapsed(words, found) if found else words).decode())
        field = pa.field("element", pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]), False)
        return pa.array(runs, pa.list_(field)), pa.array(left, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, held = [], 0
                for x in whole.column(text_col).slice(at, GROUP_ROWS):
                    texts.append((x.as_py() or "").encode())
                    held += len(texts[-1])
                    if held > GROUP_BYTES:
                        break
                batch = whole.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *some(texts)], names=[*names, *made])
                at += len(texts)

    return docs.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in made.items()]]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one of ten texts (by the CRC-32 of the id) the words from some place on are its next words over and over."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The run of greatest length / period; of equal ones the first."""
    none = F.struct(*[F.lit(None).cast("long").alias(n) for n in RUN.names])
    more = lambda a, b: a["period"].isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, none, lambda a, b: F.when(more(a, b), F.struct(*[b[n].alias(n) for n in RUN.names])).otherwise(a))


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of greatest exponent, digests of all runs and of what is left.

    docs are doc_id and text as `with_planted_runs` gives them, or any others.
    """
    rows = periodic_runs(docs.select("doc_id", "text")).withColumn("best", _longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in RUN.names]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{n}").alias(n) for n in RUN.names],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
