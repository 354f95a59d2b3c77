"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of lower-case words. A document matches an item of n words if some run of its words is
within floor((1 - SIMILARITY) * n) word edits of it. Windows of an item's size are embedded by CGK random walks: at
step j the embedding takes the current word, and a random bit of (j, word) says whether the walk moves on, so that few
edits become few differing places. A table samples PLACES places of an embedding; windows that agree with an item in
any of TABLES tables are verified by exact edit distance. The number of tables follows from RECALL and the chance that a
sampled place agrees at the largest allowed distance.

Which windows are embedded follows from the item's short runs of words. An edit spoils at most q runs of q words, and q
is chosen so that the allowed edits leave at least one (two words for items of five, three for most): windows without
enough of an item's runs cannot match it, so none is lost by leaving them out. Runs that many items share count for none
of them where the rarer ones suffice; where they do not, a place with such a run is embedded once for each size of item,
however many items have the run. All lookups go by slices of bounded size.

The items are a stated query set. Up to BLOCK_ITEMS rows and BLOCK_BYTES (counted first) they are sent to the tasks, and
every document is scanned in place, without a shuffle. Beyond, they are dealt into blocks of that size by a hash, and
documents go to the blocks with which they share a rare run, by a join on runs; no item passes through the driver.

Edge cases: a null text or item has no words and matches nothing; items of fewer than five words match exactly; repeated
items with different ids match each; repeated documents match each; a very long text is read and searched in pieces of
GROUP_WORDS words that overlap by more than any match is long; empty tables give no rows; further columns, whatever their
names, are ignored by `contamination` and kept by `clean`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, releasing, written
from .text_kernels import mix
from .url_filter import BROADCAST_BLOCKS, bloom_blocks, possible

SIMILARITY, RUN = 0.8, 3
#: Target recall, places a table samples, and the chance that a place agrees at the largest distance.
RECALL, PLACES, AGREE = 0.99, 2, 0.3
#: Walks, and tables that sample each of them: together enough tables for the target.
WALKS = 8
SAMPLINGS = ceil(log(1 - RECALL) / log(1 - AGREE**PLACES) / WALKS)
#: Items of a block: this many rows or bytes, whichever comes first. Documents that a task matches with a block at once.
BLOCK_ITEMS, BLOCK_BYTES, PART_ROWS = 20_000, 32 << 20, 2048
#: A run that more items have is common. Windows embedded, and pairs of window and item looked at, at once.
COMMON, WINDOWS, PAIRS = 32, 8192, 1 << 19
#: Words and rows of documents looked at at once, and characters split into words at once.
GROUP_WORDS, GROUP_ROWS, PIECE = 1 << 18, 2048, 1 << 20
_WORDS, _GAP = re.compile(r"\w+").findall, re.compile(r"\s").search


def word_lists(text: str | None) -> Iterator[list[str]]:
    """Lower-case words, piece by piece of a long text, cut at white space."""
    text, at = text or "", 0
    while at < len(text):
        gap = _GAP(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield _WORDS(text[at:end].lower())
        at = end


def words_of(text: str | None) -> list[str]:
    return list(chain.from_iterable(word_lists(text)))


def allowed(n: int) -> int:
    """Word edits within which an item of n words matches."""
    return floor((1 - SIMILARITY) * n + 1e-9)


def run_length(n: int) -> int:
    """Words of the runs of an item of n words: allowed(n) edits always leave one."""
    return min(RUN, n // (1 + allowed(n)))


def needed(n: int) -> int:
    """Runs of an item of n words that allowed(n) edits leave at least."""
    q = run_length(n)
    return n - q + 1 - q * allowed(n)


def _run_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q words; runs with a word that no item has (number 0) are 0."""
    m = len(a) - q + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out, known = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool)
    for j in range(q):
        part = a[j : j + m]
        known &= part != 0
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + part.astype(np.uint64) + np.uint64(1))
    return np.where(known, out, np.uint64(0))


def keys_of(windows: np.ndarray) -> np.ndarray:
    """(tables, windows) keys of windows of one size: CGK walks over their words, and the sampled places hashed."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.full((count, 1), -1)], axis=1)
    rows, random = np.arange(count), np.random.default_rng(n)
    # Places late in a walk have drifted further; the first 1.5 n steps cover most of an item.
    places = [[set(random.choice(max(PLACES, n + n // 2), PLACES, replace=False).tolist()) for _ in range(SAMPLINGS)] for _ in range(WALKS)]
    out = np.zeros((WALKS * SAMPLINGS, count), dtype=np.uint64)
    for w in range(WALKS):
        at = np.zeros(count, dtype=np.int64)
        for j in range(max(max(p) for p in places[w]) + 1):
            now = padded[rows, np.minimum(at, n)].astype(np.uint64)
            for t in range(SAMPLINGS):
                if j in places[w][t]:
                    key = out[w * SAMPLINGS + t]
                    key[:] = mix(key * np.uint64(0x9E3779B97F4A7C15) + now)
            at += (mix(now * np.uint64(0xD6E8FEB86659FD93) + np.uint64((w << 32) + j)) >> np.uint64(63)).astype(np.int64)
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [low, high): the number of the range and the place, one entry a member."""
    many = high - low
    of = np.repeat(np.arange(len(low)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]


class Items:
    """A block of items: word numbers, the runs that a match must keep, and the LSH tables by size."""

    def __init__(self, rows: list[tuple[int, str]]):
        lists = [(i, words_of(t)) for i, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in lists for w in ws}), 1)}
        self.items = [(i, np.array([self.vocabulary[w] for w in ws], dtype=np.int64)) for i, ws in lists if ws]
        self.length = np.array([len(a) for _, a in self.items], dtype=np.int64)
        self.longest = int(self.length.max(initial=0))
        self.need = np.zeros(len(self.items), dtype=np.int64)
        #: By run length: the rare runs with the items that count them, and the runs of which one will do with the items' sizes.
        self.counted, self.single = {}, {}
        self._choose()
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in np.unique(self.length).tolist():
            members = np.flatnonzero(self.length == n)
            keys = np.concatenate([keys_of(np.stack([self.items[k][1] for k in members[i : i + WINDOWS]])) for i in range(0, len(members), WINDOWS)], axis=1)
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables[n] = [(row[o], members[o]) for row, o in zip(keys, order, strict=True)]

    def _choose(self) -> None:
        runs = {q: [_run_hashes(a, q) for _, a in self.items] for q in range(1, RUN + 1)}
        shares = {}
        for q, rows in runs.items():
            hashes, items = np.unique(np.concatenate([*[np.unique(r) for r in rows], np.empty(0, dtype=np.uint64)]), return_counts=True)
            shares[q] = [items[np.searchsorted(hashes, r)] for r in rows]
        counted, single = ({q: set() for q in runs} for _ in range(2))
        for k, n in enumerate(self.length.tolist()):
            for q in range(run_length(n), 0, -1):  # the longest runs of which rare ones are left by any allowed edits
                run, share = runs[q][k], shares[q][k]
                self.need[k] = n - q + 1 - q * allowed(n) - int((share > COMMON).sum())
                if self.need[k] >= 1:
                    counted[q].update((h, k) for h in run[share <= COMMON].tolist())
                    break
            else:  # nearly all its words are common: one is left of the allowed(n) + 1 rarest
                rarest = runs[1][k][np.argsort(shares[1][k], kind="stable")[: allowed(n) + 1]]
                single[1].update((h, n) for h in rarest.tolist())
        for table, of in ((self.counted, counted), (self.single, single)):
            for q, rows in of.items():
                pairs = sorted(rows)
                table[q] = np.array([h for h, _ in pairs], dtype=np.uint64), np.array([x for _, x in pairs], dtype=np.int64)

    def windows(self, numbers: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
        """By size, the starts of the windows that keep enough runs of some item of that size."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        steps: dict[int, np.ndarray] = {}

        def mark(n: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            for size in np.unique(n).tolist():
                step = steps.setdefault(size, np.zeros(len(numbers) + 1, dtype=np.int32))
                np.add.at(step, first[n == size], 1)
                np.add.at(step, last[n == size] + 1, -1)

        reach = {n: n + allowed(n) - 1 for n in self.tables}  # from the start of a match to any run in it
        width = np.zeros(self.longest + 1, dtype=np.int64)
        width[list(reach)] = list(reach.values())
        for q in self.counted:
            found = _run_hashes(numbers, q)
            spot = np.flatnonzero(found)
            spot = spot[doc[spot] == doc[spot + q - 1]]
            hashes, sizes = self.single[q]
            of, at = _spread(np.searchsorted(hashes, found[spot], "left"), np.searchsorted(hashes, found[spot], "right"))
            n, place = sizes[at], spot[of]
            mark(n, np.maximum(bounds[doc[place]], place - width[n]), place)
            hashes, owner = self.counted[q]
            of, at = _spread(np.searchsorted(hashes, found[spot], "left"), np.searchsorted(hashes, found[spot], "right"))
            place, item = spot[of], owner[at]
            order = np.lexsort((place, item, doc[place]))
            place, item = place[order], item[order]
            # n words may be spread over n + allowed(n) words of the document: `need` runs within that reach.
            later = np.arange(len(item)) + self.need[item] - 1
            there = np.flatnonzero(later < len(item))
            there = there[(item[later[there]] == item[there]) & (doc[place[later[there]]] == doc[place[there]])]
            there = there[place[later[there]] - place[there] <= width[self.length[item[there]]]]
            n = self.length[item[there]]
            mark(n, np.maximum(bounds[doc[place[there]]], place[later[there]] - width[n]), place[there])
        return {n: np.flatnonzero(np.cumsum(step[:-1]) > 0) for n, step in steps.items()}

    def _alike(self, n: int, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) of the windows that agree with an item in some table, some PAIRS at a time."""
        low = [np.searchsorted(t, row, "left") for (t, _), row in zip(self.tables[n], keys, strict=True)]
        high = [np.searchsorted(t, row, "right") for (t, _), row in zip(self.tables[n], keys, strict=True)]
        ends = np.cumsum(sum(h - i for i, h in zip(low, high, strict=True)))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), "right"), [len(ends)]]))
        for i, j in zip(cuts, cuts[1:], strict=False):
            codes = []
            for (_, members), a, b in zip(self.tables[n], low, high, strict=True):
                of, at = _spread(a[i:j], b[i:j])
                codes.append(np.unique((of + i) * len(self.items) + members[at]))
            code = np.unique(np.concatenate(codes))
            yield code // len(self.items), code % len(self.items)

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item id, edits, n, start, end) of the best run of each text for each item that it matches."""
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        numbers = np.concatenate([*texts, np.empty(0, dtype=np.int64)])
        doc_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, starts in self.windows(numbers, bounds).items():
            for i in range(0, len(starts), WINDOWS):
                start = starts[i : i + WINDOWS]
                at = start[:, None] + np.arange(n)[None, :]
                inside = at < bounds[doc_of[start] + 1][:, None]
                keys = keys_of(np.where(inside, numbers[np.minimum(at, len(numbers) - 1)], -1))
                for window, item in self._alike(n, keys):
                    self._verify(start[window], item, numbers, bounds, doc_of, best)
        return [(d, self.items[k][0], e, len(self.items[k][1]), s - int(bounds[d]), t - int(bounds[d])) for (d, k), (e, s, t) in best.items()]

    def _verify(self, start, item, numbers, bounds, doc_of, best) -> None:
        """Exact edits of the candidates; the least of each text and item, and of these the first, are kept in best."""
        doc = doc_of[start]
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order].tolist(), item[order].tolist(), start[order].tolist()
        i = 0
        while i < len(item):
            d, k, j = doc[i], item[i], i
            own = self.items[k][1]
            slack = allowed(len(own))
            while j + 1 < len(item) and (doc[j + 1], item[j + 1]) == (d, k) and start[j + 1] - start[j] <= len(own) + 2 * slack:
                j += 1
            a, b = max(int(bounds[d]), start[i] - slack), min(int(bounds[d + 1]), start[j] + len(own) + slack)
            i = j + 1
            text = numbers[a:b]
            if int(np.isin(own, text).sum()) < len(own) - slack:  # each word that is missing costs an edit
                continue
            edits, end, first = best_run(own, text)
            if edits <= slack and ((d, k) not in best or (edits, a + first) < best[d, k][:2]):
                best[d, k] = edits, a + first, a + end


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between item and any run of text, with the end and start of that run (the first such end)."""
    m = len(text)
    cost, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    step = np.arange(m + 1)
    for i, word in enumerate(item, 1):
        swap = cost[:-1] + (text != word)
        drop = cost[1:] + 1
        new = np.concatenate([[i], np.minimum(swap, drop)])
        came = np.concatenate([[0], np.where(swap <= drop, start[:-1], start[1:])])
        # Words of the text between two of the item cost one each: a running minimum of cost minus place.
        low = np.minimum.accumulate(new - step)
        origin = np.maximum.accumulate(np.where(new - step == low, step, 0))
        cost, start = low + step, came[origin]
    end = int(np.argmin(cost))
    return int(cost[end]), end, int(start[end])


_SCHEMA = "doc_id long, item_id long, edits long, item_words long, start_word long, end_word long"
_FOUND = _SCHEMA.replace("doc_id", "row_id")
_BUILT: dict = {}


def _numbered(items: Items, text: str | None) -> np.ndarray:
    number = items.vocabulary.get
    return np.concatenate([np.empty(0, dtype=np.int64), *[np.array(list(map(number, words, repeat(0))), dtype=np.int64) for words in word_lists(text)]])


def _found(items: Items, texts: list[str | None]) -> Iterator[tuple]:
    """(place in texts, item id, edits, words, start, end) of each match."""
    overlap = 2 * (items.longest + allowed(items.longest))
    group, of, size = [], [], 0
    for i, text in enumerate(texts):
        numbers = _numbered(items, text)
        if len(numbers) > GROUP_WORDS + overlap:
            best: dict[int, tuple] = {}
            for at in range(0, len(numbers), GROUP_WORDS):
                for _, item, edits, n, start, end in items.matches([numbers[at : at + GROUP_WORDS + overlap]]):
                    if item not in best or (edits, at + start) < (best[item][1], best[item][3]):
                        best[item] = item, edits, n, at + start, at + end
            yield from ((i, *b) for b in best.values())
            continue
        group.append(numbers)
        of.append(i)
        size += len(numbers)
        if size >= GROUP_WORDS:
            yield from ((of[m[0]], *m[1:]) for m in items.matches(group))
            group, of, size = [], [], 0
    yield from ((of[m[0]], *m[1:]) for m in items.matches(group))


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 6)]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _block_count(items: DataFrame) -> int:
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    return max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))


def _sent(items: DataFrame):
    """What gives a task the items, which are within one block: built once a worker."""
    tag, sent = uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.orderBy("item_id", "text").collect()])

    def get() -> Items:
        if tag not in _BUILT:
            _BUILT.clear()
            _BUILT[tag] = Items(sent.value)
        return _BUILT[tag]

    return get


def _word_hash(cache: dict[str, int], word: str) -> int:
    import xxhash

    if word not in cache:
        if len(cache) > 200_000:
            cache.clear()
        cache[word] = xxhash.xxh3_64_intdigest(word) | 1
    return cache[word]


def _runs_of(text: str | None, cache: dict[str, int], lengths: list[int]) -> tuple[int, dict[int, np.ndarray]]:
    """Number of words, and the hashes of all runs of each length, the same for items and documents everywhere."""
    numbers = np.fromiter((_word_hash(cache, w) for w in words_of(text)), dtype=np.uint64)
    return len(numbers), {q: _run_hashes(numbers, q) for q in lengths}


def _item_runs(items: DataFrame) -> DataFrame:
    """run, block: for each item the rarest runs of which a match keeps one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            rows = []
            for item, block, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, runs = _runs_of(text, cache, list(range(1, RUN + 1)))
                if n:
                    q = run_length(n)
                    rows += [(item, block, at, q * allowed(n) + 1, h) for at, h in enumerate(runs[q].view(np.int64).tolist())]
            kinds = zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in kinds], names=["item", "block", "at", "keep", "run"])

    keyed = items.select(F.monotonically_increasing_id().alias("item"), "block", "text")
    runs = written(written(keyed, "items").mapInArrow(run, "item long, block int, at long, keep long, run long"), "item-runs")
    share = runs.groupBy("run").agg(F.count(F.lit(1)).alias("share"))
    ranked = runs.join(share, "run").withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy("share", "at")))
    return ranked.where("n <= keep").select("run", "block").distinct()


def _doc_runs(rows: DataFrame) -> DataFrame:
    """run, row_id: the different runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, runs = _runs_of(text.as_py(), cache, list(range(1, RUN + 1)))
                own = np.unique(np.concatenate(list(runs.values()))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), key, dtype=np.int64))], names=["run", "row_id"])

    return rows.select("row_id", "text").mapInArrow(run, "run long, row_id long")


def _routed(rows: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """Matches of rows (row_id, text) with items beyond one block: each row goes to the blocks that it shares a rare run with."""
    items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "items")
    rare = written(_item_runs(items), "rare-runs")
    probes, (blooms, size) = _doc_runs(rows).withColumnRenamed("run", "key"), bloom_blocks(rare.select(F.col("run").alias("key")).distinct(), rare.count())
    if size <= BROADCAST_BLOCKS:  # a document's runs are told apart where they are made, and only those that an item may have are shuffled
        probes = possible(probes, blooms, size)
    hits = written(probes.withColumnRenamed("key", "run").join(rare, "run").select("row_id", "block").distinct(), "routes")
    parts = hits.groupBy("block").agg(F.expr(f"cast(ceil(count(1) / {PART_ROWS}) as int)").alias("parts"))
    part = F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part")
    asked = rows.join(hits.join(parts, "block").select("row_id", "block", part), "row_id").select("row_id", "text", "block", "part")
    held = items.join(parts, "block").select("item_id", F.col("text").alias("item_text"), F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))

    def run(docs: pa.Table, block: pa.Table) -> pa.Table:
        built = Items(list(zip(block.column("item_id").to_pylist(), block.column("item_text").to_pylist(), strict=True)))
        ids = docs.column("row_id").to_pylist()
        return pa.table(_arrays([(ids[m[0]], *m[1:]) for m in _found(built, docs.column("text").to_pylist())]), names=_names(_FOUND))

    return asked.groupBy("block", "part").cogroup(held.groupBy("of_block", "of_part")).applyInArrow(run, _FOUND)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it matches: doc_id, item_id, edits, item_words, start_word, end_word."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    blocks = _block_count(items)
    if blocks > 1:
        rows = written(slim.withColumn("row_id", F.monotonically_increasing_id()), "documents")
        return _routed(rows, items, blocks).join(rows.select("row_id", "doc_id"), "row_id").select(*_names(_SCHEMA))
    built = _sent(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(_arrays([(ids[m[0]], *m[1:]) for m in _found(built(), part.column(1).to_pylist())]), names=_names(_SCHEMA))

    return slim.mapInArrow(releasing(run), _SCHEMA)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that match an item; each row is judged by its text alone."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    blocks = _block_count(items)
    if blocks > 1:
        key = fresh(docs, "_row_id")
        kept = written(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
        found = _routed(kept.select(F.col(key).alias("row_id"), F.col(text_col).alias("text")), items, blocks)
        gone = written(found.select(F.col("row_id").alias(key)).distinct(), "matched")
        return kept.join(gone, key, "left_anti").select(*docs.columns)
    built = _sent(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(at, GROUP_ROWS)
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[m[0] for m in _found(built(), part.column(text_col).to_pylist())]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(releasing(run), docs.schema)
