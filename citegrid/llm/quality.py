"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a document) and selectivity (share rejected) are measured on a bounded sample, rules are
ordered by rejection per cost, and a document meets a rule only if the ones before it let it pass. Both are measured as the
run will meet them: on documents that the base rule has passed, with the base counts already there. The order changes what a
run costs, never which documents stay.

Edge cases: a null text has no words; documents of fewer than 20 words fail the base rule; a very long text is read piece by
piece and its words are known by hashes of 8 bytes, so that no list of its words is held; repeated rows are judged each; an
empty table gives no rows (and rules in the order given); of rules with equal rejection per cost the cheaper comes first, then the
one given first; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_kernels import _join, gram_hashes, long_hashes, pieces, word_hashes, word_spans

#: Rows, on average, of the sample that costs and selectivities come from.
SAMPLE_ROWS = 2000
#: Base rule: at least so many words; at most so many of 100 words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATS, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
#: Texts are hashed in groups of about so many bytes.
GROUP_BYTES = 4 << 20
#: Characters beyond which a text is long.
PIECE = 1 << 20


class Text:
    """A text with what the rules ask of it, computed when asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> list[bytes] | None:
        """The words between ASCII white space; none are held of a long text."""
        return self.text.encode().split() if len(self.text) <= PIECE else None

    def words(self) -> Iterator[str]:
        for part in [self.raw] if self.raw is not None else map(bytes.split, pieces(self.text.encode())):
            yield from map(bytes.decode, part)

    @cached_property
    def counts(self) -> tuple[int, int, int]:
        """Words, different words, and occurrences of the most frequent one."""
        if self.raw is not None:
            found = Counter(self.raw)
            return len(self.raw), len(found), max(found.values(), default=0)
        hashes = long_hashes(self.text.encode())
        each = np.unique(hashes, return_counts=True)[1]
        return len(hashes), len(each), int(each.max(initial=0))

    @property
    def n(self) -> int:
        return len(self.raw) if self.raw is not None else self.counts[0]

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def _lines(self) -> tuple[int, int]:
        """Lines with a word, and how many of them are different."""
        n, seen = 0, set()
        for line in self.text.split("\n"):
            if line.strip(_SPACES):
                n += 1
                seen.add(line)
        return n, len(seen)

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[0] - self._lines[1]

    def base(self) -> "Text":
        """Itself, with the counts that every row gets."""
        self.n, self.word_chars, self.n_symbols, self._lines  # noqa: B018
        return self


#: A rule rejects a text for which it is true. Whole numbers only, so that SQL gives the same verdicts.
RULES: dict[str, Callable[[Text], bool]] = {
    "word_length": lambda t: t.word_chars > 15 * t.n or t.word_chars < 2 * t.n,
    "symbols": lambda t: 10 * t.n_symbols > t.n,
    "exclamations": lambda t: 10 * t.text.count("!") > 3 * t.n,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > t.n_lines,
    "capitals": lambda t: 2 * sum(map(str.isupper, t.words())) > t.n,
    "few_letters": lambda t: 10 * sum(any(map(str.isalpha, w)) for w in t.words()) < 7 * t.n,
    "few_distinct": lambda t: 10 * t.counts[1] < t.n,
    "frequent_word": lambda t: 10 * t.counts[2] > 3 * t.n,
}


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float


def measure(docs: DataFrame, rules: dict[str, Callable] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """Seconds a text and share rejected of each rule, on the sample's texts that pass the base rule.

    A text has its base counts before a rule is timed, and each rule a text of its own, so that none profits from another.
    """
    names = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hit, seen = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), 0
        for batch in batches:
            for group, repeats in _groups([x or "" for x in batch.column(0).to_pylist()]):
                for text, repeated in zip(group, repeats, strict=True):
                    if base_failed(Text(text), repeated):
                        continue
                    seen += 1
                    for name in names:
                        own = Text(text).base()
                        began = time.perf_counter()
                        hit[name] += rules[name](own)
                        spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"name": names, "seconds": [spent[n] for n in names], "hits": [hit[n] for n in names], "seen": [seen] * len(names)})

    share = min(1.0, sample_rows / max(1, docs.count()))  # a count that reads no text
    sample = docs.select(text_col).sample(share, seed)  # drawn where the rows lie; about sample_rows of them
    rows = sample.mapInArrow(run, "name string, seconds double, hits long, seen long").groupBy("name").agg(*[F.sum(c).alias(c) for c in ("seconds", "hits", "seen")]).collect()
    by_name = {r["name"]: r for r in rows if r["seen"]}
    return [Measured(n, by_name[n]["seconds"] / by_name[n]["seen"], by_name[n]["hits"] / by_name[n]["seen"]) if n in by_name else Measured(n, 0.0, 0.0) for n in names]


def base_failed(text: Text, repeats: int) -> bool:
    return text.n < MIN_WORDS or 100 * repeats > MAX_REPEATS * text.n


def _groups(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in groups of about GROUP_BYTES, with their words in repeated windows; a long text is a group of its own."""
    group, size = [], 0
    for text in texts:
        if len(text) > PIECE:
            yield [text], [long_repeat_words(text.encode())]
            continue
        group.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield group, repeat_words([x.encode() for x in group]).tolist()
            group, size = [], 0
    if group:
        yield group, repeat_words([x.encode() for x in group]).tolist()


def ordered(measured: list[Measured]) -> list[str]:
    """Rule names by rejection per cost, best first; rules that rejected none of the sample by cost."""
    return [m.name for m in sorted(measured, key=lambda m: (-m.rejected / max(m.seconds, 1e-9), m.seconds))]


def repeat_words(texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of words found twice or more in it."""
    buf, starts, ends, bounds = word_spans(texts)
    n = len(starts)
    grams = gram_hashes(word_hashes(buf, starts, ends), window)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(bounds[1:][doc[: len(grams)]] - np.arange(len(grams)) >= window)
    own = _join(grams[at], doc[at].astype(np.uint64), 1)
    _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def long_repeat_words(data: bytes, window: int = WINDOW, slices: int = 8) -> int:
    """The same for one long text: windows are told apart slice by slice of their hashes."""
    grams = gram_hashes(long_hashes(data), window)
    again = np.zeros(len(grams) + window, dtype=bool)
    for i in range(slices):
        at = np.flatnonzero(grams % np.uint64(slices) == np.uint64(i))
        _, inverse, count = np.unique(grams[at], return_inverse=True, return_counts=True)
        again[at[count[inverse] > 1]] = True
    covered = np.zeros(len(grams) + window - 1, dtype=bool) if len(grams) else np.zeros(0, dtype=bool)
    for j in range(window):
        covered[j : j + len(grams)] |= again[: len(grams)]
    return int(covered.sum())


_COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def cascade(docs: DataFrame, order: list[str], rules: dict[str, Callable] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, base_failed, and kept (false if a rule of the order rejects it)."""
    run_rules = [rules[n] for n in order]

    def judged(text: str, repeats: int) -> tuple:
        t = Text(text).base()
        failed = base_failed(t, repeats)
        return t.n, t.word_chars, t.n_symbols, t.n_dup_lines, repeats, failed, not failed and not any(rule(t) for rule in run_rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Long texts are groups of their own, so rows are put back into the order of their ids.
            texts = [x or "" for x in batch.column(1).to_pylist()]
            places = [i for i, x in enumerate(texts) if len(x) > PIECE], [i for i, x in enumerate(texts) if len(x) <= PIECE]
            for at in places:
                done = 0
                for group, repeats in _groups([texts[i] for i in at]):
                    rows = [judged(text, n) for text, n in zip(group, repeats, strict=True)]
                    ids = batch.column(0).take(pa.array(at[done : done + len(group)], pa.int64()))
                    done += len(group)
                    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _COLUMNS)


def quality_filter(docs: DataFrame, rules: dict[str, Callable] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measure on a sample, order, and run the cascade over all documents."""
    return cascade(docs, ordered(measure(docs, rules, text_col, sample_rows)), rules, id_col, text_col)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
u AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS n FROM u),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, text, words, len(lines) AS n_lines, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS bangs,
  len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) AS caps, len(list_filter(words, lambda x: regexp_matches(x, '\\pL'))) AS letters,
  len(list_distinct(words)) AS different, coalesce(list_max(map_values(list_histogram(words))), 0) AS most
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words OR 10 * bangs > 3 * n_words
    OR 2 * n_dup_lines > n_lines OR 2 * caps > n_words OR 10 * letters < 7 * n_words OR 10 * different < n_words OR 10 * most > 3 * n_words) AS kept
FROM f
"""
