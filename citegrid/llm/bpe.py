"""BPE encoding and decoding, merged by segment trees over the ranks of adjacent pairs.

The model of a tokenizers file (vocabulary, merges, end-of-word mark) is applied word by word. A tree holds at leaf i the
rank of the pair that symbol i makes with the next one, and i itself, so that its root is the leftmost pair of lowest
rank. A merge joins two symbols and renews three leaves (its own, that of the symbol before, that of the symbol which is
gone) on their ways to the root; the word is done when the root holds no rank. A word of n symbols takes O(n log n) steps.
Trees of short words are rows of one matrix, so that each step merges in all words at once; a long word has a tree of its own.

A text is cut at the file's added tokens, which stand for themselves, and then at ASCII white space: no normalized form,
word or merge reaches over it. What lies between (a chunk) is normalized and split into words as the file says; chunks that
the texts at hand have and the table of known ones has not are encoded together. Decoding is the inverse that a file without a
decoder has: the tokens joined by one space.

Edge cases: a null or empty text has no ids and decodes to an empty text; a very long text is read piece by piece, a very
long word needs some 100 bytes a symbol; ids without a token are skipped in decoding; null ids give null; repeated rows and
equal ids are encoded each; an empty table gives no rows; other columns are kept, and a column named like the result is replaced.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_kernels import pieces

#: Chunks whose ids a worker keeps, rows and bytes handed on at once, symbols of a word whose tree has a row of a matrix.
CACHED, GROUP_ROWS, GROUP_BYTES, SHORT = 400_000, 1024, 1 << 19, 65
_NONE = 1 << 62
_MODELS: dict[tuple[str, type], Tokens] = {}


class Pairs:
    """The ranks of the pairs that merge, and what they make."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int], symbols: int):
        self.base = symbols + 1  # the number -1 (no symbol) makes no pair's key
        keys = np.array([a * self.base + b for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], _NONE)
        self.ranks = np.append(self.order.astype(np.int64) << 32, _NONE)
        self.made, self.rank_of, self.made_of = np.array(made, dtype=np.int64), {p: i << 32 for i, p in enumerate(pairs)}, made

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank * 2^32 of each pair, or _NONE."""
        keys = a * self.base + b
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)


def merged(symbols: list[int], pairs: Pairs) -> list[int]:
    """The symbols of one word after all merges."""
    n = len(symbols)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    key, made = pairs.rank_of.get, pairs.made_of
    # A leaf is rank * 2^32 + place: the least is the lowest rank, of equal ones the leftmost.
    tree = [_NONE] * size + [key(p, _NONE) + i for i, p in enumerate(pairwise(symbols))] + [_NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    if tree[1] >= _NONE:
        return symbols
    out, after, before = symbols[:], list(range(1, n + 1)), list(range(-1, n))
    while tree[1] < _NONE:
        i = tree[1] & 0xFFFFFFFF
        gone = after[i]
        here = out[i] = made[tree[1] >> 32]
        out[gone] = -1
        follow = after[i] = after[gone]
        before[follow] = i
        renewed = [(gone, _NONE), (i, key((here, out[follow]), _NONE) + i if follow < n else _NONE)]
        if (back := before[i]) >= 0:
            renewed.append((back, key((out[back], here), _NONE) + back))
        for leaf, low in renewed:
            leaf += size
            if leaf < 2 * size:
                tree[leaf] = low
                while leaf > 1:
                    x, y = tree[leaf], tree[leaf ^ 1]
                    leaf >>= 1
                    low = x if x < y else y
                    if tree[leaf] == low:
                        break
                    tree[leaf] = low
    return [s for s in out if s >= 0]


def merged_rows(symbols: np.ndarray, pairs: Pairs) -> np.ndarray:
    """The symbols of many words after all merges: a row a word, -1 where it has no symbol (any more).

    A row has one column more than its tree has leaves, a power of two.
    """
    rows, size = len(symbols), symbols.shape[1] - 1
    symbols = np.concatenate([symbols, np.full((rows, 1), -1)], axis=1)  # the last column stands for what follows a word
    after, before = np.tile(np.minimum(np.arange(1, size + 3), size + 1), (rows, 1)), np.tile(np.arange(-1, size + 1), (rows, 1))
    tree = np.full((rows, 2 * size), _NONE, dtype=np.int64)
    tree[:, size:] = pairs.of(symbols[:, :size], symbols[:, 1 : size + 1]) + np.arange(size)
    width = size // 2
    while width:
        tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        width //= 2
    row = np.arange(rows)
    while len(row := row[tree[row, 1] < _NONE]):
        root = tree[row, 1]
        i = root & 0xFFFFFFFF
        here, gone, back = pairs.made[root >> 32], after[row, i], before[row, i]
        follow = after[row, gone]
        symbols[row, i], symbols[row, gone] = here, -1
        after[row, i], before[row, follow] = follow, i
        inner = gone < size
        tree[row[inner], size + gone[inner]] = _NONE
        tree[row, size + i] = pairs.of(here, symbols[row, follow]) + i
        first = back >= 0
        tree[row[first], size + back[first]] = pairs.of(symbols[row[first], back[first]], here[first]) + back[first]
        for own, leaf in ((row[inner], gone[inner]), (row, i), (row[first], back[first])):
            at = (size + leaf) >> 1
            for _ in range(size.bit_length() - 1):
                tree[own, at] = np.minimum(tree[own, 2 * at], tree[own, 2 * at + 1])
                at = at >> 1
    return symbols[:, :-1]


def merged_words(words: list[list[int]], pairs: Pairs) -> list[bytes]:
    """The packed symbols of words after all merges."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = array("I", merged(words[i], pairs)).tobytes()
    size, low = 1, -1
    while low < SHORT:
        chosen = np.flatnonzero((lengths > low) & (lengths <= min(size + 1, SHORT)))
        low, size = size + 1, 2 * size
        if not len(chosen):
            continue
        held = np.arange(low)[None, :] < lengths[chosen][:, None]
        rows = np.full(held.shape, -1, dtype=np.int64)
        rows[held] = [s for i in chosen.tolist() for s in words[i]]
        rows = merged_rows(rows, pairs)
        data, ends = rows[rows >= 0].astype("<u4").tobytes(), 4 * np.cumsum((rows >= 0).sum(axis=1))
        for i, a, b in zip(chosen.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = data[a:b]
    return out


class Tokens:
    """The token of each id of a tokenizers file: all that decoding needs."""

    def __init__(self, path: str):
        self.read(path)

    def read(self, path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*file["model"]["vocab"].items(), *self.added.items()]}
        return file

    def decode(self, rows: list[bytes | None]) -> list[str | None]:
        """The text of each row of packed ids."""
        token = self.tokens.get
        return [None if ids is None else " ".join(filter(None, map(token, array("I", ids)))) for ids in rows]


class Model(Tokens):
    """The vocabulary, merges and text rules of one tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model, rules = self.read(path)["model"], Tokenizer.from_file(path)
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = Pairs([(self.vocab[a], self.vocab[b]) for a, b in merges], [self.vocab[a + b] for a, b in merges], 1 + max(self.tokens, default=0))
        self.packed = {t.encode(): array("I", [i]).tobytes() for t, i in self.added.items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.packed, key=len, reverse=True))) + b")").split if self.packed else None
        self.normalize = rules.normalizer.normalize_str if rules.normalizer else str
        self.words = rules.pre_tokenizer.pre_tokenize_str if rules.pre_tokenizer else lambda x: [(w, None) for w in x.split()]
        if [w for w, _ in self.words(self.normalize("ab \n cd"))] != [w for x in ("ab", "cd") for w, _ in self.words(x)]:
            raise ValueError("only for tokenizers that drop white space: chunks between it are encoded one by one")
        # A text with every pair of ASCII letters shows whether letters alone are one word, in lower case.
        letters = "".join(a + b for a in string.ascii_letters for b in string.ascii_letters)
        self.plain = self.normalize(letters) == letters.lower() and [w for w, _ in self.words(letters.lower())] == [letters.lower()]
        self.known: dict[bytes, bytes] = dict(self.packed)
        self.older: dict[bytes, bytes] = {}

    def _symbols(self, word: str) -> list[int]:
        symbols = list(map(self.vocab.get, word[:-1]))
        symbols.append(self.vocab.get(word[-1:] + self.end))
        return symbols if None not in symbols else [s for s in symbols if s is not None]  # as a model without an unknown token does

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that are not known: normalized in one call, and split into words in one call but for those with a space."""
        alone = [c for c in chunks if c.isalpha()] if self.plain else []
        chunks = [c for c in chunks if not c.isalpha()] if self.plain else chunks
        texts = self.normalize(b" ".join(chunks).decode()).split(" ") if chunks else []
        if len(texts) != len(chunks):  # white space beyond ASCII
            texts = [self.normalize(c.decode()) for c in chunks]
        split: list[list[str]] = [[w for w, _ in self.words(t)] if " " in t else [] for t in texts]
        owners = [i for i, t in enumerate(texts) if " " not in t]
        line = [texts[i] for i in owners]
        starts = np.cumsum([0, *[len(t) + 1 for t in line]])
        found = self.words(" ".join(line))
        own = np.searchsorted(starts, np.array([span[0] for _, span in found], dtype=np.int64), side="right") - 1
        for (word, _), k in zip(found, own.tolist(), strict=True):
            split[owners[k]].append(word)
        lower = [c.decode().lower() for c in alone]
        words = list(dict.fromkeys([*lower, *[w for ws in split for w in ws]]))
        ids = dict(zip(words, merged_words([self._symbols(w) for w in words], self.pairs), strict=True))
        self.known.update(zip(alone, [ids[w] for w in lower], strict=True))
        self.known.update(zip(chunks, [b"".join([ids[w] for w in ws]) for ws in split], strict=True))

    def _flush(self, units: list[tuple[int, list[bytes]]], out: list[list[bytes]]) -> None:
        """Encode the chunks of units (text, its chunks or one added token) and append them to their texts."""
        met = set().union(self.packed, *[chunks for _, chunks in units])  # an added token is a chunk of its own
        if len(self.known) > CACHED // 2:
            self.older, self.known = self.known, {}  # what is met again comes back
        missing = met.difference(self.known)
        self.known |= {c: self.older[c] for c in missing & self.older.keys()}
        self._learn(list(missing.difference(self.older)))
        for text, chunks in units:
            out[text].append(b"".join(map(self.known.__getitem__, chunks)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        units, held = [], 0
        for i, text in enumerate(texts):
            data = text.encode()
            for part in self.cut(data) if self.cut else (data,):
                for piece in pieces(part):
                    units.append((i, [piece] if piece in self.packed else piece.split()))
                    held += len(piece)
                    if held > GROUP_BYTES:
                        self._flush(units, out)
                        units, held = [], 0
        self._flush(units, out)
        return [b"".join(x) for x in out]


def loaded(path: str, kind: type[Tokens]) -> Tokens:
    """One model of a kind a worker and file."""
    if (path, kind) not in _MODELS:
        _MODELS[path, kind] = kind(path)
    return _MODELS[path, kind]


def _mapped(rows: DataFrame, col: str, out: str, kind: T.DataType, path: str, apply: str) -> DataFrame:
    """rows with a column that a method of the model makes of another one; a few rows at a time."""
    kept = [f for f in rows.schema if f.name.lower() != out.lower()]
    names, arrow = [f.name for f in kept], pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert, empty = (loaded(path, Model).encode, "") if apply == "encode" else (loaded(path, Tokens).decode, None)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                values, held = [], 0
                for x in whole.column(col).slice(at, GROUP_ROWS):
                    values.append(x.as_py() if x.is_valid else empty)
                    held += len(values[-1] or "")
                    if held > GROUP_BYTES:
                        break
                batch = whole.slice(at, len(values))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(convert(values), arrow)], names=[*names, out])
                at += len(values)

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out, kind)]))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text, packed as token files hold them: little-endian unsigned 32-bit integers."""
    return _mapped(docs, text_col, out, T.BinaryType(), tokenizer, "encode")


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each row's packed ids."""
    return _mapped(rows, ids_col, out, T.StringType(), tokenizer, "decode")


def id_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = decode(encode(docs.select("doc_id", "text"), tokenizer).select("doc_id", "ids"), tokenizer)
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return rows.select("doc_id", id_count(F.col("ids")).alias("n_tokens"), *digests)
