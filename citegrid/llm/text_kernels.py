"""Vectorised word hashing that tasks run over batches of texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, which is what
``bytes.split()`` returns. Hashes are 64 bits; `seed` picks one of two independent families, so that a
pair of them identifies a sequence of words with 96 or 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of a long text that are looked at together.
PIECE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MUL = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


_GAP = re.compile(rb"[\x20\x09-\x0D]").search


def pieces(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """data in pieces of about size bytes, cut at white space, so that no word is divided."""
    size, at = size or PIECE, 0
    while at + size < len(data):
        gap = _GAP(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i up to n."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        r = int(_ODD[seed])
        size = max(n, 1 << 20)
        up, down = np.full(size, r, dtype=np.uint64), np.full(size, pow(r, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _POWERS[seed] = have
    return have


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, start and end of each word in it, and the number of the first word of each text (one more at the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    solid = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return buf, starts, ends, np.searchsorted(starts, bounds)


def long_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """A hash of each word of one text, made piece by piece: 8 bytes a word stay."""
    out = [np.empty(0, dtype=np.uint64)]
    for piece in pieces(data):
        buf, starts, ends, _ = word_spans([piece])
        out.append(word_hashes(buf, starts, ends, seed))
    return np.concatenate(out)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word, from one prefix sum of the buffer's polynomial."""
    up, down = _powers(len(buf) + 1, seed)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL[seed])


def _join(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return mix(a * _MUL[seed] + b)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of n words (len(words) - n + 1 of them), built by doubling."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out, have, power, size = None, 0, words, 1
    rest = n
    while rest:
        if rest & 1:
            out, have = (power, size) if out is None else (_join(out[: len(words) - have - size + 1], power[have : have + len(words) - have - size + 1], seed), have + size)
        rest >>= 1
        if rest:
            power, size = _join(power[:-size], power[size:], seed), 2 * size
    return out[: len(words) - n + 1]
