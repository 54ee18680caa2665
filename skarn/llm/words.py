"""Vectorised word kernel shared by the text operators.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  White space is ASCII, so UTF-8 text can be cut
at byte level and whole Arrow batches are handled by a few numpy passes without a Python object for each word.

Hashes are polynomials modulo 2**64 over bytes (words) or word hashes (shingles, windows), read off prefix sums and
finished with a 64-bit mixer.  Memory is a small multiple of one piece (``PIECE`` bytes, or a single longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and all other ASCII characters but letters and digits.
MARKS = _SPACE.copy()
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, size, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9FB21C651E98DF25), _Powers(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of a batch of texts: byte spans, and ``first[d]:first[d + 1]`` as the words of text ``d``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer text makes a range of its own."""
    _, at = text_buffers(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words_of(texts: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE) -> Words:
    """Words of all texts; ``breaks`` says which bytes stand between words."""
    raw, at = text_buffers(texts)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(len(at), np.int64), np.zeros(0, U64))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    space = breaks[raw]
    solid = ~space
    begins = solid & edge[:-1]
    begins[1:] |= solid[1:] & space[:-1]
    stops = solid & edge[1:]
    stops[:-1] |= solid[:-1] & space[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _BYTES.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(((_LOWER if lower else _SAME)[raw].astype(U64) + U64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return Words(raw, starts, ends, np.searchsorted(starts, at), hashes)


def prefixes(words: Words, k: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words longer than ``k`` bytes, and hashes of their first ``k`` bytes."""
    n = len(words.data)
    longer = np.flatnonzero(words.ends - words.starts > k)
    up, down = _BYTES.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(((_LOWER if lower else _SAME)[words.data].astype(U64) + U64(1)) * up[:n], out=sums[1:])
    at = words.starts[longer]
    return longer, mix((sums[at + k] - sums[at]) * down[at], k)


def windows(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``words``) at which a window of ``k`` words of one text starts, and the windows' hashes."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = _WORDS.get(n + 1)
    sums = np.zeros(n + 1, U64)
    values = words.hashes if not seed else mix(words.hashes, seed)
    np.cumsum(values * up[:n], out=sums[1:])
    room = np.repeat(words.first[1:], words.counts)[: n - k + 1] - np.arange(n - k + 1)
    at = np.flatnonzero(room >= k)
    return at, mix((sums[at + k] - sums[at]) * down[at], seed)


def sequences(words: Words, docs: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the whole word sequence of each of ``docs`` (with its length)."""
    n = len(words.hashes)
    up, down = _WORDS.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((words.hashes if not seed else mix(words.hashes, seed)) * up[:n], out=sums[1:])
    lo, hi = words.first[docs], words.first[docs + 1]
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64) * U64(0xA24BAED4963EE407), seed)
