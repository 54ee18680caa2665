"""Byte-level BPE encoding and decoding with a rank file.

A text is cut by ``pattern``; each match is encoded on its own, without special tokens, to the tokens that merging the
adjacent pair of least rank again and again would leave.

Method: the bytes of a match are mapped to Latin-1, so that a pyahocorasick trie of all tokens bounds the longest token at a
place.  A walk from the left takes the longest token that fits the one before it, falls back to shorter ones, and steps back
where none fits, marking the place dead.  Two adjacent tokens fit if merging their bytes alone gives just these two; a sequence in
which all neighbours fit is the merge result.  Fits are memoised and no place is left twice, so the walk is linear in the
length of the match.

Defined cases: null or empty text gives no tokens and no bytes; equal rows give equal results; extra columns are not
returned (``keep`` names those that are).  Memory: one text, and memos of a bounded number of entries a worker.
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of the memo of fits, and of each of the two generations of the memo of matches.
FITS = 1 << 18
MEMO = 1 << 17
LONG = 64
#: Upper bound of the vocabulary that is broadcast.
VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks; ranks must be 0, 1, 2 ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.rank = {t: i for i, t in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.longest = max(map(len, tokens))
        self.fits: dict[int, bool] = {}  # by left * number of tokens + right
        self.whole: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The definition: merge the leftmost adjacent pair of least rank until none is left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.tokens):
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _reached(self, token: int) -> bool:
        """Whether merging makes this token at all."""
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self.tokens[token]) == [token]
        return found

    def _fit(self, left: int, right: int) -> bool:
        pair = left * len(self.tokens) + right
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            found = self.fits[pair] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of one match."""
        rank, tokens = self.rank, self.tokens
        known = rank.get(raw)
        if known is not None:
            return [known]
        text, size, place, longest, most = raw.decode("latin-1"), len(raw), 0, self.automaton.longest_prefix, self.longest
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        n = longest(text[:most])
        while place < size:
            while n:
                token = rank.get(raw[place : place + n])
                if token is not None and alive[place + n] and self._reached(token) and (not out or self._fit(out[-1], token)):
                    break
                n -= 1
            if n:
                out.append(token)
                place += n
                n = longest(text[place : place + most])
            else:
                alive[place] = 0
                last = len(tokens[out.pop()])
                place -= last
                n = last - 1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, parts = self.memo, []
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = np.array(self.piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= LONG:
                    if len(memo) >= MEMO:  # matches not seen since the last turn are forgotten
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[piece] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        token = np.frombuffer(ids, "<u4")
        if not len(token):
            return b""
        n = self.lengths[token]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.offsets[token] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def trimmed() -> None:
    """Gives freed memory back to the system: a worker that is reused keeps what earlier tasks, of other stages too, have allocated and freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU allocator has it
    if trim:
        trim(0)


_CODECS: dict[str, Codec] = {}


def _codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec for each vocabulary and worker, kept from task to task."""
    key = hashlib.sha256(b"\0".join([pattern.encode(), *tokens])).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """Columns ``keep`` with ``ids`` (binary, little-endian unsigned 32-bit) and, with ``decode``, ``decoded`` (from the ids).

    ``vocabulary`` is read by the driver and sent to the workers; it may hold ``VOCABULARY_BYTES`` at most.
    """
    tokens = read_ranks(vocabulary)
    if sum(map(len, tokens)) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    names = [*keep, "ids", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        codec = _codec(sent.value, pattern)
        for batch in batches:
            texts = batch.column("skarn_text")
            step = max(1, min(len(texts), 256))
            for lo in range(0, len(texts), step):
                part = batch.slice(lo, step)
                ids = [codec.encode(t) if t else b"" for t in part.column("skarn_text").to_pylist()]
                new = {"ids": pa.array(ids, pa.binary())}
                if decode:
                    new["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c) if c in keep else None) for c in names], names)

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.BinaryType()) for c in names[len(keep) :]])
    return docs.select(*keep, F.col("text").alias("skarn_text")).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded rows."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
