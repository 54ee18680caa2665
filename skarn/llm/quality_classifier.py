"""Quality classifier with supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character n-grams inside its words, all hashed to ``BUCKETS`` rows of
one table, and of a mark for each word that is the same as the word before; a softmax layer follows.  Both layers are trained
together by stochastic gradient descent in numpy, on at most ``PER_CLASS`` labelled rows of each class that are not held out.
Labels, language, source and id are no inputs.

The mean comes before a linear layer, so for scoring the two layers fold into one number for each bucket: a table of
``8 * BUCKETS`` bytes is broadcast, and a score is the logistic function of the mean of its entries over a text.

Defined cases: null or empty text has no features and gets the score of a zero vector; without labels of both classes all scores
are 0.5; repeated rows get equal scores; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .words import _BYTES, U64, pieces, words_of

BITS = 16
BUCKETS = (1 << BITS) + 1
AGAIN = 1 << BITS
GRAMS = (3, 4)
SIZE = 8
PER_CLASS = 1000
#: Passes over the sample, and the least number of steps, which small samples reach by more passes.
EPOCHS = 6
STEPS = 300
BATCH = 50
RATE = 0.5
THRESHOLD = 0.3
SEED = 5
_SPREAD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature of ``texts``."""
    w = words_of(texts)
    owner = w.owner()
    row = [owner]
    bucket = [(w.hashes * _SPREAD[0]) >> U64(64 - BITS)]
    again = np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
    row.append(owner[again])
    bucket.append(np.full(len(again), AGAIN, U64))
    n = len(w.data)
    if len(w.hashes):
        up, down = _BYTES.get(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((w.data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        chars = np.append(np.flatnonzero((w.data & 0xC0) != 0x80), n)  # where each code point starts, and the end
        low, high = np.searchsorted(chars, w.starts), np.searchsorted(chars, w.ends)
        width = high - low
        inside = np.repeat(high, width)  # end of the word of each of its code points
        place = np.arange(len(inside)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        word_row = np.repeat(owner, width)
        for k, spread in zip(GRAMS, _SPREAD[1:], strict=False):
            fits = place + k <= inside
            at, end = chars[place[fits]], chars[place[fits] + k]
            row.append(word_row[fits])
            bucket.append(((sums[end] - sums[at]) * down[at] * spread) >> U64(64 - BITS))
    return np.concatenate(row), np.concatenate(bucket).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each text and how often they occur."""
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in pieces(texts):
            row, bucket = features(texts[lo:hi])
            key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
            buckets, counts = (key % BUCKETS).astype(np.int32), n.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label")[lo:hi], *[pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (buckets, counts)]],
                ["label", "buckets", "counts"],
            )


@dataclass
class Model:
    """Vectors of the buckets, output weights (one column for each class) and biases."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        return self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> Model:
    """Stochastic gradient descent (Adagrad steps) over batches of documents given as buckets and counts; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, SIZE)), np.zeros((SIZE, 2)), np.zeros(2))
    seen = [np.full(x.shape, 1e-8) for x in (model.vectors, model.output, model.bias)]

    def step(value: np.ndarray, total: np.ndarray, slope: np.ndarray) -> None:
        total += slope * slope
        value -= RATE * slope / np.sqrt(total + 1e-2)

    balance = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        turn = rng.permutation(len(rows))
        for lo in range(0, len(turn), BATCH):
            pick = turn[lo : lo + BATCH]
            sizes = [len(rows[p][0]) for p in pick]
            owner = np.repeat(np.arange(len(pick)), sizes)
            bucket = np.concatenate([rows[p][0] for p in pick])
            share = np.concatenate([rows[p][1] / max(rows[p][1].sum(), 1) for p in pick])
            mean = np.stack([np.bincount(owner, share * model.vectors[bucket, d], len(pick)) for d in range(SIZE)], 1)
            z = mean @ model.output + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= balance[labels[pick], None] / len(pick)
            back = p @ model.output.T
            slope = np.stack([np.bincount(bucket, share * back[owner, d], BUCKETS) for d in range(SIZE)], 1)
            step(model.output, seen[1], mean.T @ p)
            step(model.bias, seen[2], p.sum(0))
            step(model.vectors, seen[0], slope)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = sample(docs, labels, "quality", per_class).mapInArrow(_counted, "label int, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.buckets), bytes(r.counts)))
    found = np.array([r.label for r in rows], np.int64)
    if len(set(found.tolist())) < 2:
        return Model(np.zeros((BUCKETS, SIZE)), np.zeros((SIZE, 2)), np.zeros(2))
    return train([(np.frombuffer(r.buckets, np.int32).astype(np.int64), np.frombuffer(r.counts, np.float32).astype(float)) for r in rows], found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts):
                row, bucket = features(texts[lo:hi])
                n = np.bincount(row, minlength=hi - lo)
                z = np.bincount(row, table[bucket], hi - lo) / np.maximum(n, 1) + bias
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``."""
    scored = score(docs, fit(docs, labels, per_class))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
