"""Toxicity by a classifier chain.

The chain predicts ``CATEGORIES`` one after the other.  Each link is a logistic model over the presence of hashed words and word
beginnings (lower-cased, cut at ASCII punctuation) and over the log-odds that the earlier links give; it is trained with out-of-fold predictions
of those links, so it sees them as wrong as they are on new texts.  Words enter with their smoothed log-count ratio, and only if
it is clear in the sample, which keeps the model small and clean texts clean.

Only the last category has labels of its own.  The earlier ones are two themes found in the sample, in whatever language it is: the clear
word in most toxic texts, the clear word in most toxic texts without it, and each other clear word with the one of the two beside which
it stands more often.  A toxic text is positive for the themes whose words it holds.  No word list is built in.

Training uses at most ``PER_CLASS`` labelled rows of each class that are not held out (see ``labelled``); the weights, 4 bytes for each
bucket and link, are broadcast.

Defined cases: null or empty text has no words and gets the chain's bias alone; without labels of both classes nothing is toxic; repeated rows
get equal scores; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .words import MARKS, U64, pieces, prefixes, words_of

CATEGORIES = ("first_theme", "second_theme", "toxic")
BITS = 20
#: Bytes of the word beginnings that are features beside whole words: stems of inflected or compound words.
BEGINNINGS = (4, 5, 6)
PER_CLASS = 4000
FOLDS = 3
LEAST_TEXTS = 4
LEAST_RATIO = 2.5
STEPS = 150
DECAY = 1e-3
THRESHOLD = 0.5


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every distinct word and word beginning of each text, in order."""
    w = words_of(texts, lower=True, breaks=MARKS)
    owner, found = w.owner(), [(np.arange(len(w.hashes)), w.hashes), *[prefixes(w, k, lower=True) for k in BEGINNINGS]]
    key = np.unique(np.concatenate([(owner[word] << BITS) | (h >> U64(64 - BITS)).astype(np.int64) for word, h in found]))
    return key >> BITS, key & ((1 << BITS) - 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in pieces(texts):
            row, bucket = presence(texts[lo:hi])
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            blobs = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("label")[lo:hi], pa.array(blobs, pa.binary())], ["doc_id", "label", "buckets"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(row: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smoothed log-count ratio of each bucket, 0 where it is not clear."""
    n, size = len(label), 1 << BITS
    hits = np.bincount(bucket, label[row], size)
    texts = np.bincount(bucket, minlength=size)
    ratio = np.log((hits + 0.5) / (max(label.sum(), 1.0) + 1)) - np.log((texts - hits + 0.5) / (n - label.sum() + 1))
    return np.where((texts >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO), ratio, 0.0)


def themes(row: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A column for each theme: the toxic texts that hold one of its words."""
    clear = log_ratios(row, bucket, label) > 0
    own = clear[bucket] & (label[row] > 0)
    row, words = row[own], bucket[own]
    found = np.zeros((len(label), 2))
    if not len(words):
        return found
    names, word = np.unique(words, return_inverse=True)
    anchors, beside = [], []
    left = np.ones(len(label), bool)
    for _ in range(2):
        anchor = np.bincount(word, left[row], len(names)).argmax()  # ties: the least bucket
        holds = np.bincount(row, word == anchor, len(label)) > 0
        anchors.append(anchor)
        beside.append(np.bincount(word, holds[row], len(names)))
        left &= ~holds
    second = (beside[1] > beside[0]) | (np.arange(len(names)) == anchors[1])
    for t, chosen in enumerate((~second, second)):
        found[:, t] = np.bincount(row, chosen[word], len(label)) > 0
    return found


class Link:
    """A logistic model over word presence and earlier log-odds."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, label: np.ndarray):
        n, size = len(label), 1 << BITS
        positive = max(label.sum(), 1.0)
        scale = log_ratios(row, bucket, label)
        own = scale[bucket] != 0
        row, bucket = row[own], bucket[own]
        used, place = np.unique(bucket, return_inverse=True)
        weight, coupling, bias = np.zeros(len(used)), np.zeros(earlier.shape[1]), float(np.log(positive / max(n - label.sum(), 1)))
        value = scale[bucket]
        moment = [np.zeros(len(used)), np.zeros(len(coupling)), 0.0]
        for _ in range(STEPS):
            z = np.bincount(row, value * weight[place], n) + earlier @ coupling + bias
            error = (_sigmoid(z) - label) / n
            slopes = [np.bincount(place, value * error[row], len(used)) + DECAY * weight, earlier.T @ error + DECAY * coupling, error.sum()]
            moment = [0.9 * m + s for m, s in zip(moment, slopes, strict=True)]
            weight, coupling, bias = weight - 0.5 * moment[0], coupling - 0.05 * moment[1], bias - 0.5 * moment[2]
        self.words = np.zeros(size, np.float32)
        self.words[used] = weight * scale[used]
        self.coupling, self.bias = coupling, bias

    def odds(self, row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.words[bucket], len(earlier)) + earlier @ self.coupling + self.bias


def _part(row: np.ndarray, bucket: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = np.cumsum(chosen) - 1
    own = chosen[row]
    return number[row[own]], bucket[own]


def train(row: np.ndarray, bucket: np.ndarray, targets: np.ndarray) -> list[Link]:
    """One link for each column of ``targets``; later links see out-of-fold log-odds of the earlier ones."""
    n = len(targets)
    fold = np.arange(n) % FOLDS
    chain, outside = [], np.zeros((n, 0))
    for c in range(targets.shape[1]):
        chain.append(Link(row, bucket, outside, targets[:, c]))
        odds = np.zeros(n)
        for f in range(FOLDS):
            learn, test = fold != f, fold == f
            link = Link(*_part(row, bucket, learn), outside[learn], targets[learn, c])
            odds[test] = link.odds(*_part(row, bucket, test), outside[test])
        outside = np.column_stack([outside, np.clip(odds, -10, 10)])
    return chain


def chained(chain: list[Link], row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Probabilities of all categories for ``n`` texts."""
    earlier = np.zeros((n, 0))
    for link in chain:
        earlier = np.column_stack([earlier, np.clip(link.odds(row, bucket, earlier), -10, 10)])
    return _sigmoid(earlier)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Link]:
    rows = sample(docs, labels, "toxic", per_class).mapInArrow(_rows, "doc_id long, label int, buckets binary").collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id, bytes(r.buckets)))
    label = np.array([r.label for r in rows], float)
    if len(set(label.tolist())) < 2:
        return []
    sets = [np.frombuffer(r.buckets, np.int32) for r in rows]
    row, bucket = np.repeat(np.arange(len(rows)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64)
    return train(row, bucket, np.column_stack([themes(row, bucket, label), label]))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id``, ``held_out``, a probability ``p_<category>`` for each category, ``score`` (the last one) and ``predicted`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts):
                found = chained(chain, *presence(texts[lo:hi]), hi - lo) if chain else np.zeros((hi - lo, len(names)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *[pa.array(c) for c in found.T]], ["doc_id", *names])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names))
    last = F.col(names[-1])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, last.alias("score"), (last > THRESHOLD).cast("int").alias("predicted"))
