"""Interaction audit of document filters: what every order of the filters removes at each step, within every source.

Method: subset-zeta transform.  A document's *mask* has one bit for each filter that it fails.  Spark counts the masks of each part; the
documents that survive a set F of filters are those whose mask lies within the complement of F, so one sum over subsets (``k`` passes over
``2 ** k`` counts) gives the survivors of every set at once, for each measure (all, good and toxic documents).  Step ``i`` of an order is the
difference between two neighbouring sets.  No document is filtered twice, whatever the number of orders.

One pass over the texts gives the masks of the filters that read one text (numpy over Arrow batches, distinct words by 64-bit hash) and a
128-bit fingerprint.  Copies are table-wide: the least id of each fingerprint is an aggregate that combines before the shuffle, and
is joined back on (fingerprint, id), so the copies of one text, however many, are spread over the tasks by their ids.

Defined cases: null text is empty, null source is the part ``''``; an empty table gives no rows.  Rows without ``doc_id`` come after all others
and are no smaller than each other, so they are copies only of a text that some row with an id has; they have no labels.  Repeated
rows (one id and one text) count as often as they occur and are no copies of each other.  An id with several labels is good (toxic) if one of
them says so.  Only the columns ``doc_id``, ``text`` and ``source`` are read, other columns don't matter whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import DOC, NO_ID
from .scratch import Scratch
from .words import pieces, text_buffers, words_of

#: The filters of ``document_masks``; the last one compares documents.
LETTERS = "ABCDE"
LEAST_WORDS = 50
#: Percentages: distinct words of all words at least, capital letters of all code points at most.
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
MEASURES = ("n", "good", "toxic")

_CAPITAL, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(b"#$%&*|")] = True

MARK_SCHEMA = f"{DOC} long, part string, mask int, a long, b long"


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mask of the first four filters, and fingerprint, of each text."""
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in pieces(texts):
            raw, at = text_buffers(texts[lo:hi])
            w = words_of(texts[lo:hi])
            words, owner = w.counts, w.owner()
            order = np.lexsort((w.hashes, owner))
            new = np.ones(len(order), bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | (w.hashes[order][1:] != w.hashes[order][:-1])
            distinct = np.bincount(owner[order][new], minlength=hi - lo)
            points = _sums((raw & 0xC0) != 0x80, at)
            fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * _sums(_CAPITAL[raw], at) > MOST_CAPITALS * points, _sums(_SYMBOL[raw], at) > 0)
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            data = memoryview(raw)
            prints = np.frombuffer(b"".join(hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(at[:-1], at[1:], strict=True)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(DOC)[lo:hi], batch.column("part")[lo:hi], pa.array(mask), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy())], [DOC, "part", "mask", "a", "b"])


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` and the counts ``n``, ``good`` and ``toxic``: one row for each mask that a part has."""
    scratch = Scratch(docs.sparkSession, "audit")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(DOC), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(_marks, MARK_SCHEMA).groupBy(DOC, "part", "mask", "a", "b").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias(DOC)).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    # rows without id have no label: their key is spread by fingerprint, so that they don't meet in one task
    salt = F.when(F.col(DOC) == NO_ID, F.col("a")).otherwise(F.lit(0).cast("long"))
    labelled = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), [DOC, "salt"], "left")
    own = labelled.select(DOC, "part", "mask", "a", "b", "n", *[F.coalesce(F.col(c) * F.col("n"), F.lit(0)).alias(c) for c in MEASURES[1:]])
    own = scratch.write(own, "rows")
    first = own.groupBy("a", "b").agg(F.min(DOC).alias(DOC)).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    whole = own.join(first, ["a", "b", DOC], "left").withColumn("mask", F.col("mask").bitwiseOR(copy))
    counts = whole.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in MEASURES])
    counts = scratch.write(counts, "counts")
    scratch.drop("rows")
    return counts


def survivors(counts: np.ndarray) -> np.ndarray:
    """Documents that pass all filters of a set, for every set: ``counts[..., mask]`` -> ``result[..., set]``, in place over a copy."""
    within = counts.copy()
    masks = np.arange(counts.shape[-1])
    for bit in range(counts.shape[-1].bit_length() - 1):
        has = masks[(masks >> bit) & 1 == 1]
        within[..., has] += within[..., has ^ (1 << bit)]
    return within[..., ::-1]  # the complement of a set counts down as the set counts up


#: Parts that are laid out at once; each has ``k! * k`` rows.
PARTS = 64


def _steps(letters: str):
    k = len(letters)
    orders = list(permutations(range(k)))
    filters = np.array(orders).ravel()
    after = np.array([np.cumsum([1 << f for f in o]) for o in orders]).ravel()
    before = after - (1 << filters)
    full = (1 << k) - 1
    single = 1 << np.arange(k)
    names = ["".join(letters[f] for f in o) for o in orders for _ in range(k)]
    of = np.eye(k, dtype=np.int64)[filters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PARTS):
                rows = batch.slice(lo, PARTS)
                counts = np.zeros((len(rows), len(MEASURES), 1 << k), np.int64)
                for i, masks in enumerate(rows.column("masks").to_pylist()):
                    for m in masks:
                        counts[i, :, m["mask"]] += [m[c] for c in MEASURES]
                s = survivors(counts)
                lost = s[:, :, before] - s[:, :, after]
                removed = lost[:, 0]
                failing = s[:, 0, :1] - s[:, 0, single]
                alone = s[:, 0, full ^ single] - s[:, 0, full :]
                columns = [s[:, 0, after], removed, failing[:, filters] - removed, alone[:, filters], lost[:, 1], lost[:, 2], (removed @ of)[:, filters]]
                n = len(filters)
                part = rows.column("part").take(pa.array(np.repeat(np.arange(len(rows)), n)))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(names * len(rows)), pa.array(np.tile(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)), len(rows))), *[pa.array(c.ravel()) for c in columns]],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    return run


STEP_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def order_steps(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every step of every order of the filters, for each part of a table of mask counts (``part``, ``mask``, ``n``, ``good``, ``toxic``).

    Bit ``i`` of a mask belongs to ``letters[i]``.  ``removed`` fell at this step, ``redundant`` fail its filter but fell earlier, ``unique_fails`` fail no
    other filter, ``shapley`` is the sum of the filter's ``removed`` over all orders.  A part has ``2 ** len(letters)`` masks at most.
    """
    masks = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in MEASURES])
    return masks.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("masks")).mapInArrow(_steps(letters), STEP_SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return order_steps(document_masks(docs, labels))
