"""Ranked lexical search: the ``k`` best documents of every query item, by variable-block-max WAND over shards.

A *term* is a maximal run of ASCII letters, digits and non-ASCII code points, with A-Z lower-cased.  A document's score is the sum of
``w * s`` over the item's terms: ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` weighs the term, ``s = 10**9 tf div (1000 tf + 8 m)`` its *impact* on a
document of ``n`` terms, where ``m = 10 + (90 n N) div L``; all are integers.  N documents have a term, and L terms in all.

1. One pass counts N and L.
2. A second pass makes the index: each task cuts its documents into shards of ``SHARD_BYTES`` of text, and for each term of a shard writes the
   list of documents (numbered by ascending id) and impacts.  Dynamic programming cuts every list into blocks: among all cuts into blocks of up to
   ``MAX_BLOCK`` postings it takes one that minimises the bound error (the block's largest impact less the posting's, summed) plus ``BLOCK_COST`` a block.
3. Queries go to the tasks in blocks of a bounded size, together with the weights of their terms; postings of these terms come together by shard.
   For an item, the weighted block maxima of its terms add up to a bound for every document of the shard (no block: 0).  Documents are
   taken by falling bound; only blocks that hold one of them are read; a document whose bound is under the ``k``-th best score that the task has
   seen so far is never scored.  Bounds equal to that score are still read, so ties fall as they should.
4. Each task passes on ``k`` documents an item at most; they are ranked in salted parts, then once more.

Nothing is dropped: results equal those of scoring every document.  Memory of a task is one shard and one block of queries.  The index
holds all terms, so it serves any number of query sets (``build`` once, ``search`` often).

Defined cases: null texts and texts without terms are no documents (they count in neither N nor L) and items without terms have no rows; rows that share
a ``doc_id`` are documents of their own; rows without id come last among equal scores and have a null id; rows of one ``item_id`` are one item with
the terms of all; fewer than ``k`` documents with a score above 0 are all returned; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .identity import NO_ID
from .scratch import Scratch
from .words import MARKS, U64, pieces, text_buffers, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: A shard's text, and its documents; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Postings of a block at most, and what one more block costs in bound error.
MAX_BLOCK, BLOCK_COST = 32, 2_000_000
#: Terms of all items in one block of queries, about.
BLOCK_TERMS = 1 << 18
#: Documents that are scored in the first round, for each wanted one.
FIRST = 8
SALTS = 64

INDEX_SCHEMA = "kind int, shard long, term string, df int, docs binary, impacts binary, ends binary, tops binary"


def terms_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1)))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = terms = 0
        for lo, hi in pieces(batch.column("text")):
            raw, at = text_buffers(batch.column("text")[lo:hi])
            solid = ~MARKS[raw]
            fresh = solid.copy()
            fresh[1:] &= ~solid[:-1]
            heads = at[:-1][at[:-1] < at[1:]]
            fresh[heads] = solid[heads]
            total = np.concatenate([[0], np.cumsum(fresh)])
            n = total[at[1:]] - total[at[:-1]]
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``m`` of documents of ``n`` terms; products that don't fit 64 bits are made by Python."""
    if int(n.max(initial=0)) * 90 * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)


def block_ends(impacts: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block ends of lists (``cut[i]:cut[i + 1]`` is list ``i``): the list of each end, and its place in ``impacts`` (exclusive).

    The least cost up to posting ``j`` is the minimum over the last block's length of the cost before it, plus ``BLOCK_COST`` and its length times
    its maximum (the sum of impacts is the same for all cuts).  Lists of similar lengths take their steps together.
    """
    size = np.diff(cut)
    lists, ends = [np.flatnonzero(size)], [cut[1:][size > 0]]
    bits = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    span = np.arange(1, MAX_BLOCK + 1)
    for b in range(1, bits.max(initial=0) + 1):
        longest = 1 << b
        those = np.flatnonzero(bits == b)
        for lo in range(0, len(those), max(1, (1 << 18) // longest)):
            some = those[lo : lo + max(1, (1 << 18) // longest)]
            some = some[np.argsort(-size[some], kind="stable")]
            n = size[some]
            value = np.zeros((len(some), MAX_BLOCK + longest), np.int64)
            inside = np.arange(longest) < n[:, None]
            value[:, MAX_BLOCK:][inside] = impacts[(cut[some][:, None] + np.arange(longest))[inside]]
            cost = np.full((len(some), MAX_BLOCK + longest + 1), 1 << 60, np.int64)
            cost[:, MAX_BLOCK] = 0
            last = np.zeros((len(some), longest + 1), np.int16)
            alive = np.searchsorted(-n, -np.arange(longest + 1), side="right")  # lists of at least j postings
            for j in range(1, int(n[0]) + 1):
                m = alive[j]
                most = np.maximum.accumulate(value[:m, j : j + MAX_BLOCK][:, ::-1], axis=1)
                most *= span
                most += cost[:m, j : j + MAX_BLOCK][:, ::-1]
                best = most.argmin(1)
                last[:m, j] = best + 1
                cost[:m, MAX_BLOCK + j] = most[np.arange(m), best] + BLOCK_COST
            at, own = n - last[np.arange(len(some)), n], some
            while True:  # walk back from the end of every list
                left = at > 0
                if not left.any():
                    break
                at, own, row = at[left], own[left], np.flatnonzero(left)
                lists.append(own)
                ends.append(cut[own] + at)
                last = last[row]
                at = at - last[np.arange(len(at)), at]
    number, end = np.concatenate(lists), np.concatenate(ends)
    order = np.argsort(end, kind="stable")
    return number[order], end[order]


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Parts of ``values`` as the bytes of one array each."""
    at = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


class _Shard:
    """Documents of one shard on their way into the index."""

    def __init__(self):
        self.size, self.docs = 0, 0
        self.ids: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.known = np.zeros(0, U64)
        self.terms: dict[int, bytes] = {}

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        w = words_of(texts, lower=True, breaks=MARKS)
        have = w.counts > 0
        number = self.docs + np.cumsum(have) - 1  # texts without a term get no number of their own and no pair
        self.ids.append(ids[have])
        self.n.append(w.counts[have])
        owner = number[w.owner()].astype(np.int64)
        order = np.lexsort((owner, w.hashes))
        term, doc = w.hashes[order], owner[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.pairs.append((term[at], doc[at].astype(np.int32), np.diff(np.append(at, len(term))).astype(np.int32)))
        heads = np.ones(len(term), bool)
        heads[1:] = term[1:] != term[:-1]
        found, first = term[heads], order[heads]
        fresh = ~np.isin(found, self.known, assume_unique=True)
        data = memoryview(w.data)
        for h, i in zip(found[fresh].tolist(), first[fresh].tolist(), strict=True):
            self.terms[h] = bytes(data[w.starts[i] : w.ends[i]]).lower()
        self.known = np.concatenate([self.known, found[fresh]])
        self.docs += int(have.sum())
        self.size += len(w.data)

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        names = ["kind", "shard", "term", "df", "docs", "impacts", "ends", "tops"]
        ids, n = np.concatenate(self.ids), np.concatenate(self.n)
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        known, term = np.unique(term, return_inverse=True)
        place = rank[doc]
        order = np.argsort(term * len(ids) + place)
        term, place, tf = term[order], place[order].astype(np.int32), tf[order].astype(np.int64)
        impact = 10**9 * tf // (1000 * tf + 8 * lengths(n[by_id].astype(np.int64), n_docs, n_terms)[place])
        cut = np.searchsorted(term, np.arange(len(known) + 1))
        number, end = block_ends(impact, cut)
        tops = np.maximum.reduceat(impact, np.concatenate([[0], end[:-1]]))
        blocks = np.searchsorted(number, np.arange(len(known) + 1))
        impact, tops, ends = impact.astype(np.int32), tops.astype(np.int32), (end - cut[number]).astype(np.int32)
        size = np.diff(cut).astype(np.int32)
        none = pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([shard]), pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int32()), _binary(ids[by_id], np.array([0, len(ids)])), none, none, none], names)
        step = 1 << 14
        words = [self.terms[h] for h in known.tolist()]
        for lo in range(0, len(known), step):
            hi = min(lo + step, len(known))
            i, j, p, q = cut[lo], cut[hi], blocks[lo], blocks[hi]
            own, cuts = cut[lo : hi + 1] - i, blocks[lo : hi + 1] - p
            columns = [pa.array(np.ones(hi - lo, np.int32)), pa.array(np.full(hi - lo, shard)), pa.array(words[lo:hi], pa.binary()).cast(pa.string()), pa.array(size[lo:hi])]
            yield pa.RecordBatch.from_arrays([*columns, _binary(place[i:j], own), _binary(impact[i:j], own), _binary(ends[p:q], cuts), _binary(tops[p:q], cuts)], names)


def _indexed(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
            for lo, hi in pieces(texts):
                shard.add(ids[lo:hi], texts[lo:hi])
                if shard.size >= SHARD_BYTES or shard.docs >= SHARD_DOCS:
                    if shard.docs:
                        yield from shard.rows(number, n_docs, n_terms)
                    number, shard = number + 1, _Shard()
        if shard.docs:
            yield from shard.rows(number, n_docs, n_terms)

    return run


@dataclass
class Index:
    """``table`` has a row for each term of each shard (kind 1) and one with the ids of each shard (kind 0)."""

    table: DataFrame
    n_docs: int
    n_terms: int
    scratch: Scratch


def build(docs: DataFrame) -> Index:
    scratch = Scratch(docs.sparkSession, "lexical")
    total = docs.select("text").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return Index(scratch.write(rows.mapInArrow(_indexed(n_docs, n_terms), INDEX_SCHEMA), "index", "kind"), n_docs, n_terms, scratch)


class _Postings:
    """Lists and blocks of a shard's terms that some item asks for, end to end."""

    def __init__(self, rows: list[pa.RecordBatch], number: dict[str, int], n_terms: int):
        self.ids = np.zeros(0, np.int64)
        docs, impacts, ends, tops, lists, sizes = [], [], [], [], [], []
        for batch in rows:
            for kind in (0, 1):
                own = batch.filter(pa.compute.equal(batch.column("kind"), kind))
                if not len(own):
                    continue
                if not kind:
                    self.ids = np.frombuffer(own.column("docs")[0].as_py(), np.int64)
                    continue
                value = lambda c: (lambda raw, at: (raw.view(np.int32), at // 4))(*text_buffers(own.column(c)))  # noqa: B023, E731
                (d, at), (x, _), (e, blocks), (t, _) = (value(c) for c in ("docs", "impacts", "ends", "tops"))
                docs.append(d)
                impacts.append(x)
                sizes.append(np.diff(at))
                ends.append((e, np.diff(blocks)))
                tops.append(t)
                lists.append(np.array([number[w] for w in own.column("term").to_pylist()]))
        self.docs, self.impacts = np.concatenate(docs), np.concatenate(impacts).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(np.concatenate(sizes))[:-1]])
        count = np.concatenate([b for _, b in ends])
        self.stop = np.concatenate([e for e, _ in ends]) + np.repeat(start, count)
        self.start = np.concatenate([[0], self.stop[:-1]])  # lists lie end to end, so do their blocks
        self.low, self.high = self.docs[self.start], self.docs[self.stop - 1] + 1
        self.top = np.concatenate(tops).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        self.first, self.count = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        which = np.concatenate(lists)
        self.first[which], self.count[which] = first, count


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``count[i]`` of them) for each i, end to end."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def _added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by place; ``bincount`` adds doubles, which is exact below 2 ** 53, so larger totals are added in two halves."""
    if len(values) * int(values.max(initial=0)) < 1 << 53:
        return np.bincount(at, values, n).astype(np.int64)
    return (np.bincount(at, values >> 24, n).astype(np.int64) << 24) + np.bincount(at, values & 0xFFFFFF, n).astype(np.int64)


def _best(p: _Postings, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of an item: those seen so far, and those of this shard."""
    n = len(p.ids)
    block = _spread(p.first[terms], p.count[terms])
    weight = np.repeat(weights, p.count[terms])
    value = weight * p.top[block]
    bound = np.cumsum(_added(p.low[block], value, n + 1) - _added(p.high[block], value, n + 1))[:n]
    order = np.argsort(-bound, kind="stable")
    at, step = 0, FIRST * k
    while True:
        least = max(1, int(scores[-1])) if len(scores) == k else 1
        # bounds fall along ``order``: what lies beyond is under the threshold
        some = order[at : min(at + step, int(np.searchsorted(-bound[order], -least, side="right")))]
        if not len(some):
            return scores, ids
        at, step = at + len(some), step * 8
        wanted = np.zeros(n, bool)
        wanted[some] = True
        held = np.concatenate([[0], np.cumsum(wanted)])
        read = held[p.high[block]] > held[p.low[block]]
        size = (p.stop - p.start)[block[read]]
        posting = _spread(p.start[block[read]], size)
        mine = wanted[p.docs[posting]]
        posting, own = posting[mine], np.repeat(weight[read], size)[mine]
        total = _added(p.docs[posting], own * p.impacts[posting], n)[some]
        good = total >= least
        scores, ids = np.concatenate([scores, total[good]]), np.concatenate([ids, p.ids[some[good]]])
        keep = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[keep], ids[keep]


def _searched(sent, k: int):
    """The ``k`` best of every item among all shards of a task; rows arrive by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items = sent.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)

        def shard(rows: list[pa.RecordBatch]) -> None:
            if sum(len(r) for r in rows) < 2:
                return
            p = _Postings(rows, number, len(number))
            for i, (terms, weights) in enumerate(items):
                here = p.count[terms] > 0
                if here.any():
                    best[i] = _best(p, terms[here], weights[here], *best[i], k)

        now, held = None, []
        for batch in batches:
            of = batch.column("shard").to_numpy()
            cut = np.append(np.flatnonzero(np.diff(of, prepend=of[:1] - 1)), len(of))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if of[i] != now:
                    shard(held)
                    now, held = of[i], []
                held.append(batch.slice(i, j - i))
        shard(held)
        count = [len(s) for s, _ in best]
        if sum(count):
            columns = [np.repeat(np.arange(len(best), dtype=np.int32), count), *(np.concatenate([b[c] for b in best]) for c in (1, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "doc_id", "score"])

    return run


def _block(index: Index, items: list, k: int) -> DataFrame:
    """``item`` (place in ``items``), ``doc_id``, ``score`` and ``rank`` for the items of one block."""
    spark = index.scratch.spark
    number = {t: i for i, t in enumerate(sorted({t.term for r in items for t in r.terms}))}
    lists = [(np.array([number[t.term] for t in r.terms]), np.array([t.w for t in r.terms], np.int64)) for r in items]
    sent = spark.sparkContext.broadcast((number, lists))
    words = spark.createDataFrame([(t,) for t in number], "term string")  # at most the terms of one block of queries
    rows = index.table.where("kind = 1").join(F.broadcast(words), "term", "left_semi").unionByName(index.table.where("kind = 0"))
    by_shard = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    found = by_shard.select("kind", "shard", "term", "docs", "impacts", "ends", "tops").mapInArrow(_searched(sent, k), "item int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id")]
    part = W.partitionBy("item", "salt").orderBy(*order)
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "doc_id", "score", "rank")


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``: the ``k`` best documents of each row of ``items`` (``item_id``, ``text``)."""
    spark, scratch = index.scratch.spark, Scratch(index.scratch.spark, "search")
    asked = scratch.write(items.select("item_id", F.explode(terms_of(F.col("text").cast("string"))).alias("term")).distinct(), "asked")
    terms = asked.select("term").distinct()
    df = index.table.where("kind = 1").select("term", "df").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = asked.join(df, "term").select("item_id", F.struct("term", weight.alias("w")).alias("t")).where("t.w > 0")
    weighed = scratch.write(weighed.groupBy("item_id").agg(F.collect_list("t").alias("terms")), "items")
    blocks = max(1, math.ceil((weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    kind = items.schema["item_id"].dataType
    out = None
    for b in range(blocks):
        block = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        hits = _block(index, block, k).join(F.broadcast(names), "item")
        hits = scratch.write(hits.select("item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score"), f"hits-{b}")
        out = hits if out is None else out.unionByName(hits)
    scratch.drop("asked", "items")
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` in an index of ``docs`` that is deleted afterwards."""
    index = build(docs)
    found = search(index, items, k)
    index.scratch.drop()
    return found
