"""Removal of word passages that occur earlier in the corpus.

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it has the same word
sequence as a window starting earlier (smaller ``doc_id``, or the same document and an earlier place).

Method: count-min prefilter, then exact grouping.

1. Documents with the same whole word sequence are found by a 128-bit fingerprint.  All but the first are removed whole
   (their windows all occur in the first, so they are not looked at again).
2. Every window has a *minimiser*: the least hash among its ``width - inner + 1`` runs of ``inner`` words.  Equal windows
   choose the same run at the same offset, so a window occurs at most as often as its minimiser.  Each task adds the
   minimiser places of its documents to a count-min sketch (``ROWS`` rows of cells, counts saturating at 2), and the
   partial sketches are merged by cell range.  Estimates never fall below true counts, so no repeat is lost.
3. A second pass keeps windows whose estimate is 2 or more.  Each task resolves repeats among its own buffered windows at
   once and passes on one row for each window sequence, so a passage that a third of all documents share gives one
   row a buffer, not one a document.  Those rows are grouped by a 128-bit window hash, the least (document, place) is joined
   back, and everything else is a repeat.
4. The places become word ranges for each document, and a last pass over the texts applies them.

The merged sketch has ``2 * ROWS`` cells (bits) or more for each minimiser and is cut into shards by hash range, so it grows with the
corpus.  Up to ``SKETCH_BITS`` it is sent to every executor, which then looks up its own minimisers.  A larger one (above about 0.8
billion words) stays a table of shards: minimisers are dealt to the shard of their hash, looked up there, and only places estimated
repeated come back to their documents by joins.  A shard is looked up by as many tasks as it has ``PLACES`` places (its places are dealt by
document and place, and each task gets its bitmaps), so a passage that a third of all documents share loads no task more than others.  Both
ways look up the same sketch, nothing of unbounded size is broadcast, and the steps after it are the same.

Defined cases: null text is empty; rows with one ``doc_id`` and one text are one document, so a repeated row does not remove its
twin; rows with one ``doc_id`` and different texts are documents of their own, ordered by a hash of the text (see ``identity``), so the
later one loses what the earlier one has; rows without ``doc_id`` sort after all others and are one document where their texts are
equal; shorter texts than ``width`` words are kept whole; other columns, whatever their names, are carried through (but
``remove_repeats`` replaces columns named ``n_words`` and ``n_removed``).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identity import DOC, SUB, keyed, settled, shared_ids
from .scratch import Scratch
from .words import U64, Words, mix, pieces, sequences, windows, words_of

WIDTH = 20
INNER = 10
ROWS = 3
#: Upper bound of the merged sketch, all rows together: 96 MB.
SKETCH_BITS = 3 << 28
SHARDS = 64
#: Windows that a task holds before it resolves and passes them on.
BUFFER = 1 << 18
#: The ids of whole copies, and the removed ranges, are broadcast up to this size; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bits of a shard of a sketch that is not broadcast.
SHARD_BITS = (20, 26)
#: Places that one task looks up in a shard, about.
PLACES = 1 << 22
KEY = f"{DOC} long, {SUB} long"


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(DOC).to_numpy(), batch.column(SUB).to_numpy()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in pieces(texts):
            w = words_of(texts[lo:hi])
            every = np.arange(hi - lo)
            a, b = (sequences(w, every, s).view(np.int64) for s in (0, 1))
            own = [batch.column(c)[lo:hi] for c in (DOC, SUB)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x) for x in (w.counts.astype(np.int64), a, b)]], [DOC, SUB, "n_words", "a", "b"])


def minimisers(w: Words, width: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window places, and for each the place and the hash of its minimiser (leftmost on ties)."""
    at, _ = windows(w, width)
    if not len(at):
        return at, at, np.zeros(0, U64)
    starts, found = windows(w, inner)
    least = np.full(len(w.hashes), np.iinfo(np.uint64).max, U64)
    least[starts] = found
    place = np.arange(len(least))
    span = 1
    while span < width - inner + 1:  # doubling; the last step overlaps
        step = min(span, width - inner + 1 - span)
        right = least[step:] < least[:-step]
        place = np.concatenate([np.where(right, place[step:], place[:-step]), place[-step:]])
        least = np.concatenate([np.where(right, least[step:], least[:-step]), least[-step:]])
        span += step
    return at, place[at], least[at]


@dataclass(frozen=True)
class Shape:
    """A sketch of ``2 ** shards`` shards by hash, each of ``ROWS`` rows of ``2 ** low`` cells."""

    shards: int
    low: int

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes, 10) >> U64(64 - self.shards)).astype(np.int64) if self.shards else np.zeros(len(hashes), np.int64)

    def cells(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The cell of each hash in each row of its shard."""
        return [(mix(hashes, 11 + r) >> U64(64 - self.low)).astype(np.int64) for r in range(ROWS)]


def shape_for(n_words: int, width: int, inner: int, sketch_bits: int) -> tuple[Shape, bool]:
    """A sketch that fits the corpus, and whether it may be broadcast."""
    expected = max(1, 2 * n_words // (width - inner + 2))  # minimisers: two of each inner + 2 places on random text
    bits = max(12, (2 * expected - 1).bit_length())
    if ROWS << bits <= sketch_bits:
        return Shape(SHARDS.bit_length() - 1, bits - SHARDS.bit_length() + 1), True
    low = min(bits, SHARD_BITS[1], max(SHARD_BITS[0], bits - 10))
    return Shape(bits - low, low), False


def hit(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & np.uint8(1) == 1


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64))


SKETCH_SCHEMA = "shard int, row int, once binary, more binary, places long"


def _sketches(width: int, inner: int, shape: Shape):
    """For each task: cells hit once and cells hit more often, by shard."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        number = shape.shard(hashes)
        for r, local in enumerate(shape.cells(hashes)):
            cell, n = np.unique((number << shape.low) | local, return_counts=True)
            of = cell >> shape.low
            cut = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
            own = (cell & ((1 << shape.low) - 1)).astype(np.uint32)
            once, more, places = [], [], np.add.reduceat(n, cut[:-1]).astype(np.int64)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                again = n[i:j] > 1
                once.append(_packed(own[i:j][~again]))
                more.append(_packed(own[i:j][again]))
            yield pa.RecordBatch.from_arrays([pa.array(of[cut[:-1]].astype(np.int32)), pa.array(np.full(len(once), r, np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary()), pa.array(places)], ["shard", "row", "once", "more", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts):
                _, place, least = minimisers(words_of(texts[lo:hi]), width, inner)
                place, first = np.unique(place, return_index=True)
                held.append(least[first])
                size += len(place)
                if size > 4 * BUFFER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


BITMAP_SCHEMA = "shard int, row int, bitmap binary, places long"


def _merged(shape: Shape):
    """Adds the partial sketches of each row of a shard, which arrive one after the other; memory is one row of a shard."""

    def bitmap(now: tuple[int, int], total: np.ndarray, places: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([zlib.compress(np.packbits(total > 1).tobytes(), 1)], pa.binary()), pa.array([places])], ["shard", "row", "bitmap", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, places = None, np.zeros(1, np.uint8), 0
        for batch in batches:
            for shard, row, once, more, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "once", "more", "places")), strict=True):
                if (shard, row) != now:
                    if now is not None:
                        yield bitmap(now, total, places)
                    now, total, places = (shard, row), np.zeros(1 << shape.low, np.uint8), 0
                places += n
                at = _unpacked(once)
                total[at] = np.minimum(total[at] + 1, 2)
                total[_unpacked(more)] = 2
        if now is not None:
            yield bitmap(now, total, places)

    return run


WINDOW_SCHEMA = f"kind int, a long, b long, {KEY}, place int, places array<int>"
PLACE_SCHEMA = f"shard int, part int, row int, hash long, {KEY}, place int, bitmap binary"


def _places(width: int, inner: int, shape: Shape, parts):
    """Shard, part of the shard, hash, document and place of every minimiser; ``row`` puts them after the bitmaps of their part.

    ``parts`` has the number of parts of each shard (broadcast: four bytes for each shard).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, subs), texts = _ids(batch), batch.column("text")
            for lo, hi in pieces(texts):
                w = words_of(texts[lo:hi])
                _, place, least = minimisers(w, width, inner)
                if not len(place):
                    continue
                place, first = np.unique(place, return_index=True)
                hashes, doc = least[first], w.owner()[place]
                shard, own, at = shape.shard(hashes), ids[lo:hi][doc], (place - w.first[doc]).astype(np.int32)
                dealt = mix(own.view(U64) + (at.astype(U64) << U64(40)), 21) % parts.value[shard].astype(U64)
                columns = [shard.astype(np.int32), dealt.astype(np.int32), np.full(len(hashes), ROWS, np.int32), hashes.view(np.int64), own, subs[lo:hi][doc], at]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(hashes), pa.binary())], ["shard", "part", "row", "hash", DOC, SUB, "place", "bitmap"])

    return run


def _looked_up(shape: Shape):
    """Places whose minimiser is estimated repeated.  Rows arrive by part of a shard, its bitmaps first; memory is the bitmaps of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, [None] * ROWS
        for batch in batches:
            shard, part, row = (batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "part", "row"))
            kept = []
            own = (shard << 32) | part
            cut = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if own[i] != now:
                    now, rows = own[i], [None] * ROWS
                while i < j and row[i] < ROWS:
                    rows[row[i]] = np.frombuffer(zlib.decompress(batch.column("bitmap")[i].as_py()), np.uint8)
                    i += 1
                if i < j:
                    seen = np.ones(j - i, bool)
                    for bitmap, cell in zip(rows, shape.cells(batch.column("hash")[i:j].to_numpy().view(U64)), strict=True):
                        seen &= hit(bitmap, cell)
                    kept.append(i + np.flatnonzero(seen))
            if kept:
                yield batch.select([DOC, SUB, "place"]).take(pa.array(np.concatenate(kept)))

    return run


def _candidates(width: int, inner: int, shape: Shape, sketch):
    """Windows whose estimate is 2 or more: repeats inside a buffer (kind 1, by document) and one row for each sequence (kind 0).

    Without a broadcast sketch the rows bring the places of minimisers that were looked up elsewhere as ``hits``.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, doc, sub, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, sub, doc, b, a) if sub.any() else (place, doc, b, a))
        a, b, doc, sub, place = (x[order] for x in (a, b, doc, sub, place))
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        first = ~again
        n = int(first.sum())
        names = ["kind", "a", "b", DOC, SUB, "place", "places"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *[pa.array(x[first]) for x in (a.view(np.int64), b.view(np.int64), doc, sub, place.astype(np.int32))], pa.nulls(n, pa.list_(pa.int32()))], names)
        head = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        again &= (doc != doc[head]) | (sub != sub[head]) | (place != place[head])  # a repeated row is the same occurrence
        doc, sub, place = doc[again], sub[again], place[again].astype(np.int32)
        order = np.lexsort((place, sub, doc))
        doc, sub, place = doc[order], sub[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])
        cut = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)).astype(np.int32)), pa.array(place))
        m = len(cut)
        none = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, none, pa.array(doc[cut]), pa.array(sub[cut]), pa.nulls(m, pa.int32()), lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(x, np.uint8) for x in sketch.value] if sketch else []
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            (ids, subs), texts = _ids(batch), batch.column("text")
            hits = None if sketch else batch.column("hits")
            for lo, hi in pieces(texts):
                w = words_of(texts[lo:hi])
                at, place, least = minimisers(w, width, inner)
                if not len(at):
                    continue
                place, first, back = np.unique(place, return_index=True, return_inverse=True)
                if hits is None:
                    seen = np.ones(len(first), bool)
                    base = shape.shard(least[first]) << shape.low
                    for row, cell in zip(rows, shape.cells(least[first]), strict=True):
                        seen &= hit(row, base | cell)
                else:
                    known = hits[lo:hi]
                    owner = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False))
                    seen = np.isin(place, w.first[owner] + known.flatten().to_numpy(zero_copy_only=False))
                pick = seen[back]
                _, a = windows(w, width)
                _, b = windows(w, width, 1)
                doc = w.owner()[at[pick]]
                held.append((a[pick], b[pick], ids[lo:hi][doc], subs[lo:hi][doc], at[pick] - w.first[doc]))
                size += int(pick.sum())
                if size > BUFFER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _ranges(width: int):
    """Window places of a document -> the word ranges they cover, as int32 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            lists = batch.column("places")
            flat, cut = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                p = np.unique(flat[lo:hi])
                new = np.flatnonzero(np.diff(p, prepend=p[:1] - width - 1) > width)
                blobs.append(np.column_stack([p[new], p[np.append(new[1:], len(p)) - 1] + width]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(DOC), batch.column(SUB), pa.array(blobs, pa.binary())], [DOC, SUB, "ranges"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [np.array([0, n], np.int32).tobytes() for n in batch.column("n").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(DOC), batch.column(SUB), pa.array(blobs, pa.binary())], [DOC, SUB, "ranges"])


def _applied(digest: bool):
    """Takes the ranges out; texts that lose nothing stay as they are, others are the kept words joined by one space."""

    def kept(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
        return b" ".join([raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts):  # rows go on piece by piece, so a task holds one piece beside its input
                w = words_of(texts[lo:hi])
                raw, n_removed, out = w.data.tobytes(), [], []
                for d, blob in enumerate(batch.column("ranges")[lo:hi].to_pylist()):
                    i, j = int(w.first[d]), int(w.first[d + 1])
                    gone = np.zeros(j - i, bool)
                    if blob is not None:
                        for s, e in np.frombuffer(blob, np.int32).reshape(-1, 2):
                            gone[s:e] = True
                    n = int(gone.sum())
                    n_removed.append(n)
                    if digest:
                        out.append(hashlib.sha256(kept(raw, w.starts[i:j], w.ends[i:j], gone)).hexdigest())
                    else:
                        out.append(kept(raw, w.starts[i:j], w.ends[i:j], gone).decode() if n else texts[lo + d].as_py())
                columns = [batch.column("skarn_row")[lo:hi], pa.array(out, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(n_removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["skarn_row", "text", "n_words", "n_removed"])

    return run


def _bitmaps(left: DataFrame, width: int, inner: int, shape: Shape) -> DataFrame:
    partial = left.mapInArrow(_sketches(width, inner, shape), SKETCH_SCHEMA)
    return partial.repartition("shard", "row").sortWithinPartitions("shard", "row").mapInArrow(_merged(shape), BITMAP_SCHEMA)


def removed_ranges(docs: DataFrame, width: int = WIDTH, inner: int = INNER, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame | None, Scratch]:
    """Word ranges to remove (int32 pairs) by ``skarn_doc`` and ``skarn_sub``, for documents that lose words; and the ids with several texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    raw = keyed(docs.select("doc_id", "text")).drop("doc_id")
    prints = scratch.write(raw.mapInArrow(_prints, f"{KEY}, n_words long, a long, b long"), "prints")
    shared = shared_ids(prints, scratch)
    texts, prints = settled(raw, shared), settled(prints, shared)
    own = F.struct(DOC, SUB)
    groups = prints.where(F.col("n_words") >= width).groupBy("a", "b").agg(F.min(own).alias("keep"), F.max(own).alias("last")).where("keep < last")
    groups = scratch.write(groups.select("a", "b", "keep"), "groups")
    copies = scratch.write(prints.join(groups, ["a", "b"]).where(own > F.col("keep")).select(DOC, SUB, "n_words").distinct(), "copies")

    n_words = prints.agg(F.sum("n_words")).first()[0] or 0
    shape, small = shape_for(n_words, width, inner, sketch_bits)
    gone = copies.select(DOC, SUB)
    if 24 * copies.count() <= BROADCAST_BYTES:  # else Spark chooses, and may shuffle the texts
        gone = F.broadcast(gone)
    left = texts.join(gone, [DOC, SUB], "left_anti")
    sent = None
    if small:
        sketch = [bytearray(1 << (shape.shards + shape.low - 3)) for _ in range(ROWS)]
        part = 1 << (shape.low - 3)
        for row in _bitmaps(left, width, inner, shape).collect():  # at most sketch_bits
            sketch[row.row][row.shard * part : (row.shard + 1) * part] = zlib.decompress(row.bitmap)
        sent = spark.sparkContext.broadcast([bytes(x) for x in sketch])
        wanted = left
    else:
        bitmaps = scratch.write(_bitmaps(left, width, inner, shape), "bitmaps")
        parts = np.ones(1 << shape.shards, np.int32)
        for r in bitmaps.where("row = 0").select("shard", "places").toLocalIterator():  # one row for each shard
            parts[r.shard] = max(1, -(-r.places // PLACES))
        number = spark.sparkContext.broadcast(parts)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("hash", "long"), (DOC, "long"), (SUB, "long"), ("place", "int"))]
        asked = left.mapInArrow(_places(width, inner, shape, number), PLACE_SCHEMA)
        copies_of = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("places") / PLACES)).cast("int") - 1)).alias("part")
        both = asked.unionByName(bitmaps.select("shard", copies_of, "row", *none, "bitmap"))
        found = both.repartition("shard", "part").sortWithinPartitions("shard", "part", "row").mapInArrow(_looked_up(shape), f"{KEY}, place int")
        hits = scratch.write(found.groupBy(DOC, SUB).agg(F.collect_list("place").alias("hits")), "hits")
        wanted = left.join(hits, [DOC, SUB])

    found = scratch.write(wanted.mapInArrow(_candidates(width, inner, shape, sent), WINDOW_SCHEMA), "windows", "kind")
    if sent:
        sent.unpersist()
    else:
        scratch.drop("bitmaps", "hits")
    rows = found.where("kind = 0").select("a", "b", DOC, SUB, "place")
    at = F.struct(DOC, SUB, "place")
    least = rows.groupBy("a", "b").agg(F.min(at).alias("m"), F.max(at).alias("x")).where("m < x")
    least = scratch.write(least.select("a", "b", "m"), "least")
    late = rows.join(least, ["a", "b"]).where(at > F.col("m")).select(DOC, SUB, F.array("place").alias("places"))
    local = found.where("kind = 1").select(DOC, SUB, "places")
    places = late.unionByName(local).groupBy(DOC, SUB).agg(F.flatten(F.collect_list("places")).alias("places"))
    spans = places.mapInArrow(_ranges(width), f"{KEY}, ranges binary")
    whole = copies.groupBy(DOC, SUB).agg(F.max("n_words").alias("n")).mapInArrow(_whole, f"{KEY}, ranges binary")
    return scratch.write(spans.unionByName(whole), "ranges"), shared, scratch


def cut(docs: DataFrame, width: int = WIDTH, digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``skarn_row`` (the other columns of each row as a struct), ``text`` without its repeats (or its SHA-256), ``n_words`` and ``n_removed``.

    An unchanged text is returned as it is; a null text stays null.
    """
    ranges, shared, scratch = removed_ranges(docs, width)
    size = ranges.agg(F.sum(F.length("ranges") + 24)).first()[0] or 0
    scratch.drop("prints", "groups", "copies", "windows", "least")
    if size <= broadcast_bytes:
        ranges = F.broadcast(ranges)
    row = F.struct(*[F.col(f"`{c}`") for c in (["doc_id"] if digest else [c for c in docs.columns if c != "text"])]).alias("skarn_row")
    packed = settled(keyed(docs.select(row, "doc_id", "text")), shared)
    joined = packed.join(ranges, [DOC, SUB], "left").select("skarn_row", "text", "ranges")
    fields = [joined.schema["skarn_row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return joined.mapInArrow(_applied(digest), T.StructType(fields))


def remove_repeats(docs: DataFrame, width: int = WIDTH, digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and either the shortened ``text`` or, with ``digest``, ``doc_id`` and ``kept_sha256`` instead."""
    done = cut(docs, width, digest, broadcast_bytes)
    if digest:
        return done.select("skarn_row.doc_id", "n_words", "n_removed", F.col("text").alias("kept_sha256"))
    own = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return done.select(*[F.col("text") if c == "text" else F.col("skarn_row").getField(c).alias(c) for c in own], "n_words", "n_removed")
