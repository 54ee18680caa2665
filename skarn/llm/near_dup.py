"""MinHash near-duplicate detection by a signature-coordinate inverted join.

A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased); with fewer words the whole sequence is its only
shingle, without words the set is empty and linked with nothing.  Two documents are linked if their sets have a Jaccard
similarity of ``percent`` / 100 or more; a component is what links reach.

Method:

1. Sets and MinHash signatures of ``COORDINATES`` values.  Documents with equal sets (128-bit fingerprint) are one *class*; its
   least document stands for it from here on.
2. Inverted join: classes are posted under (coordinate, value) pairs.  A pair of classes is retained if at least ``MATCHES``
   coordinates agree.  For that it must share one of the first ``COORDINATES - MATCHES + 1`` pairs of both in any fixed order of
   pairs (prefix), so only those are posted, and the order puts frequent pairs last (skip): counts come from a hashed
   table of bounded size, which all tasks use alike, so a coarse count costs time, never a link.  Two classes of similarity
   0.75 agree in 48 of 64 coordinates on average and in fewer than 28 with a probability of about 1e-8.
3. Lists with one posting are dropped; lists of up to ``BLOCK`` are one group of rows, whose collisions are counted in numpy.  A longer
   list is dealt into groups of about ``BLOCK``; near copies share many long lists, so a class is dealt twice in two of its own.  A group
   gives out a forest of its retained pairs, and these forests connect near copies; a pair of classes that are already connected
   need not be counted again.  Where any long list still falls into several components, its largest one is compared with the
   others, and the others with each other, group by group, which completes all pairs of the list: first in one list for each
   component outside of the largest one, then in all lists that are still split.  Components of these forests are the
   candidate clusters.
4. The full sets of each cluster are compared in the same way, exactly: clusters of one group at once, larger ones dealt twice,
   then what is not yet connected to a cluster's largest component against all.  Components of the links are the result.

So g near copies make 4g rows in the lists and 2g as a cluster, and g * ceil(o / ``BLOCK``) more for the o classes outside of its
largest component (for a list of unlike classes that is quadratic; the order of the prefix keeps such lists short).  No pair is left out.

Defined cases: null text is empty; rows with one ``doc_id`` and one text are one document; rows with one ``doc_id`` and different texts are
documents of their own (see ``identity``), so an id may lead several components; rows without ``doc_id`` sort after all others, are
one document where their texts are equal, and have a null ``component_id`` where they lead their component; ``kept`` is true for
the row(s) of the least ``doc_id`` of a component (without ids: of its least text); extra columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .identity import DOC, NO_ID, SUB, keyed, settled, shared_ids
from .scratch import Scratch
from .words import U64, Words, mix, pieces, sequences, windows, words_of

SIZE = 5
PERCENT = 75
COORDINATES = 64
MATCHES = 28
#: Cells of the hashed frequency table (4 bytes each), which is broadcast.
CELLS = 1 << 20
PARTS = 64
#: Rows of a group, and shingles of a group of full sets.
BLOCK = 128
BLOCK_SHINGLES = 1 << 18
#: Cluster membership and other tables of counted size are broadcast up to this size; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
KEY = f"{DOC} long, {SUB} long"

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 1 << 63, COORDINATES, dtype=U64)
_TIMES = _RNG.integers(0, 1 << 63, COORDINATES, dtype=U64) * U64(2) + U64(1)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin (one more at the end)."""
    at, hashes = windows(w, size)
    n_texts = len(w.first) - 1
    cut = np.searchsorted(at, w.first)
    short = (w.counts > 0) & (w.counts < size)
    whole = sequences(w, np.arange(n_texts), 5) if short.any() else None
    sets = []
    for d in range(n_texts):
        if short[d]:
            sets.append(whole[d : d + 1])
        else:
            sets.append(np.unique(hashes[cut[d] : cut[d + 1]]))
    return np.concatenate(sets) if sets else hashes, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(shingles: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each set; zeros for an empty one."""
    out = np.zeros((len(cut) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        for j in range(COORDINATES):
            out[full, j] = np.minimum.reduceat((shingles ^ _FLIP[j]) * _TIMES[j], cut[full]) >> U64(32)
    return out


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
    return (total[cut[1:]] - total[cut[:-1]]).view(np.int64)


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts):
                shingles, cut = shingle_sets(words_of(texts[lo:hi], lower=True), size)
                a, b = (_sums(mix(shingles, s), cut) for s in (3, 4))
                sig = signatures(shingles, cut)
                rows = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(DOC)[lo:hi], batch.column(SUB)[lo:hi], pa.array(np.diff(cut)), pa.array(a), pa.array(b), rows], [DOC, SUB, "n", "a", "b", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _tokens(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each (coordinate, value) pair."""
    return mix((np.arange(COORDINATES, dtype=U64)[None, :] << U64(32)) | sig.astype(U64), 9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's part of the table, packed: cells that it doesn't meet cost next to nothing."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        if len(batch):
            total += np.bincount((_tokens(_matrix(batch.column("sig"))) >> U64(44)).astype(np.int64).ravel(), minlength=CELLS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_packed(p) for p in np.split(total, PARTS)], pa.binary())], ["part", "counts"])


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            totals[part] = totals.get(part, 0) + _counts(counts)
    yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array([_packed(x) for x in totals.values()], pa.binary())], ["part", "counts"])


def _prefixes(frequency, sig: np.ndarray) -> np.ndarray:
    """Keys of the postings of each signature: its rarest pairs by the hashed counts."""
    table = np.frombuffer(frequency.value, np.uint32)
    token = _tokens(sig)
    rank = (np.minimum(table[(token >> U64(44)).astype(np.int64)], U64(0xFFFFFF)).astype(U64) << U64(40)) | (token & U64((1 << 40) - 1))
    prefix = np.argpartition(rank, COORDINATES - MATCHES, axis=1)[:, : COORDINATES - MATCHES + 1]
    return np.take_along_axis(token, prefix, 1).view(np.int64)


def _postings(frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key = _prefixes(frequency, _matrix(batch.column("sig")))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), key.shape[1]))], ["key", "id"])

    return run


def _shares(frequency):
    """Postings of each (key, label), counted within a batch: near copies of one label make a row for each key, not for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key = _prefixes(frequency, _matrix(batch.column("sig")))
                pairs = np.column_stack([key.ravel(), np.repeat(batch.column("label").to_numpy(), key.shape[1])])
                pairs, n = np.unique(pairs, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], ["key", "label", "c"])

    return run


def in_groups(columns: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Runs ``work`` on whole groups of rows that arrive sorted by ``columns``; holds one batch and one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            last = np.ones(len(table), bool)
            for c in columns:
                x = table.column(c).to_numpy()
                last &= x == x[-1]
            end = int(np.argmax(last))
            rest = table.slice(end)
            if end:
                yield from work(table.slice(0, end))
        if rest is not None:
            yield from work(rest)

    return run


def _bounds(table: pa.Table, columns: list[str]) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in columns:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(new))


GROUP = ["key", "i", "j"]


def _joined(linked: np.ndarray, rest: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (label, least label) that connect what ``linked`` (rows of ``rest`` by all rows) connects."""
    names, number = np.unique(label, return_inverse=True)
    pairs = np.eye(len(names), dtype=bool)
    x, y = np.nonzero(linked)
    pairs[number[rest[x]], number[y]] = True
    pairs |= pairs.T
    least = np.arange(len(names))
    while True:
        new = np.where(pairs, least[None, :], len(names)).min(1)
        new = new[new]  # jump
        if (new == least).all():
            away = np.flatnonzero(least != np.arange(len(names)))
            return names[away], names[least[away]]
        least = new


class Signatures:
    """Signatures of rows; ``MATCHES`` agreeing coordinates link."""

    def __init__(self, payload: pa.ChunkedArray):
        self.sig = _matrix(payload)

    def pairs(self, first: np.ndarray) -> np.ndarray:
        return (self.sig[first] == self.sig[first + 1]).sum(1) >= MATCHES

    def links(self, lo: int, hi: int, rest: np.ndarray) -> np.ndarray:
        sig = self.sig[lo:hi]
        count = np.zeros((len(rest), len(sig)), np.uint8)
        for c in range(COORDINATES):
            count += sig[rest, None, c] == sig[None, :, c]
        return count >= MATCHES


class Sets:
    """Full shingle sets of rows; a Jaccard similarity of ``percent`` / 100 links."""

    def __init__(self, payload: pa.ChunkedArray, percent: int):
        self.sets, self.percent = [np.frombuffer(x, U64) for x in payload.to_pylist()], percent
        self.n = np.array([len(s) for s in self.sets])

    def pairs(self, first: np.ndarray) -> np.ndarray:
        return np.array([bool(self.links(i, i + 2, np.array([1]))[0, 0]) for i in first.tolist()], bool)

    def links(self, lo: int, hi: int, rest: np.ndarray) -> np.ndarray:
        n, inter = self.n[lo:hi], shared(self.sets[lo:hi], rest)
        return 100 * inter >= self.percent * (n[rest, None] + n[None, :] - inter)


def _work(kind: Callable[[pa.ChunkedArray], Signatures | Sets]):
    """Edges of whole groups of rows; pairs of one label are connected already, so rows of the commonest label are not compared with each other."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(table, GROUP)
        label, rows = table.column("label").to_numpy(), kind(table.column("payload"))
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        two = two[label[two] != label[two + 1]]
        two = two[rows.pairs(two)]
        a, b = [np.maximum(label[two], label[two + 1])], [np.minimum(label[two], label[two + 1])]
        for lo, hi in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
            own = label[lo:hi]
            names, n = np.unique(own, return_counts=True)
            rest = np.flatnonzero(own != names[n.argmax()])
            if len(rest):
                x, y = _joined(rows.links(lo, hi, rest), rest, own)
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return work


def shared(sets: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rest`` with all sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])[rest]
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.append(True, flat[1:] != flat[:-1])
    col = np.cumsum(new) - 1
    many = np.bincount(col)[col] > 1
    row, col = row[many], col[many]
    _, col = np.unique(col, return_inverse=True)
    out = np.zeros((len(rest), n), np.int64)
    step = 4096
    cut = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + step + 1, step))
    for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        dense = np.zeros((n, step), np.float32)
        dense[row[lo:hi], col[lo:hi] - k * step] = 1
        out += (dense[rest] @ dense.T).astype(np.int64)
    return out


def _full_sets(size: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in pieces(texts):
                shingles, cut = shingle_sets(words_of(texts[lo:hi], lower=True), size)
                rows = [shingles[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in carry], pa.array(rows, pa.binary())], [*carry, "payload"])

    return run


def sized(df: DataFrame, row_bytes: int, limit: int) -> DataFrame:
    """A written table, marked for broadcast if its counted rows fit ``limit``."""
    return F.broadcast(df) if row_bytes * df.count() <= limit else df


def in_pieces(n: str, shingles: str) -> str:
    """SQL for the number of groups of ``n`` rows with ``shingles`` shingles in all."""
    return f"greatest(1, cast(ceil({n} / {BLOCK}) AS int), cast(ceil({shingles} / {BLOCK_SHINGLES}) AS int))"


def linked(members: DataFrame, attach: Callable[[DataFrame], DataFrame], kind, turns: int, scratch: Scratch, name: str, limit: int, shares: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node`` and ``component`` of the classes that ``kind`` links within their lists.

    ``members`` is a table of ``key``, ``id``, ``n`` and ``blocks``; ``attach`` adds what is compared as ``payload``.  A class is dealt ``turns`` times
    in its long list.  Where classes are in many lists, ``shares`` counts the labels (``id``, ``label``) of each list (``key``, ``label``, ``c``), and a class
    is dealt in two of its long lists (those of least hash, so near copies take the same ones).
    """

    def edges(rows: DataFrame) -> DataFrame:
        return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(in_groups(GROUP, _work(kind)), "a long, b long")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    first, long = members, members.where("blocks > 1")
    if shares:
        own = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("key").alias("h"), "key", "n"))), 1, 2)  # a class has few lists
        cut = long.groupBy("id").agg(own.alias("m")).select("id", F.explode("m").alias("m")).select("m.key", "id", "m.n")
        cut = scratch.write(cut, f"{name}_own")
        sizes = scratch.write(cut.groupBy("key").agg(F.count("*").alias("c")).select("key", F.expr(in_pieces("c", "0")).alias("blocks")), f"{name}_sizes")
        keys = scratch.write(long.select("key").distinct(), f"{name}_keys")
        first = scratch.write(members.where("blocks = 1").unionByName(cut.join(sized(sizes, 16, limit), "key").select("key", "id", "n", "blocks")), f"{name}_first")
    turn = F.explode(F.expr(f"sequence(0, IF(blocks > 1, {turns - 1}, 0))"))
    dealt = attach(first).select("key", "id", "blocks", "payload", turn.alias("i"))
    dealt = dealt.select("key", "i", F.expr("cast(IF(blocks > 1, pmod(xxhash64(id, key, i), blocks), 0) AS int)").alias("j"), F.col("id").alias("label"), "payload")
    found = scratch.write(connected_components(edges(dealt), scratch, name), f"{name}_dealt")

    for step in [f"{name}_near", f"{name}_all"] if shares else [f"{name}_all"]:
        if shares:
            parts = shares(labelled(cut.select("id").distinct())).groupBy("key", "label").agg(F.sum("c").alias("c")).withColumn("s", F.lit(0).cast("long"))
            parts = parts.join(sized(keys, 8, limit), "key", "left_semi")
        else:
            parts = labelled(long).groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        parts = scratch.write(parts, f"{step}_parts")
        split = parts.groupBy("key").agg(F.expr("max(struct(c, label, s))").alias("m"), F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("labels > 1")
        split = scratch.write(split.select("key", F.col("m.label").alias("main"), F.expr(in_pieces("m.c", "m.s")).alias("mains"), F.expr(in_pieces("(c - m.c)", "(s - m.s)")).alias("others")), f"{step}_split")
        if split.isEmpty():
            return found
        if step.endswith("near"):  # one list for each component outside: enough to connect near copies
            outside = parts.join(sized(split, 32, limit), "key").where("label <> main").groupBy("label").agg(F.min_by("key", F.xxhash64("key")).alias("key"))
            one = scratch.write(outside.select("key").distinct(), f"{step}_one")
            split = scratch.write(split.join(sized(one, 8, limit), "key", "left_semi"), f"{step}_chosen")
        rest = labelled(long.select("key", "id", "n").join(sized(split, 32, limit), "key")).withColumn("out", F.expr("label <> main"))
        rest = scratch.write(rest.withColumn("own", F.expr("cast(pmod(xxhash64(id), IF(out, others, mains)) AS int)")), f"{step}_rest")
        with_main = F.expr("IF(out, transform(sequence(0, mains - 1), k -> struct(k AS i, own AS j)), transform(sequence(0, others - 1), k -> struct(own AS i, k AS j)))")
        with_each = F.expr("IF(out, transform(sequence(0, others - 1), k -> struct(-1 - least(own, k) AS i, greatest(own, k) AS j)), array())")
        groups = attach(rest).select("key", "label", "payload", F.explode(F.concat(with_main, with_each)).alias("g")).select("key", "g.i", "g.j", "label", "payload")
        more = scratch.write(connected_components(edges(groups), scratch, f"{step}_more"), f"{step}_merged")
        merged = more.select(F.col("node").alias("component"), F.col("component").alias("final"))
        old = found.join(merged, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
        found = scratch.write(old.unionByName(more.join(found.select("node"), "node", "left_anti")), f"{step}_found")
    return found


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """``skarn_doc``, ``skarn_sub``, ``n_shingles`` and ``lead`` (both numbers of the component's least document) of every row; and the ids with several texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    raw = keyed(docs.select("doc_id", "text")).select(DOC, SUB, "text")
    prints = scratch.write(raw.mapInArrow(_prints(size), f"{KEY}, n long, a long, b long, sig binary"), "prints")
    several = shared_ids(prints, scratch)
    texts, prints = settled(raw, several), settled(prints, several)
    own = F.struct(DOC, SUB)
    classes = prints.where("n > 0").groupBy("a", "b").agg(F.min(own).alias("least"), F.max(own).alias("last"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    parts = classes.select("sig").mapInArrow(_frequencies, "part int, counts binary").repartition("part").mapInArrow(_added, "part int, counts binary").collect()
    table = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for part, counts in parts:
        table[part] = _counts(counts)
    sent = spark.sparkContext.broadcast(np.minimum(table.ravel(), 0xFFFFFFFF).astype(np.uint32).tobytes())
    posted = scratch.write(classes.select("id", "sig").mapInArrow(_postings(sent), "key long, id long"), "posted")
    lists = scratch.write(posted.groupBy("key").agg(F.count("*").alias("g")).where("g > 1").select("key", F.expr(f"cast(ceil(g / {BLOCK}) AS int)").alias("blocks")), "lists")
    long = lists.where("blocks > 1")
    if 16 * long.count() <= broadcast_bytes:  # postings of long lists are not shuffled by their key
        long = F.broadcast(long)
        many = posted.join(long, "key").unionByName(posted.join(long, "key", "left_anti").join(lists.where("blocks = 1"), "key"))
    else:
        many = posted.join(lists, "key")
    many = scratch.write(many.withColumn("n", F.lit(0).cast("long")), "many")
    signed = classes.select("id", F.col("sig").alias("payload"))
    shares = lambda rows: rows.join(classes.select("id", "sig"), "id").mapInArrow(_shares(sent), "key long, label long, c long")
    clusters = linked(many, lambda m: m.join(signed, "id"), Signatures, 2, scratch, "candidates", broadcast_bytes, shares)
    clusters = scratch.write(clusters.select(F.col("node").alias("id"), F.col("component").alias("key")).join(classes.select("id", "n", "least"), "id"), "clusters")

    sent.unpersist()
    blocks = scratch.write(clusters.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("key", F.expr(in_pieces("c", "s")).alias("blocks")), "blocks")
    member = scratch.write(clusters.join(sized(blocks, 16, broadcast_bytes), "key").select("key", "id", "n", "blocks", f"least.{DOC}", f"least.{SUB}"), "member")

    again = prints.select(DOC, SUB).join(sized(member.select(DOC, SUB), 24, broadcast_bytes), [DOC, SUB]).count() > member.count()

    def full(rows: DataFrame) -> DataFrame:
        carry = [c for c in rows.columns if c not in (DOC, SUB)]
        if DOC not in rows.columns:
            rows = scratch.write(rows.join(member.select("id", DOC, SUB), "id"), "wanted")
        found = texts.join(sized(rows, 64, broadcast_bytes), [DOC, SUB]).select(*carry, "text")
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
        sets = found.mapInArrow(_full_sets(size, carry), f"{kinds}, payload binary")
        return sets.dropDuplicates(["id"]) if again else sets  # sets are shuffled once more only for the sake of repeated rows

    ties = scratch.write(linked(member, full, lambda payload: Sets(payload, percent), 2, scratch, "links", broadcast_bytes), "ties")
    of_tied = scratch.write(ties.withColumnRenamed("node", "id").join(classes.select("id", "least"), "id"), "of_tied")
    leads = scratch.write(of_tied.groupBy("component").agg(F.min("least").alias("lead")), "leads")
    tied = of_tied.join(sized(leads, 32, broadcast_bytes), "component").select("id", "lead")
    lead = classes.join(tied, "id", "left").where("last > least OR lead IS NOT NULL").select("a", "b", F.coalesce("lead", "least").alias("lead"))
    lead = scratch.write(lead, "lead")
    found = prints.select(DOC, SUB, "n", "a", "b").join(sized(lead, 48, broadcast_bytes), ["a", "b"], "left")
    scratch.drop(*[t for t in ("classes", "posted", "lists", "many", "clusters", "blocks", "member", "wanted", "ties", "of_tied", "leads")])
    return found.select(DOC, SUB, F.col("n").alias("n_shingles"), F.coalesce("lead", own).alias("lead")), several


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``."""
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    first = (F.col(DOC) == F.col(f"lead.{DOC}")) & ((F.col(DOC) < NO_ID) | (F.col(SUB) == F.col(f"lead.{SUB}")))
    return components(docs, size, percent)[0].select(known(DOC).alias("doc_id"), "n_shingles", known(f"lead.{DOC}").alias("component_id"), first.alias("kept"))


def keep_first(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component, with their own columns, whatever their names.

    The documents that go are broadcast up to ``broadcast_bytes``; more of them are joined by a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "first")
    found, several = components(docs, size, percent, broadcast_bytes)
    gone = scratch.write(found.where(F.struct(DOC, SUB) != F.col("lead")).select(DOC, SUB).distinct(), "gone")
    packed = settled(keyed(docs.select(F.struct("*").alias("skarn_row"), "doc_id", "text")), several)
    return packed.join(sized(gone, 24, broadcast_bytes), [DOC, SUB], "left_anti").select("skarn_row.*")
