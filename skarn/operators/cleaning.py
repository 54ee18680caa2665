"""Cleaning: URL and perceptual-hash deduplication in one ordered fold, and the joins around it."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import MIN_GRAY_STD, MIN_SIDE
from ..functions.urls import normal_url, url_base
from ..sources.staging import Staging
from .graph import components

MAX_DISTANCE = 2
#: Bases of more rows are folded in parts; hot bases are broadcast up to this number.
HOT_ROWS, BROADCAST_BASES = 200_000, 10_000
OUTCOMES = ("ok", "reject_corrupt", "reject_small", "reject_monotone", "reject_missing_url", "reject_url_dup", "reject_hash_dup")


class _Base:
    """What has been accepted of one cell: URLs, and hashes in an index of ``distance + 1`` bands.

    Hashes that differ in ``distance`` bits agree in one band.  Each band value leads to a chain of accepted hashes, so a lookup touches the few
    that share a band and not all of the cell.
    """

    def __init__(self, distance: int):
        self.distance, bands = distance, distance + 1
        self.cuts = [(64 * k // bands, (1 << (64 * (k + 1) // bands - 64 * k // bands)) - 1) for k in range(bands)]
        self.urls: set[str] = set()
        self.names: list[str] = []
        self.hashes = array("Q")
        self.last: list[dict[int, int]] = [{} for _ in range(bands)]
        self.before = [array("q") for _ in range(bands)]

    def accept(self, norm: str | None, phash: str | None, name: str) -> None:
        if norm:
            self.urls.add(norm)
        if phash:
            h, n = int(phash, 16), len(self.names)
            for (low, mask), last, before in zip(self.cuts, self.last, self.before, strict=True):
                v = h >> low & mask
                before.append(last.get(v, -1))
                last[v] = n
            self.hashes.append(h)
            self.names.append(name)

    def near(self, phash: str | None) -> str | None:
        """The first accepted name whose hash is near."""
        if not phash:
            return None
        h, first, hashes = int(phash, 16), len(self.names), self.hashes
        for (low, mask), last, before in zip(self.cuts, self.last, self.before, strict=True):
            n = last.get(h >> low & mask, -1)
            while n >= 0:
                if n < first and (hashes[n] ^ h).bit_count() <= self.distance:
                    first = n
                n = before[n]
        return self.names[first] if first < len(self.names) else None


FACTS = ("base", "cell", "prior", "norm", "sound", "filename", "phash")


def _folded(distance: int):
    """The sequential rule over rows sorted by cell; only the state of one cell is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, _Base(distance)
        for batch in batches:
            reasons, kept = [], []
            for k, (base, cell, prior, norm, sound, name, phash) in enumerate(zip(*(batch.column(c).to_pylist() for c in FACTS), strict=True)):
                if (base, cell) != now:
                    now, state = (base, cell), _Base(distance)
                if prior:
                    state.accept(norm, phash, name)
                    continue
                reason = "duplicate_url" if norm in state.urls else sound
                if reason is None:
                    near = state.near(phash)
                    reason = None if near is None else f"duplicate_phash_of_{near}"
                if reason is None:
                    state.accept(norm, phash, name)
                reasons.append(reason)
                kept.append(k)
            rows = batch.column("skarn_row").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(reasons, pa.string())], ["skarn_row", "reject_reason"])

    return run


def hash_keys(phash: Column, base: Column, distance: int) -> Column:
    """Keys of a hash of 16 hexadecimal digits such that two hashes within ``distance`` share one: its values in each pair of ``distance + 2`` bands.

    As at most ``distance`` bands differ, two are equal; a pair is twice as long as one band would be, so few other hashes share it.
    """
    bands = distance + 2
    bits = F.lpad(F.conv(phash, 16, 2), 64, "0")
    cut = lambda k: F.substring(bits, 64 * k // bands + 1, 64 * (k + 1) // bands - 64 * k // bands)
    return F.array(*[F.xxhash64(F.lit(i), F.lit(j), base, cut(i), cut(j)) for i in range(bands) for j in range(i + 1, bands)])


def cells(rows: DataFrame, staging: Staging, distance: int = MAX_DISTANCE) -> DataFrame:
    """``rows`` (``base``, ``norm``, ``phash``) with ``cell``: rows of a base that may bear on each other share a cell.

    Rows are linked if they have one canonical URL or share a key of ``hash_keys``; cells are the connected components.  Links are a superset of what the
    rule compares, so the rule may be folded cell by cell.  Members of a group are linked to its least one: as many links as rows.
    """
    vertex = F.when(F.col("phash").isNull(), F.xxhash64(F.lit("url"), "base", "norm")).otherwise(F.xxhash64(F.lit("hash"), "base", "phash"))
    rows = rows.withColumn("vertex", vertex)
    posts = rows.select("vertex", F.xxhash64(F.lit("url"), "base", "norm").alias("post"))
    hashed = rows.where("phash IS NOT NULL").select("vertex", "base", "phash").distinct()
    posts = posts.unionByName(hashed.select("vertex", F.explode(hash_keys(F.col("phash"), F.col("base"), distance)).alias("post")))
    posts = staging.write(posts.distinct(), "posts")
    groups = posts.groupBy("post").agg(F.min("vertex").alias("a"), F.max("vertex").alias("z")).where("a < z").select("post", "a")
    links = posts.join(groups, "post").select("a", F.col("vertex").alias("b"))
    found = components(links, staging)
    joined = rows.join(found.withColumnRenamed("v", "vertex"), "vertex", "left")
    return joined.withColumn("cell", F.coalesce("component", "vertex")).drop("component", "vertex")


def own_reason(side: int = MIN_SIDE, least_std: float = MIN_GRAY_STD) -> Column:
    """Why a row is rejected by itself (download, decoding, size, grey deviation), or null."""
    width, height = F.col("width"), F.col("height")
    return (
        F.when(~F.coalesce("downloaded", F.lit(False)), "download_failed")
        .when(width.isNull() | height.isNull(), "corrupt_image")
        .when((width < side) | (height < side), F.concat(F.lit("too_small_"), width.cast("int").cast("string"), F.lit("x"), height.cast("int").cast("string")))
        .when(~F.coalesce(F.col("gray_std") >= least_std, F.lit(False)), "monotone")
    )


def cleaning_fold(
    raw: DataFrame, prior: DataFrame | None = None, order: tuple[str, ...] = ("crawled_at", "filename"), distance: int = MAX_DISTANCE, side: int = MIN_SIDE, least_std: float = MIN_GRAY_STD, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``raw`` with ``cleaned`` and ``reject_reason``; every row gets its own verdict, repeated and null filenames included.

    ``raw`` has ``filename``, ``url``, ``downloaded``, ``width``, ``height`` (null: undecodable), ``gray_std``, ``phash`` and the columns of ``order``.
    ``prior`` (same columns) are rows accepted by earlier runs: they come first and only seed the state.

    The rule is sequential, but rows with the same canonical URL share a URL base and hashes are compared within a base, so folding
    each base by itself is exact.  What a row says by itself is decided by expressions; rows are then sorted by base within
    their partitions and read in one stream, which holds the accepted URLs and hashes of one base (no rows, no image bytes).

    Bases of more than ``hot_rows`` rows are split further, into ``cells``, so that one base is not one task; their rows are written once before that.  Both
    levels give the verdicts of the sequential rule.
    """
    sound = own_reason(side, least_std)
    own = raw.drop("cleaned", "reject_reason")
    facts = [normal_url(F.col("url")).alias("norm"), url_base(F.col("url")).alias("base"), sound.alias("sound"), "filename", F.nullif(F.col("phash"), F.lit("")).alias("phash"), F.struct(*order).alias("place")]
    rows = own.select(F.struct("*").alias("skarn_row"), F.lit(False).alias("prior"), *facts)
    if prior is not None:
        rows = rows.unionByName(prior.select(F.lit(None).cast(rows.schema["skarn_row"].dataType).alias("skarn_row"), F.lit(True).alias("prior"), *facts))
    named = rows.where("base <> ''").withColumn("cell", F.lit(0).cast("long"))
    sizes = raw.select(url_base(F.col("url")).alias("base"))
    if prior is not None:
        sizes = sizes.unionByName(prior.select(url_base(F.col("url")).alias("base")))
    hot = sizes.where("base <> ''").groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("base")
    staging = Staging(raw.sparkSession, "cells")
    hot = staging.write(hot, "hot")
    if hot.isEmpty():
        staging.drop()
    else:
        n = hot.count()  # at most one base in ``hot_rows`` rows
        hot = F.broadcast(hot) if n <= BROADCAST_BASES else hot
        large = staging.write(named.drop("cell").join(hot, "base", "left_semi"), "rows")
        named = named.join(hot, "base", "left_anti").unionByName(cells(large, staging, distance).select(*named.columns))
    known = named.repartition("base", "cell").sortWithinPartitions("base", "cell", F.desc("prior"), "place", "norm", "phash")
    schema = T.StructType([rows.schema["skarn_row"], T.StructField("reject_reason", T.StringType())])
    missing = rows.where("base = '' AND NOT prior").select("skarn_row", F.lit("missing_url").alias("reject_reason"))
    done = known.select("skarn_row", *FACTS).mapInArrow(_folded(distance), schema).unionByName(missing)
    return done.select("skarn_row.*", "reject_reason").withColumn("cleaned", F.col("reject_reason").isNull())


def first_valid_by_url(rows: DataFrame, order: str) -> DataFrame:
    """Reject reason by URL alone: the first row of each canonical URL in ``order`` is accepted.

    The first of each URL is an aggregate that combines before the shuffle, so a hot URL is not ranked in one task.
    """
    named = rows.withColumn("norm_url", normal_url(F.col("url")))
    first = named.where("norm_url <> ''").groupBy("norm_url").agg(F.min(order).alias("skarn_first"))
    reason = F.when(F.col("norm_url") == "", "missing_url").when(F.col(order) > F.col("skarn_first"), "duplicate_url")
    return named.join(first, "norm_url", "left").withColumn("reject_reason", reason).drop("skarn_first")


def not_yet(new: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``done`` (resume); null keys are always new."""
    return new.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by its values; rows are combined before the shuffle."""
    row = F.struct(*order, *[c for c in rows.columns if c not in order])
    best = rows.groupBy(*keys).agg(F.min(row).alias("skarn_best"))
    return best.select(*[F.col("skarn_best").getField(c).alias(c) for c in rows.columns])


def not_crawled(new: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Records whose (url, source) is not stored yet, the first of each by ``order``."""
    return first_of_each(not_yet(new, stored, "url", "source"), ["url", "source"], [order])


def hash_classes(rows: DataFrame, key: str, bits: str, base: str) -> DataFrame:
    """``id`` and ``first``: the least key of the rows of one base with the same hash."""
    least = rows.groupBy(base, bits).agg(F.min(key).alias("first"))
    return rows.join(least, [base, bits]).select(F.col(key).alias("id"), "first")


def near_hash_pairs(rows: DataFrame, key: str, bits: str, base: str, distance: int = MAX_DISTANCE) -> DataFrame:
    """``a``, ``b`` (a < b) and ``distance`` of different 64-bit hashes of one base that differ in ``distance`` bits or fewer.

    Equal hashes are one class and its least key stands for it (``hash_classes`` has the members), so g copies give no g ** 2 / 2 pairs.
    For small distances a hash is cut into bands such that two near hashes agree in two of them; the join is on (base, band numbers, band values),
    not on all pairs of a base.  For larger distances all pairs of a base are compared, in cells of bounded size (``_compared``).
    """
    classes = rows.groupBy(F.col(base).alias("base"), F.col(bits).alias("h")).agg(F.min(key).alias("id"))
    if distance > BANDED_DISTANCE:
        return _compared(classes, distance)
    bands = distance + 2
    cuts = [64 * k // bands for k in range(bands + 1)]
    band = [F.shiftrightunsigned(F.shiftleft(F.col("h"), 64 - hi), 64 - hi + lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    keys = [F.struct(F.lit(i * bands + j).alias("k"), band[i].alias("v"), band[j].alias("w")) for i in range(bands) for j in range(i + 1, bands)]
    side = classes.select("id", "h", "base", F.explode(F.array(*keys)).alias("band"))
    a, b = (side.select(F.col("id").alias(n), F.col("h").alias(f"h_{n}"), "base", "band.k", "band.v", "band.w") for n in "ab")
    far = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    return a.join(b, ["base", "k", "v", "w"]).where((F.col("a") < F.col("b")) & (far <= distance)).select("a", "b", far.cast("int").alias("distance")).distinct()


#: Distances up to this one are found by bands; for larger ones bands are so short that most pairs share one.
BANDED_DISTANCE = 4
#: Hashes of a base in one group, about; a cell compares two groups.
GROUP_ROWS = 16_384


def _compared(classes: DataFrame, distance: int) -> DataFrame:
    """``near_hash_pairs`` of different hashes ``h`` (``base``, ``id``) by comparing all pairs of a base, each pair once.

    The hashes of a base are dealt into groups by hash, and each two groups (or a group with itself) are a cell, which one task compares with XOR and
    a count of bits.  A task holds two groups whatever the size of the base; cells grow with the square of a base, as its pairs do.
    """
    found = classes.where("base IS NOT NULL AND h IS NOT NULL")
    large = found.groupBy("base").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups")).where("groups > 1")
    total = large.agg(F.coalesce(F.sum(F.col("groups").cast("long") * (F.col("groups") + 1) / 2), F.lit(0)).cast("long")).first()[0]
    dealt = found.join(F.broadcast(large), "base", "left").na.fill(1, ["groups"])  # one row for each GROUP_ROWS hashes at most
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("h"), F.col("groups"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    cells = dealt.select("base", (first * F.col("groups") + second).alias("cell"), (F.col("own") > F.col("other")).alias("second"), "id", "h", (F.col("own") == F.col("other")).alias("alone"))
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total, 20_000))
    met = cells.repartition(tasks, "base", "cell").sortWithinPartitions("base", "cell")

    def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, h = table.column("id").combine_chunks(), table.column("h").to_numpy().view(np.uint64)
        alone, second = bool(table.column("alone")[0].as_py()), table.column("second").to_numpy()
        left = np.flatnonzero(~second)
        right = left if alone else np.flatnonzero(second)
        for lo in range(0, len(left), 256):
            for at in range(lo if alone else 0, len(right), 1024):
                far = np.bitwise_count(h[left[lo : lo + 256], None] ^ h[right[at : at + 1024]])
                i, j = np.nonzero(far <= distance)
                if alone:
                    i, j = i[later := i + lo < j + at], j[later]
                if len(i):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[i + lo])), ids.take(pa.array(right[j + at])), pa.array(far[i, j], pa.int32())], ["x", "y", "distance"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            changed = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (batch.column("base"), batch.column("cell"))]
            cut = [0, *(np.flatnonzero(changed[0] | changed[1]) + 1).tolist(), len(batch)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if parts and any(parts[0].column(c)[0] != part.column(c)[0] for c in ("base", "cell")):
                    yield from pairs(parts)
                    parts = []
                parts.append(part)
        if parts:
            yield from pairs(parts)

    kind = classes.schema["id"].dataType.simpleString()
    near = met.mapInArrow(work, f"x {kind}, y {kind}, distance int")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def outcome(reason: Column) -> Column:
    """The counter that a reject reason belongs to."""
    return (
        F.when(reason.isNull(), "ok")
        .when(reason.isin("corrupt_image", "download_failed"), "reject_corrupt")
        .when(reason.startswith("too_small"), "reject_small")
        .when(reason == "monotone", "reject_monotone")
        .when(reason == "missing_url", "reject_missing_url")
        .when(reason == "duplicate_url", "reject_url_dup")
        .otherwise("reject_hash_dup")
    )


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """One row: every counter and ``pass_rate`` (null if nothing was processed)."""
    kinds = outcome(F.col("reject_reason"))
    row = cleaned.agg(*[F.count_if(kinds == o).alias(o) for o in OUTCOMES], F.count("*").alias("processed"))
    return row.withColumn("pass_rate", F.round(F.try_divide(F.col("ok") * 100.0, F.col("processed")), 2))
