"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target weight x total / its rows.  A document's count is the inverse Poisson
distribution at a uniform number hashed from the seed and the document, so it does not depend on partitions or retries; the row is
exploded by its count, and all copies are dealt out at random and sorted by a second hash: a global shuffle without a sampling pass.
Dealing is by row, so a row that repeats in a third of the table is spread like any other: each row draws a number where it is scanned, before
any shuffle, so a stage that is repeated in part deals the same rows to the same tasks (give ``docs`` as a scan of a written table).

Rates above ``MOST`` are split into equal parts with a hash each (a sum of Poisson numbers is Poisson), so no rate is out of
range.  Source sizes count all rows and are written once, so ``docs`` is read for its sources and then once more.  Their table is broadcast if it has ``BROADCAST_SOURCES`` rows or fewer; a larger one is
joined on (source, salt), so that a source with a third of all rows is spread over tasks.

Defined cases: null is a source of its own; sources without a weight share what the given weights leave in proportion to their
rows; weights of absent sources are spread over the present ones; a zero weight drops a source; repeated rows
get the same count; null ``doc_id`` and text hash as empty; other columns, whatever their names, are carried through (but ``mix`` replaces
columns named ``copies``, ``copy`` and ``place``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MOST = 32.0
#: Longest Poisson table: at a mean of 32, 160 or more has a probability below 1e-53.
TABLE = 160
BROADCAST_SOURCES = 10_000
SALTS = 64
SEED = 17


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float], total: int | None = None) -> DataFrame:
    """``src`` (null: the null source), ``rate``, ``parts`` and the Poisson table ``cdf`` of ``rate / parts``, for each source."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be 0 or more and sum to 1 at most")
    spark = docs.sparkSession
    sizes = Scratch(spark, "mix").write(docs.groupBy(F.col("source").alias("src")).agg(F.count("*").alias("n")), "sizes")
    given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "src string, weight double")
    known = sizes.join(F.broadcast(given), "src", "left")  # as long as the caller's list of weights
    sums = known.agg(F.sum("n").alias("n_all"), F.sum("weight").alias("w_all"), F.sum(F.when(F.col("weight").isNull(), F.col("n"))).alias("n_free"))
    row = sums.first()
    n_all, w_all, n_free = row.n_all or 0, row.w_all or 0.0, row.n_free or 0
    left = max(0.0, 1.0 - w_all) if n_free else 0.0
    scale = 1.0 if n_free or not w_all else 1.0 / w_all
    wanted = float(n_all if total is None else total)
    rate = F.when(F.col("weight").isNull(), F.lit(left * wanted / max(n_free, 1))).otherwise(F.col("weight") * scale * wanted / F.col("n"))
    out = known.select("src", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST)).cast("int"))
    terms = F.expr(f"aggregate(sequence(1, {TABLE}), array(exp(-rate / parts)), (a, k) -> concat(a, array(element_at(a, -1) * (rate / parts) / k)))")
    sums = F.expr("aggregate(terms, array(0D), (a, t) -> concat(a, array(element_at(a, -1) + t)))")
    return out.withColumn("terms", terms).withColumn("cdf", F.slice(sums, 2, TABLE + 1)).drop("terms")


def replicated(docs: DataFrame, weights: Mapping[str, float], total: int | None = None, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``skarn_row`` (a row of ``docs`` as a struct) with ``copies``, ``copy`` and ``place``, shuffled."""
    table = rates(docs, weights, total)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    packed = docs.select(F.struct("*").alias("skarn_row"), F.col("source").alias("own_source"), name.alias("name"), F.rand(seed).alias("draw"))
    same = F.col("own_source").eqNullSafe(F.col("src"))
    if table.select("src").count() <= broadcast_sources:
        joined = packed.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.withColumn("own_salt", F.floor(F.col("draw") * SALTS).cast("int")).join(salted, same & (F.col("own_salt") == F.col("salt")))
    # the count is the number of table entries that the uniform number reaches
    one = uniform(F.lit(f"count{seed}"), F.lit("0"), F.col("name"))
    single = F.size(F.filter("cdf", lambda c: c <= one))
    many = F.expr(f"aggregate(transform(sequence(0, parts - 1), p -> cast(conv(substring(md5(concat_ws('|', 'count{seed}', cast(p AS string), name)), 1, 13), 16, 10) AS double) / {float(1 << 52)!r}), 0, (a, u) -> a + size(filter(cdf, c -> c <= u)))")
    counted = joined.select("skarn_row", "name", "draw", F.when(F.col("parts") == 1, single).otherwise(many).alias("copies"))
    copied = counted.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"place{seed}"), F.col("copy").cast("string"), F.col("name"))), 1, 15), 16, 10).cast("long")
    dealt = copied.select("skarn_row", "copies", "copy", place.alias("place"), F.xxhash64("draw", "copy").alias("deal"))
    return dealt.repartition("deal").sortWithinPartitions("place", "deal").drop("deal")


def mix(docs: DataFrame, weights: Mapping[str, float], total: int | None = None, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``docs`` with ``copies`` (the count of the document), ``copy`` (0 to ``copies`` - 1) and ``place`` (the key of the global shuffle)."""
    own = [F.col("skarn_row").getField(c).alias(c) for c in docs.columns if c not in ("copies", "copy", "place")]
    return replicated(docs, weights, total, seed, broadcast_sources).select(*own, "copies", "copy", "place")
