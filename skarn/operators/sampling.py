"""Seeded samples of exact size and largest-remainder class quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 42
#: Quotas are broadcast up to this number of classes.
BROADCAST_CLASSES = 10_000


def quotas(df: DataFrame, label: str, size: int) -> DataFrame:
    """``label``, ``n`` and ``quota``: shares of ``size`` rounded down, the rest to the largest remainders (ties by label)."""
    table = df.groupBy(label).agg(F.count("*").alias("n"))
    total = table.agg(F.sum("n").alias("total"))
    exact = table.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * F.lit(size) / F.col("total")).withColumn("floor", F.floor("share"))
    w = W.orderBy(F.desc(F.round(F.col("share") - F.col("floor"), 9)), label)  # one row for each class
    left = F.lit(size) - F.sum("floor").over(W.partitionBy())
    return exact.withColumn("quota", F.least(F.col("n"), F.col("floor") + F.when(F.row_number().over(w) <= left, 1).otherwise(0))).select(label, "n", F.col("quota").cast("long").alias("quota"))


def stratified(df: DataFrame, key: str, label: str, size: int | None, seed: int = SEED) -> DataFrame:
    """Each class's quota of rows, by the order of a seeded hash; everything if ``size`` is null or not below the row count.

    The quota's cut in hash space is found from per-class quantile counts, so no class is ranked in one task: rows are counted in
    4096 hash buckets for each class, whole buckets are kept, and only the bucket at the cut is ranked.
    """
    n = df.count()
    if size is None or size >= n:
        return df
    hashed = df.withColumn("h", F.xxhash64(F.lit(seed), key)).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    sizes = hashed.groupBy(label, "bucket").agg(F.count("*").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy(label).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shares = quotas(df, label, size)
    cut = sizes.withColumn("before", before).join(F.broadcast(shares) if shares.count() <= BROADCAST_CLASSES else shares, label).where("before < quota")
    kept = hashed.join(cut.select(label, "bucket", "in_bucket", "before", "quota"), [label, "bucket"])
    whole = kept.where("before + in_bucket <= quota")
    edge = kept.where("before + in_bucket > quota").withColumn("rank", F.row_number().over(W.partitionBy(label, "bucket").orderBy("h", key))).where("rank <= quota - before")
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def random_sample(df: DataFrame, key: str, size: int | None, seed: int = SEED) -> DataFrame:
    """``size`` rows by the order of a seeded MD5 of the key; everything if it is null or not below the row count.

    Rows are counted in 65,536 hash buckets; the buckets before the cut are kept whole, and only the bucket at the cut is sorted, so no task holds the sample.
    """
    if size is None or size >= df.count():
        return df
    hashed = df.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    at = before = 0
    for r in hashed.groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect():  # one row for each bucket
        at = r.bucket
        if before + r.n > size:
            break
        before += r.n
    whole = hashed.where(F.col("bucket") < at)
    edge = hashed.where(F.col("bucket") == at).orderBy("h", key).limit(size - before)
    return whole.unionByName(edge).select(*df.columns)


def metadata(before: DataFrame, after: DataFrame, label: str, size: int | None, strategy: str, seed: int = SEED) -> DataFrame:
    """One row: what was sampled, and the label counts before and after."""
    as_map = lambda df, name: df.groupBy(label).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias(name), F.sum("n").alias(f"n_{name}"))
    both = as_map(before, "class_distribution_before").crossJoin(as_map(after, "class_distribution_after"))
    n, m = F.col("n_class_distribution_before"), F.col("n_class_distribution_after")
    return both.select(
        (m < n).alias("applied"), m.alias("sample_size"), n.alias("total_available"), F.lit(strategy).alias("sample_strategy"),
        F.round(F.try_divide(m * 100.0, n), 2).alias("sample_percentage"), "class_distribution_before", "class_distribution_after", F.lit(seed).alias("random_seed"),
    )
