"""Exploratory aggregates: the tables behind every chart.  Domains are given, so absent categories count 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered
from .quantiles import quantiles

QUARTERS = (0.25, 0.5, 0.75)


def domain_table(df: DataFrame, name: str, domain: Sequence[str]) -> DataFrame:
    """One row for each value of a fixed domain, with its place in it."""
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(domain)], f"`{name}` string, place int")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def shares(df: DataFrame, column: str, domain: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Count and percentage of each value; with a domain, of its values only and including absent ones."""
    found = counts(df, column)
    if domain is not None:
        found = F.broadcast(domain_table(df, column, domain)).join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    total = found.agg(F.sum("n").alias("total"))  # one row
    return found.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), digits).alias("pct"))


def crosstab(df: DataFrame, rows: str, row_domain: Sequence[str], columns: str, column_domain: Sequence[str]) -> DataFrame:
    """Two-key counts, one column for each value of the second domain; absent pairs are 0."""
    known = df.where(F.col(rows).isin(list(row_domain)))
    table = known.groupBy(rows).pivot(columns, list(column_domain)).agg(F.count(F.lit(1)))
    return domain_table(df, rows, row_domain).drop("place").join(table, rows, "left").na.fill(0, list(column_domain))


def row_normalised(table: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Each row of a crosstab divided by its sum; an empty row gives nulls."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    rest = [c for c in table.columns if c not in columns]
    return table.select(*rest, *[F.round(F.try_divide(F.col(c).cast("double"), total), digits).alias(c) for c in columns])


def described(df: DataFrame, column: str, digits: int = 0) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum."""
    c = F.col(column).cast("double")
    row = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    row = row.join(F.broadcast(quantiles(df, column, QUARTERS)), how="left")  # one row each
    values = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "q25": F.col("q")[0], "q50": F.col("q")[1], "q75": F.col("q")[2], "max": F.col("max")}
    return row.select("count", *[F.round(v, digits).alias(n) for n, v in values.items()])


def middle_by(df: DataFrame, by: str, column: str) -> DataFrame:
    """Median, minimum and maximum of each group."""
    c = F.col(column).cast("double")
    ends = df.groupBy(F.col(by).alias("skarn_by")).agg(F.min(c).alias("min"), F.max(c).alias("max"))
    half = quantiles(df, column, (0.5,), by)
    return ends.join(half, F.col("skarn_by").eqNullSafe(F.col(by)), "left").select(F.col("skarn_by").alias(by), F.col("q")[0].alias("median"), "min", "max")


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Exact quantile with linear interpolation; null for no rows."""
    one = df.sparkSession.range(1).select()
    return one.join(quantiles(df, column, (q,)), how="left").select(F.col("q")[0].alias("value"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """``bin`` (1 to ``bins``) and ``n`` over the range of the data; the last bin holds the maximum.  Empty bins are left out."""
    values = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins)))
    return values.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    c = F.col(value).cast("double")
    quarters = quantiles(df, value, QUARTERS, by).select(F.col(by).alias("skarn_by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    near = df.select(by, c.alias("v")).join(quarters, F.col(by).eqNullSafe(F.col("skarn_by")))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low = F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("low")
    high = F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("high")
    return near.groupBy(by, "q1", "median", "q3").agg(low, high)


def means_by(df: DataFrame, by: str, *values: str, digits: int = 4) -> DataFrame:
    return df.groupBy(by).agg(*[F.round(F.avg(v), digits).alias(f"mean_{v}") for v in values])


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The smallest of the most frequent values."""
    return df.agg(F.mode(column, True).alias("mode"))


def class_balance(df: DataFrame, column: str, domain: Sequence[str], balanced: float = 0.15) -> DataFrame:
    """Sample deviation over mean of the counts (absent classes count 0), and whether it is below ``balanced``."""
    table = shares(df, column, domain).agg(F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("cv"))
    return table.select(F.round("cv", 4).alias("cv"), (F.col("cv") < balanced).alias("balanced"))


def daily(df: DataFrame, time: str, by: str) -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day"), by).agg(F.count("*").alias("n"))


def stacked(df: DataFrame, over: str, by: str, value: str = "n") -> DataFrame:
    """Base of each bar: the sum of the values before it in its stack, and its top."""
    w = W.partitionBy(over).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("base", F.coalesce(F.sum(value).over(w), F.lit(0))).withColumn("top", F.col("base") + F.col(value))


def time_span(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def pass_rates(df: DataFrame, by: str, passed: Column, domain: Sequence[str]) -> DataFrame:
    """Passed, rejected and pass rate (%; 0 where there is nothing) of each value of a domain, with the plain mean of the rates."""
    table = df.groupBy(by).agg(F.count_if(passed).alias("passed"), F.count_if(~F.coalesce(passed, F.lit(False))).alias("rejected"))
    table = domain_table(df, by, domain).drop("place").join(table, by, "left").na.fill(0, ["passed", "rejected"])
    table = table.withColumn("rate", F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("passed") + F.col("rejected")), F.lit(0.0)))
    mean = table.agg(F.round(F.avg("rate"), 4).alias("mean_rate"))
    return table.crossJoin(F.broadcast(mean)).withColumn("rate", F.round("rate", 4))


def flag_counts(df: DataFrame, by: str, flag: Column) -> DataFrame:
    """Standard and augmented rows of each label."""
    return df.groupBy(by).agg(F.count_if(~F.coalesce(flag, F.lit(False))).alias("standard"), F.count_if(flag).alias("augmented"))


def funnel(*stages: tuple[str, DataFrame]) -> DataFrame:
    """Rows of each stage in order, and their ratio to the stage before and to the first."""
    parts = [df.agg(F.lit(i).alias("place"), F.lit(name).alias("stage"), F.count("*").alias("n")) for i, (name, df) in enumerate(stages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.orderBy("place")  # one row for each stage
    return out.withColumn("ratio", F.round(F.try_divide(F.col("n").cast("double"), F.lag("n").over(w)), 4)).withColumn("growth", F.round(F.try_divide(F.col("n").cast("double"), F.first("n").over(w)), 4))


def prefix_counts(objects: DataFrame, key: str = "key") -> DataFrame:
    """Objects of each folder, standard and augmented by ``_aug`` in the name."""
    return objects.groupBy(F.regexp_extract(key, "^(.*)/", 1).alias("prefix")).agg(F.count_if(~F.col(key).contains("_aug")).alias("standard"), F.count_if(F.col(key).contains("_aug")).alias("augmented"))


def before_and_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of both tables over the union of their values."""
    joined = counts(before, column).withColumnRenamed("n", "n_before").join(counts(after, column).withColumnRenamed("n", "n_after"), column, "full").na.fill(0, ["n_before", "n_after"])
    total = joined.agg(F.sum("n_before").alias("b"), F.sum("n_after").alias("a"))
    pct = lambda n, t: F.round(F.coalesce(F.try_divide(F.col(n) * 100.0, F.col(t)), F.lit(0.0)), 2)
    return joined.crossJoin(F.broadcast(total)).select(column, "n_before", "n_after", pct("n_before", "b").alias("pct_before"), pct("n_after", "a").alias("pct_after"))


def batch_summary(predictions: DataFrame) -> DataFrame:
    """Average confidence, rows and distinct labels."""
    return predictions.agg(F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.count("*").alias("total"), F.countDistinct("cluster_label").alias("n_labels"))


#: Files in one row of ``batch_groups``.
GROUP_PAGE = 10_000


def batch_groups(predictions: DataFrame, page: int | None = None, whole: bool = False) -> DataFrame:
    """Count, files and rounded distances of each cluster, by file name; a cluster has a row for every ``page`` (``GROUP_PAGE``) of its files, numbered from 0.

    Rows are numbered over the whole table first (``ordering.numbered``), so a cluster with most of the files is neither sorted nor listed in one task.
    With ``whole`` the pages of a cluster are put one after the other into its only row, page 0; that row must fit into memory.
    """
    page = GROUP_PAGE if page is None else page
    own = predictions.select("cluster_id", "filename", F.round("distance_to_centroid", 4).alias("d"))
    placed = numbered(own, "cluster_id", "filename", "d")
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("count"), F.min("position").alias("first"))
    paged = placed.join(sizes, "cluster_id").withColumn("page", F.floor((F.col("position") - F.col("first")) / page).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("position", "filename", "d")))
    pages = paged.groupBy("cluster_id", "page").agg(F.first("count").alias("count"), rows.alias("rows")).select("cluster_id", "page", "count", F.col("rows.filename").alias("files"), F.col("rows.d").alias("distances"))
    if not whole:
        return pages
    lists = pages.groupBy("cluster_id").agg(F.first("count").alias("count"), F.array_sort(F.collect_list(F.struct("page", "files", "distances"))).alias("pages"))
    return lists.select("cluster_id", F.lit(0).alias("page"), "count", F.flatten("pages.files").alias("files"), F.flatten("pages.distances").alias("distances"))


def contingency(profiles: DataFrame) -> DataFrame:
    """One row for each cluster and label of the ``label_distribution`` maps."""
    return profiles.select("cluster_id", F.explode("label_distribution").alias("label", "n"))
