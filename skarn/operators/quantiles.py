"""Exact quantiles by selection: histograms that are refined around the wanted ranks.

An aggregate like ``percentile`` keeps all different values of a group in one buffer.  Here each wanted rank has an interval that holds it; a pass
counts the values of the interval in ``BINS`` bins (combined before the shuffle), and the bin that holds the rank is the next interval.  When
an interval has ``FEW`` values or fewer they are gathered and sorted, or it has one value only.  A task holds bins, never rows, and a
group with a third of all rows is counted like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import Staging

BINS, FEW = 1024, 16_384
#: Intervals are sent to the tasks up to this number of groups, beyond it they are joined.
BROADCAST_GROUPS = 10_000


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """A bin that never falls as ``v`` rises.

    An interval around zero or with an infinite end is cut by sign first; one of a single sign whose ends are far apart is cut by logarithm, so the number of
    passes does not depend on how values are spread.
    """
    infinite = F.lit(float("inf"))
    by_sign = F.when(v == -infinite, 0).when(v < 0, 1).when(v == 0, 2).when(v < infinite, 3).otherwise(4)
    share = lambda x, a, b: F.least(F.greatest(F.floor((x - a) / (b - a) * BINS), F.lit(0)), F.lit(BINS))
    up = share(F.log(v), F.log(lo), F.log(hi))
    down = BINS - share(F.log(-v), F.log(-hi), F.log(-lo))
    far = 1024.0
    cut = F.when(lo == hi, 0).when(((lo <= 0) & (hi >= 0)) | (hi == infinite) | (lo == -infinite), by_sign)
    return cut.when((lo > 0) & (hi / lo > far), up).when((hi < 0) & (lo / hi > far), down).otherwise(share(v, lo, hi)).cast("int")


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: str | None = None) -> DataFrame:
    """``q``: the quantiles ``shares`` of the numbers of ``column`` (linear interpolation), for each value of ``by`` (null is one) or for all rows.

    Nulls and NaN don't count; a group without numbers has no row, and no group gives no row.
    """
    staging = Staging(df.sparkSession, "quantiles")
    key = F.lit(0) if by is None else F.col(by)
    rows = df.select(key.alias("g"), F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = staging.write(rows, "values")
    groups = staging.write(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)) for q in shares])))
    state = groups.select("g", F.explode(ranks).alias("rank"), F.col("rank").alias("inner"), F.col("n").alias("left"), "lo", "hi")
    few_groups = groups.count() <= BROADCAST_GROUPS
    # the rows of a group meet its intervals; a row counts where it lies within one
    state, k = staging.write(state, "state-0"), 0

    def met(intervals: DataFrame) -> DataFrame:
        each = intervals.groupBy(F.col("g").alias("of")).agg(F.collect_list(F.struct("rank", "inner", "left", "lo", "hi")).alias("ts"))  # two for each share
        joined = rows.join(F.broadcast(each) if few_groups else each, F.col("g").eqNullSafe(F.col("of")))
        inside = F.filter("ts", lambda t: (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))
        return joined.select("g", "v", F.explode(inside).alias("t"))

    wide = (F.col("lo") < F.col("hi")) & (F.col("left") > FEW)
    while not state.where(wide).isEmpty():
        bins = met(state.where(wide)).groupBy("g", "t.rank", "t.inner", _bin(F.col("v"), F.col("t.lo"), F.col("t.hi")).alias("bin"))
        bins = bins.agg(F.count("*").alias("left"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("left").over(W.partitionBy("g", "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # the bins of one rank
        held = bins.withColumn("before", before).where("inner >= before AND inner < before + left")
        finer = held.select("g", "rank", (F.col("inner") - F.col("before")).alias("inner"), "left", "lo", "hi")
        k += 1
        state = staging.write(finer.unionByName(state.where(~wide)), f"state-{k}")
    open_ = (F.col("lo") < F.col("hi")).alias("open")
    gathered = met(state.where(open_)).groupBy("g", "t.rank", "t.inner").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # FEW values at most
    found = gathered.select("g", "rank", F.get("vs", F.col("inner").cast("int")).alias("v"))
    found = found.unionByName(state.where(~open_).select("g", "rank", F.col("lo").alias("v")))
    found = found.groupBy(F.col("g").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    whole = groups.join(found, F.col("g").eqNullSafe(F.col("of")))

    def value(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = (F.element_at("at", f(place)) for f in (F.floor, F.ceil))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise(low * (F.ceil(place) - place) + high * (place - F.floor(place)))

    result = staging.write(whole.select("g", F.array(*[value(q) for q in shares]).alias("q")), "result")
    staging.drop("values", "groups", *[f"state-{i}" for i in range(k + 1)])
    return result.select("q") if by is None else result.select(F.col("g").alias(by), "q")
