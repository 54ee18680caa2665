"""Connected components of an edge table, by contraction: every round joins all vertices of a tree of least neighbours into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Staging


def _rooted(parents: DataFrame, staging: Staging, label: str) -> DataFrame:
    """``v`` and the root of its tree; each pass doubles the length of the paths that are followed."""
    now, k = staging.write(parents, f"{label}-0"), 0
    while True:
        up = now.select(F.col("v").alias("p"), F.col("p").alias("next"))
        moved = now.join(up, "p", "left").select("v", F.coalesce("next", "p").alias("p"), (F.coalesce("next", "p") != F.col("p")).alias("moved"))
        k += 1
        far = staging.write(moved, f"{label}-{k}")
        staging.drop(f"{label}-{k - 1}")
        now = far.select("v", "p")
        if far.where("moved").isEmpty():
            return now


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``v`` and ``component`` (the least vertex of its component) for every vertex of ``edges`` (longs ``a``, ``b``).

    Vertices point to their least neighbour, if it is less than they are; the trees of these pointers are contracted and edges between trees are the next
    round's.  A component of n vertices takes O(log n) rounds, as at most one vertex in two is less than all its neighbours.  Minima
    combine before the shuffle; a vertex with many edges meets one row in a join, which Spark can split.
    """
    left = staging.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    found, k = None, 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        roots = _rooted(parents, staging, f"roots-{k}")
        if found is None:
            found = roots
        else:
            found = found.join(roots.select(F.col("v").alias("p"), F.col("p").alias("top")), "p", "left").select("v", F.coalesce("top", "p").alias("p"))
        found = staging.write(found, f"found-{k}")
        of = lambda c: roots.select(F.col("v").alias(c), F.col("p").alias(f"{c}_root"))  # noqa: B023, E731
        next_ = left.join(of("a"), "a").join(of("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).where("a <> b").distinct()
        k += 1
        left = staging.write(next_, f"edges-{k}")
        staging.drop(f"edges-{k - 1}", *([f"found-{k - 2}"] if k > 1 else []))
    if found is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return found.select("v", F.col("p").alias("component"))
