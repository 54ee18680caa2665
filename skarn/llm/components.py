"""Distributed connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that a task holds at once.
HELD = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) that connect what the given edges connect."""
    names, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = number[: len(u)], number[len(u) :]
    least = np.arange(len(names))
    while True:
        a, b = least[x], least[y]
        if (a == b).all():
            away = np.flatnonzero(least != np.arange(len(names)))
            return names[away], names[least[away]]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        u, v = _stars(*[table.column(c).to_numpy() for c in ("u", "v")])
        return pa.RecordBatch.from_arrays([pa.array(x, table.schema.field("u").type) for x in (u, v)], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= HELD:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def connected_components(edges: DataFrame, scratch: Scratch, name: str, local: bool = True) -> DataFrame:
    """``node`` and ``component`` (the least node that can be reached) for every end of ``edges`` (``a``, ``b``; one type, no nulls).

    Alternates large-star and small-star steps: each node hands its larger neighbours, then its smaller ones, to its least
    neighbour, until all edges are stars.  With ``local`` edges are contracted to stars in their task (in numpy, at most ``HELD`` at
    once) before a shuffle, and stored edges in as few tasks as hold them; without, only DataFrame operations are used.  Every step reads and writes tables, so the joins are
    plain equi-joins of two tables which Spark may split at hot nodes, minima are combined before the shuffle, and lost
    executors repeat one step.  Nothing is collected but one row a round.
    """

    def save(df: DataFrame, step: str) -> DataFrame:
        return scratch.write(df, f"{name}_{step}")

    def near(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_contracted, df.schema) if local else df

    def stars(now: DataFrame) -> bool:
        """Whether every node is either the centre of its edges or has one edge."""
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        return ends.where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()

    def gathered(now: DataFrame, step: str) -> tuple[DataFrame, bool]:
        """Stored edges contracted ``HELD`` to a task; edges of one task are stars then."""
        n = -(-now.count() // HELD)
        return save(near(now.coalesce(max(1, n))), step), n <= 1

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    turn, used, done = 0, ["0"], False
    if local:
        now, done = gathered(save(near(now), "raw"), "0")
        scratch.drop(f"{name}_raw")
    else:
        now = save(now.distinct(), "0")
    while not (done or stars(now)):
        turn += 1
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = save(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), f"{turn}a")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = save(near(large).distinct(), f"{turn}b")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), f"{turn}c")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = save(near(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct(), f"{turn}d")
        if local:
            now, done = gathered(now, f"{turn}e")
        scratch.drop(*[f"{name}_{s}" for s in used])
        used = [f"{turn}{s}" for s in "abcde"]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
