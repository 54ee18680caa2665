"""A bounded training sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """One row in five, by CRC-32 of the id as text; null counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` (0 or 1): at most ``per_class`` rows of each class that are not held out, by hash order.

    Labels are ranked without texts (two small top-n reads), and only the chosen ids, ``2 * per_class`` at most, are broadcast.
    Rows with several different labels are left out; of several texts of one id the one of least hash counts, so a retry trains the same model.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most").drop("most")
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = [(r.doc_id, int(r.label)) for p in parts for r in p.collect()]
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))
