"""Which rows are one document: those of one ``doc_id`` and one text.

``skarn_doc`` is the id, or ``NO_ID`` where there is none, so such rows come after all others.  ``skarn_sub`` tells the texts of one id
apart: a 64-bit hash of the text where an id has several texts or the row has none, else 0.  (doc, sub) orders all documents: by
id, then by hash.  An id of ``NO_ID`` counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

NO_ID = (1 << 63) - 1
#: Ids with several texts are broadcast up to this size; more of them are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

DOC, SUB = "skarn_doc", "skarn_sub"


def text_hash(text: Column | str = "text") -> Column:
    return F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``skarn_doc`` and, for every row, the hash of its text as ``skarn_sub``."""
    return docs.withColumn(DOC, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(SUB, text_hash())


def shared_ids(prints: DataFrame, scratch: Scratch, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """Ids with several texts in a table of (doc, hash) rows, or None where there are none; minima are combined before the shuffle."""
    several = prints.where(F.col(DOC) < NO_ID).groupBy(DOC).agg(F.min(SUB).alias("low"), F.max(SUB).alias("high")).where("low < high")
    several = scratch.write(several.select(DOC, F.lit(True).alias("skarn_several")), "shared")
    n = several.count()
    if not n:
        return None
    return F.broadcast(several) if 16 * n <= broadcast_bytes else several


def settled(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """``rows`` of ``keyed`` with ``skarn_sub`` set to 0 where the id alone names the document."""
    needed = F.col(DOC) == NO_ID
    if shared is None:
        return rows.withColumn(SUB, F.when(needed, F.col(SUB)).otherwise(F.lit(0).cast("long")))
    joined = rows.join(shared, DOC, "left")
    return joined.withColumn(SUB, F.when(needed | F.col("skarn_several"), F.col(SUB)).otherwise(F.lit(0).cast("long"))).drop("skarn_several")
