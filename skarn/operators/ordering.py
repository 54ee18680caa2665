"""Row order that survives: positions in written files, and dense numbers over a whole table.

A Parquet row has a fixed place, its file and its row in it (``_metadata``).  Where rows were loaded in files that are ordered by name, that
place is the load order; it doesn't depend on how a scan is split, coalesced or retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Staging

#: Files of an ordered table; their row counts are sent to the tasks up to this number, beyond it they are joined.
BROADCAST_FILES = 100_000
FILE, ROW = "skarn_file", "skarn_row_index"


def placed(table: DataFrame) -> DataFrame:
    """A scan of Parquet files with the file and the row number of each row."""
    return table.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def numbered(rows: DataFrame, *order: str, name: str = "position", staging: Staging | None = None) -> DataFrame:
    """``rows`` with a dense number from 0 in the order of ``order`` (ties: the order of ``rows`` as they were written here).

    1. ``rows`` are written once, which gives each a place that no retry or plan changes.
    2. They are dealt into ranges of (order, place) and written sorted: as the place is part of the key, a value that a third of all rows share is
       cut like any other.  A row's number is its row in its file and the rows of the files before.
    3. Files are counted from what is written (never from a second evaluation of the ranges), in the order of their first keys.

    The tables stay in ``staging``, as the result reads them.
    """
    staging = staging or Staging(rows.sparkSession, "numbered")
    fixed = placed(staging.write(rows, "fixed"))
    keys = [F.col(c) for c in order] + [F.col(FILE), F.col(ROW)]
    ranged = fixed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("skarn_key", F.struct(*keys))
    ordered = placed(staging.write(ranged.drop(FILE, ROW), "ordered"))
    files = ordered.groupBy(FILE).agg(F.count("*").alias("n"), F.min("skarn_key").alias("first"))
    files = staging.write(files, "files")
    staging.drop("fixed")
    count = files.count()
    before, offsets = 0, []
    for r in files.orderBy("first").select(FILE, "n").toLocalIterator():  # one row for each file
        offsets.append((r[FILE], before))
        before += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, f"{FILE} string, skarn_before long")
    joined = ordered.join(F.broadcast(table) if count <= BROADCAST_FILES else table, FILE)
    return joined.withColumn(name, F.col(ROW) + F.col("skarn_before")).select(*rows.columns, name)
