"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder (tests, local mode).
LOCAL_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode a folder is set where there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_FOLDER
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders made inside the innermost ``cleared`` block of this thread; outside of one nothing is noted.
_MADE: ContextVar[list[Scratch] | None] = ContextVar("made", default=None)


class Scratch:
    """Named Parquet tables of one run.  Written tables cut lineage: losing an executor re-reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/skarn-{label}-{uuid.uuid4().hex}"
        made = _MADE.get()
        if made is not None:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names or ("",):
            at = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes what operators called inside wrote, at the end of the block; their results must have been written by then.

    Blocks and threads know only their own folders.
    """
    made: list[Scratch] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for s in reversed(made):
            s.drop()
