"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``); writing one fixes its rows and cuts lineage."""

from __future__ import annotations

import uuid

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


class Staging:
    """Parquet tables of one operation below a folder of its own; as a context manager it deletes them at the end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/skarn-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; without names, all of them."""
        for name in names or ("",):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
