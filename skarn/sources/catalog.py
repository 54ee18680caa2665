"""Stage tables, object folders, API fixtures and run results."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.images import pixel_bytes
from .tables import Table

#: Stages and the tables behind them.
STAGES = ("raw", "clean", "integrated", "transformed", "features", "clusters")
TABLES = {"raw": "images_raw", "clean": "images_clean", "integrated": "images_integrated", "transformed": "images_transformed", "features": "image_features", "clusters": "clusters"}
RUN_TABLES = ("processing_results", "cluster_assignments", "cluster_profiles", "k_search_metadata", "sampling_metadata")
IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,gif,JPG,JPEG,PNG,BMP,GIF}"


@dataclass(frozen=True)
class Config:
    """Settings; ``from_env`` reads the ones that the environment names."""

    root: str = "warehouse"
    bucket: str = "images"
    endpoint: str = "localhost:9000"
    keywords: tuple[str, ...] = field(default=("mountain", "forest", "sea", "desert", "snow"))

    @classmethod
    def from_env(cls, prefix: str = "SKARN_") -> Config:
        found = {k: os.environ[f"{prefix}{k.upper()}"] for k in ("root", "bucket", "endpoint") if f"{prefix}{k.upper()}" in os.environ}
        words = os.environ.get(f"{prefix}KEYWORDS")
        return cls(**found, **({"keywords": tuple(w.strip() for w in words.split(",") if w.strip())} if words else {}))


def feature_rows(rows: DataFrame, vector: str) -> DataFrame:
    """filename, label (``unknown`` for null), object_name and vector."""
    return rows.select("filename", F.coalesce("label", F.lit("unknown")).alias("label"), "object_name", vector)


class Store:
    """Parquet tables below one folder; ``tables`` names others than ``TABLES`` for some stages."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), TABLES | (tables or {})

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage_path(self, stage: str) -> str:
        if stage not in self.tables:
            raise ValueError(f"unknown stage: {stage}")
        return self.path(self.tables[stage])

    def exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> Table:
        return Table(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        """The newest version of a table, or a plain folder or file of Parquet."""
        return self.table(name).read()

    def stage(self, stage: str) -> DataFrame:
        """Full scan of a stage."""
        self.stage_path(stage)
        return self.read(self.tables[stage])

    def find(self, stage: str, condition: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Filtered and projected scan; both reach the Parquet reader."""
        df = self.stage(stage)
        df = df.where(condition) if condition else df
        return df.select(*columns) if columns else df

    def count(self, stage: str, condition: str | None = None) -> int:
        return self.find(stage, condition).count()

    def counts(self, stage: str, **conditions: str | None) -> DataFrame:
        """One row with the number of rows that meet each condition (None: all), in one scan."""
        return self.stage(stage).agg(*[(F.count("*") if c is None else F.count_if(F.expr(c))).alias(n) for n, c in conditions.items()])

    def count_by(self, stage: str, column: str) -> DataFrame:
        return self.stage(stage).groupBy(column).agg(F.count("*").alias("count"))

    def count_by_source(self, stage: str = "raw") -> DataFrame:
        return self.count_by(stage, "source")

    def count_by_keyword(self, stage: str = "raw") -> DataFrame:
        return self.count_by(stage, "keyword")

    def features(self, table: str = "clip_features", vector: str = "clip_vector") -> DataFrame:
        """filename, label (``unknown`` for null), object_name and vector; an empty table raises."""
        df = feature_rows(self.read(table), vector)
        if df.isEmpty():
            raise ValueError(f"{table} is empty")
        return df

    def run(self, run_id: str) -> dict[str, DataFrame]:
        """The tables of one run; the two optional ones only if they exist."""
        return {t: self.read(t).where(F.col("run_id") == run_id) for t in RUN_TABLES if t in RUN_TABLES[:3] or self.exists(t)}

    def latest_run(self) -> str | None:
        row = self.read("processing_results").orderBy(F.desc("timestamp")).select("run_id").first()
        return row.run_id if row else None

    def run_by_prefix(self, prefix: str) -> str | None:
        """The latest run whose id starts with ``prefix``, else the latest of all."""
        results = self.read("processing_results")
        row = results.orderBy(F.desc(F.col("run_id").startswith(prefix)), F.desc("timestamp")).select("run_id").first()
        return row.run_id if row else None

    def model(self, model_id: str):
        """A saved ``PipelineModel``; FileNotFoundError if there is none."""
        from pyspark.ml import PipelineModel

        name = f"models/{model_id[:8]}"
        if not self.exists(name):
            raise FileNotFoundError(self.path(name))
        return PipelineModel.load(self.path(name))


def objects(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Keys below ``folder`` that start with ``prefix``, and their sizes; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    base = folder.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    key = F.substring_index("path", base, -1)
    return files.select(key.alias("key"), "length").where(F.col("key").startswith(prefix))


def object_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of every object."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


def contents(spark: SparkSession, folder: str, wanted: DataFrame | None = None, few: int = 10_000) -> DataFrame:
    """``key`` (below ``folder``) and ``content`` of images, as pixels that Spark's image reader decodes (PNG, JPEG, BMP, GIF).

    ``wanted`` (``key``) are the images that are needed: up to ``few`` of them only their files are read, more are joined to a scan of the folder.
    Bytes that are no image stay as they are.
    """
    base = folder.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    key = lambda path: F.substring_index(path, base, -1)
    at = folder
    if wanted is not None:
        names = objects(spark, folder).select("key").join(wanted.select("key").distinct(), "key", "left_semi").limit(few + 1).collect()
        if not names:
            return spark.createDataFrame([], "key string, content binary")
        if len(names) <= few:
            at = [f"{folder.rstrip('/')}/{r.key}" for r in names]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select(key(F.col("path")).alias("key"), "content")
    seen = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(at)
    seen = seen.select(key(F.col("image.origin")).alias("key"), pixel_bytes(F.col("image")).alias("content"))
    if wanted is not None:
        raw, seen = (x.join(wanted.select("key").distinct(), "key", "left_semi") for x in (raw, seen))
    broken = raw.select("key").join(seen.select("key"), "key", "left_anti")  # names only; their bytes are read after that
    return seen.unionByName(raw.join(broken, "key", "left_semi"))


def images(spark: SparkSession, folder: str, valid_only: bool = True) -> DataFrame:
    """Decoded images; corrupt files are left out, or have a width of -1."""
    return spark.read.format("image").option("dropInvalid", valid_only).load(folder).select("image.*")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files directly in a folder, by extension in lower or upper case, each once."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(folder).select("path", "length", "content").dropDuplicates(["path"])


class PagesReader(DataSourceReader):
    """One partition for each page file."""

    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns = options["path"], columns

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pfs

        system, path = pfs.FileSystem.from_uri(self.folder)
        files = sorted(f.path for f in system.get_file_info(pfs.FileSelector(path)) if PurePosixPath(f.path).suffix == ".json")
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        import json

        import pyarrow.fs as pfs

        if partition.value is None:
            return
        system, _ = pfs.FileSystem.from_uri(self.folder)
        with system.open_input_file(partition.value) as f:
            page = json.loads(f.readall())
        for photo in page.get("photos") or page.get("results") or []:
            yield (int(page.get("page", 0)), str(photo.get("id")), json.dumps(photo))


class PhotoPages(DataSource):
    """``photo_pages``: a folder of saved REST pages (``page``, ``photos`` or ``results``), for API sources without a network."""

    @classmethod
    def name(cls) -> str:
        return "photo_pages"

    def schema(self) -> str:
        return "page int, photo_id string, payload string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options), schema.names)
