"""Writers: insert if absent, upsert, delete, objects, run results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Store


def absent(new: DataFrame, old: DataFrame | None, *keys: str) -> DataFrame:
    """One row of each key of ``new`` that ``old`` does not have: of several rows with one key the one of least hash, so a retry inserts the same.

    Rows are combined before the shuffle, and null keys count as equal among themselves (``old`` never has them).
    """
    others = [c for c in new.columns if c not in keys]
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in new.schema if f.name in others and "map<" not in f.dataType.simpleString()], F.lit(0))
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*others), hashed).alias("skarn_row")) if others else new.distinct()
    new = one.select(*[F.col(f"`{c}`") if c in keys else F.col("skarn_row").getField(c).alias(c) for c in new.columns])
    return new if old is None else new.join(old.select(*keys), list(keys), "left_anti")


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with its rows replaced or extended by ``new``."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_if_absent(store: Store, name: str, new: DataFrame, *keys: str) -> None:
    """Appends rows with new keys; rows with known keys are dropped without an error.  Two writers never insert one key twice."""
    store.table(name).insert_if_absent(new, lambda rows, old: absent(rows, old, *keys))


def append(store: Store, name: str, rows: DataFrame, *partition_by: str) -> None:
    store.table(name).append(rows, *partition_by)


def upsert(store: Store, name: str, new: DataFrame, *keys: str) -> None:
    store.table(name).upsert(new, *keys)


def remaining(table: DataFrame, condition: str) -> DataFrame:
    """Rows that a deletion leaves: those that don't meet the condition, also where it is null."""
    return table.where(~F.coalesce(F.expr(condition), F.lit(False)))


#: Keys by which tables are searched.
INDEXES = {"images_raw": ("url", "source"), "images_clean": ("filename",), "images_integrated": ("filename",), "images_transformed": ("filename",), "image_features": ("object_name",), "clip_features": ("object_name",)}


def create_indexes(store: Store, names: dict[str, tuple[str, ...]] | None = None) -> None:
    """Clusters the tables that exist by their keys; tables that have the index already stay as they are."""
    for name, keys in (INDEXES if names is None else names).items():
        table = store.table(name)
        at = table.snapshot()
        if table.exists() and (at is None or at.index != keys):
            table.cluster(*keys)


def delete(store: Store, name: str, condition: str) -> None:
    """Removes rows that meet the condition; rows where it is null stay."""
    store.table(name).delete(condition)


def put_objects(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` to ``folder``/``key`` from the tasks; ``key`` and ``ok`` for each row.  A retry writes the same bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs

        system, root = pfs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    path = f"{root}/{key}"
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(path) as out:
                        out.write(content)
                    done.append(True)
                except (OSError, TypeError):
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(done)], ["key", "ok"])

    return rows.select("key", "content").mapInArrow(run, "key string, ok boolean")


def object_url(endpoint: str, bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"http://{endpoint}/{bucket}/"), key)


def text_keys(counts: Column) -> Column:
    """A map with its keys as strings."""
    return F.transform_keys(counts, lambda k, _: k.cast("string"))


def save_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_run(store: Store, run_id: str, result: DataFrame, assignments: DataFrame, profiles: DataFrame, sampling: DataFrame | None = None, k_search: DataFrame | None = None) -> None:
    """The tables of a run, partitioned by run id."""
    tables = {"processing_results": result, "cluster_assignments": assignments, "cluster_profiles": profiles, "sampling_metadata": sampling, "k_search_metadata": k_search}
    for name, df in tables.items():
        if df is not None:
            append(store, name, df.withColumn("run_id", F.lit(run_id)), "run_id")


def save_model(store: Store, run_id: str, model) -> str:
    """Saves a ``PipelineModel`` under the first eight characters of the run id."""
    path = store.path(f"models/{run_id[:8]}")
    model.write().overwrite().save(path)
    return path


def native(value):
    """numpy values, also inside containers, as plain Python; map keys become strings."""
    import numpy as np

    if isinstance(value, dict):
        return {str(k): native(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [native(v) for v in value]
    if isinstance(value, np.ndarray):
        return native(value.tolist())
    return value.item() if isinstance(value, np.generic) else value


def report_json(value) -> str:
    return json.dumps(native(value), sort_keys=True)
