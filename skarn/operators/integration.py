"""Integration: unified metadata, existence in the store, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normal_label, stem, to_int
from .ordering import numbered


def object_name(filename: Column, prefix: str = "raw/images/") -> Column:
    return F.concat(F.lit(prefix), filename)


def normal_meta(clean: DataFrame) -> DataFrame:
    """filename, object_name (default: its place in the raw folder), label, width and height."""
    have = lambda n: (F.col(n) if n in clean.columns else F.lit(None)).cast("string")
    return clean.select(
        "filename",
        F.coalesce(have("object_name"), object_name(F.col("filename"))).alias("object_name"),
        normal_label(have("label"), have("keyword")).alias("label"),
        to_int(have("width"), have("width_raw"), have("w")).alias("width"),
        to_int(have("height"), have("height_raw"), have("h")).alias("height"),
    )


def stored(rows: DataFrame, objects: DataFrame, prefix: str = "raw/images/") -> DataFrame:
    """Rows whose ``object_name`` or default place is a ``path`` of ``objects``.

    An OR between two keys would be a nested loop; here each row is posted under both keys and one equi-join decides.
    """
    keyed = rows.select("filename", F.explode(F.array_distinct(F.array("object_name", object_name(F.col("filename"), prefix)))).alias("path")).where("path IS NOT NULL")
    found = keyed.join(objects.select("path"), "path", "left_semi").select("filename").distinct()
    return rows.join(found, "filename", "left_semi")


def integrate(clean: DataFrame, objects: DataFrame, when: Column) -> DataFrame:
    """Accepted rows that exist in the store, in the integrated schema."""
    accepted = clean.where(F.col("cleaned"))
    return stored(normal_meta(accepted), objects).withColumn("integrated", F.lit(True)).withColumn("integrated_at", when)


def with_source(integrated: DataFrame, clean: DataFrame) -> DataFrame:
    """Left join of the source and raw keyword that integration drops."""
    return integrated.join(clean.select("filename", "source", F.col("keyword").alias("keyword_raw")), "filename", "left")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left lookup of ``value`` by ``key``; a miss gives ``default``."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in ``order``."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("row"))
    return best.select(key, "row.*")


def features_of(assignments: DataFrame, features: DataFrame, vector: str = "clip_vector", order: str = "object_name") -> DataFrame:
    """Inner join of assignments and vectors by filename: rows without a vector go, the last of equal names counts."""
    full = last_of_each(features.where(F.size(vector) > 0).select("filename", vector, order), "filename", order)
    return assignments.join(full.drop(order), "filename")


def expand_variants(rows: DataFrame, per_image: int, folder: str = "preprocessed/images") -> DataFrame:
    """Each row as a standard image (null ``aug_index``) and ``per_image`` variants, with file and object names."""
    many = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_image)))).withColumn("aug_index", F.when(F.col("k") > 0, F.col("k")))
    name = F.concat(stem(F.col("filename")), F.when(F.col("k") > 0, F.concat(F.lit("_aug"), F.col("k").cast("string"))).otherwise(""), F.lit(".png"))
    named = many.withColumn("is_augmented", F.col("k") > 0).withColumn("object_file", name)
    return named.withColumn("object_name", F.concat_ws("/", F.lit(folder), "label", "object_file")).drop("k")


def letterbox_size(width: Column, height: Column, side: int = 640) -> Column:
    """Struct of the scaled size and the padding on the left and top."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    w = F.greatest(F.lit(1), F.round(width * scale).cast("int"))
    h = F.greatest(F.lit(1), F.round(height * scale).cast("int"))
    return F.struct(w.alias("w"), h.alias("h"), F.floor((side - w) / 2).cast("int").alias("left"), F.floor((side - h) / 2).cast("int").alias("top"))


def union_sources(*tables: DataFrame) -> DataFrame:
    """Union of sources with drifting schemas; absent columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def last_name(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """``last``: the latest name that fits a pattern.  Numbers are padded, so of two names the longer is later, and of equally long ones the larger."""
    return rows.where(F.col(column).rlike(pattern)).agg(F.max_by(column, F.struct(F.length(column), F.col(column))).alias("last"))


def next_ids(new: DataFrame, stored_ids: DataFrame, column: str, *order: str) -> DataFrame:
    """``new`` with ``id``: numbers after the largest stored one, in the order of ``order``.

    Ids are dense and unique for any plan, number of partitions and number of rows with equal keys (see ``ordering.numbered``); an empty
    store starts at 1.  An id of ``new`` itself is replaced.
    """
    start = stored_ids.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("start")).first()[0]
    place = numbered(new.drop("id") if "id" not in order else new, *order, name="skarn_position")
    return place.withColumn("id", F.col("skarn_position") + F.lit(start + 1)).drop("skarn_position")


def json_photos(payload: Column, schema: str) -> Column:
    """Array of photo structs of an API payload."""
    return F.from_json(payload, schema)
