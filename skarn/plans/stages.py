"""The preprocessing chain, the clustering run and inference, each a function over tables.

Every stage is a lazy DataFrame expression; only its writer is an action, and reruns add what is missing.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import inspector, transformer
from ..functions.scalar import grade
from ..operators import clustering, metrics, sampling
from ..operators.cleaning import OUTCOMES, cleaning_fold, not_yet, outcome
from ..operators.embedding import embedder, encoded, over_tensors
from ..operators.integration import expand_variants, features_of, integrate
from ..sources.catalog import Store, contents, objects
from ..sources.sinks import insert_if_absent, put_objects, save_model, save_run, upsert
from ..sources.staging import Staging

TIME = "yyyy-MM-dd HH:mm:ss"


def now() -> Column:
    return F.date_format(F.current_timestamp(), TIME)


def _table(store: Store, stage: str) -> DataFrame | None:
    return store.stage(stage) if store.exists(store.stage_path(stage).removeprefix(store.root + "/")) else None


def _contents(store: Store, folder: str, wanted: DataFrame) -> DataFrame:
    """``object_name`` and image ``content`` of the objects in ``wanted`` (``object_name``); other objects are not read."""
    names = wanted.select(F.substring_index("object_name", f"{folder}/", -1).alias("key"))
    return contents(store.spark, store.path(folder), names).select(F.concat(F.lit(f"{folder}/"), "key").alias("object_name"), "content")


def run_cleaning(store: Store) -> dict[str, int]:
    """Cleans new raw rows.  Images are decoded only for rows whose URL passes; accepted rows of earlier runs seed the state."""
    raw, done = store.stage("raw"), _table(store, "clean")
    new = raw if done is None else not_yet(raw, store.table("images_clean").candidates(raw), "filename")
    wanted = new.where("url IS NOT NULL AND url <> ''").select("filename", "object_name")
    images = _contents(store, "raw/images", wanted).withColumnRenamed("content", "bytes")
    seen = wanted.join(images, "object_name").select("filename", inspector()(F.col("bytes")).alias("i")).select("filename", F.lit(True).alias("downloaded"), F.col("i.width").alias("w"), F.col("i.height").alias("h"), F.col("i.gray_std").alias("gray_std"), F.col("i.phash").alias("phash"))
    facts = new.drop("phash", "gray_std", "downloaded").join(seen, "filename", "left").withColumn("downloaded", F.coalesce("downloaded", F.lit(False))).withColumn("width", F.col("w")).withColumn("height", F.col("h")).drop("w", "h")
    prior = None
    if done is not None:
        prior = done.where("cleaned").select("filename", "url", F.lit(True).alias("downloaded"), "width", "height", F.lit(None).cast("double").alias("gray_std"), "phash", "crawled_at")
    cleaned = cleaning_fold(facts, prior)
    kept = F.when(F.col("cleaned") | F.col("reject_reason").startswith("duplicate_phash"), F.col("phash")).otherwise("")
    cleaned = cleaned.withColumn("phash", F.coalesce(kept, F.lit(""))).withColumn("cleaned_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd")).drop("gray_std", "downloaded")
    before = done.groupBy(outcome(F.col("reject_reason")).alias("o")).count().collect() if done is not None else []
    insert_if_absent(store, "images_clean", cleaned, "filename")
    after = {r.o: r["count"] for r in store.stage("clean").groupBy(outcome(F.col("reject_reason")).alias("o")).count().collect()}
    old = {r.o: r["count"] for r in before}
    return {o: after.get(o, 0) - old.get(o, 0) for o in OUTCOMES}


def run_integration(store: Store) -> dict[str, int]:
    """Upserts accepted rows that exist in the store."""
    clean = store.stage("clean").where("cleaned")
    names = objects(store.spark, store.path("raw/images")).select(F.concat(F.lit("raw/images/"), "key").alias("path"))
    found = integrate(clean, names, now())
    n, ok = clean.count(), found.count()
    upsert(store, "images_integrated", found, "filename")
    return {"ok": ok, "no_file": n - ok}


def run_transformation(store: Store, per_image: int = 1, side: int = 640) -> dict[str, int]:
    """Standard and augmented images; each missing (filename, aug_index) is made, also after a failure."""
    rows = expand_variants(store.stage("integrated").withColumnRenamed("object_name", "raw_name"), per_image)
    done = _table(store, "transformed")
    total = rows.count()
    keyed = rows.withColumn("variant", F.coalesce("aug_index", F.lit(0)))
    if done is not None:
        keyed = not_yet(keyed, done.withColumn("variant", F.coalesce("aug_index", F.lit(0))), "filename", "variant")
    images = _contents(store, "raw/images", keyed.select(F.col("raw_name").alias("object_name"))).withColumnRenamed("object_name", "raw_name")
    made = keyed.join(images, "raw_name").withColumn("t", transformer(side=side)("content", "filename", "aug_index")).where("t.png IS NOT NULL")
    made = made.select("filename", "label", "object_name", F.col("width").alias("width_raw"), F.col("height").alias("height_raw"), F.lit(side).alias("width"), F.lit(side).alias("height"), F.lit("PNG").alias("format"), "is_augmented", "aug_index", F.lit(True).alias("transformed"), now().alias("transformed_at"), "t.*")
    with Staging(store.spark, "transformed") as staging:
        made = staging.write(made, "made")  # images are made once
        sent = put_objects(made.select(F.col("object_name").alias("key"), F.col("png").alias("content")), store.root)
        good = sent.where("ok").select(F.col("key").alias("object_name"))
        insert_if_absent(store, "images_transformed", made.drop("png").join(good, "object_name").withColumn("variant", F.coalesce("aug_index", F.lit(0))), "filename", "variant")
    n = store.stage("transformed").where("NOT is_augmented").count()
    m = store.stage("transformed").where("is_augmented").count()
    return {"ok": n, "aug": m, "error": total - n - m, "skip": 0 if done is None else done.count()}


def run_encoding(store: Store, embed: Callable[[Column], Column], name: str = "resnet") -> dict[str, int]:
    """Vectors of transformed images that have none; ``clip`` takes standard images only."""
    table = "image_features" if name == "resnet" else "clip_features"
    rows = store.stage("transformed")
    rows = rows.where("NOT is_augmented") if name == "clip" else rows
    old = store.read(table) if store.exists(table) else None
    new = rows if old is None else not_yet(rows, old, "object_name")
    n, skipped = new.count(), (0 if old is None else old.count())
    columns = ["filename", "label", "object_name", "is_augmented", "aug_index", "width", "height", "content"]
    made = encoded(new.join(_contents(store, "preprocessed/images", new), "object_name").select(*columns), embed, name)
    stamp = {"encoded_at": now(), "encoded": F.lit(True)} if name == "resnet" else {"extracted_at": now()}
    insert_if_absent(store, table, made.withColumns(stamp), "object_name")
    ok = store.read(table).count() - skipped
    return {"ok": ok, "error": n - ok, "skipped": skipped}


def cluster_run(store: Store, k: int | None = None, pca: int = clustering.PCA_COMPONENTS, sample_size: int | None = None, strategy: str = "stratified", fix: bool = True, restarts: int = clustering.RESTARTS, ks=clustering.K_RANGE) -> dict:
    """Load, sample, standardise, project, (search k,) cluster, repair, score, profile and save; returns the main figures."""
    run_id = str(uuid.uuid4())
    full = store.features().select(F.col("filename").alias("key"), "label", F.col("clip_vector").alias("vector"))
    chosen = sampling.random_sample(full, "key", sample_size) if strategy == "random" else sampling.stratified(full, "key", "label", sample_size)
    model = clustering.pca_pipeline(chosen, pca)
    points = clustering.projected(chosen, model).persist()
    search = None
    if k is None:
        search = clustering.k_search(points, ks, restarts).persist()
        k = metrics.recommended_k(search).first().k
    fitted = clustering.kmeans(points, k, restarts)
    found = clustering.assigned(points, fitted).persist()
    before = metrics.bundle(found).first()
    final = metrics.contamination_fix(found).drop("cluster_id").withColumnRenamed("new_cluster_id", "cluster_id").persist() if fix else found
    after = metrics.bundle(final).first()
    info = points.sparkSession.createDataFrame(
        [(str(run_id), final.count(), k, len(model.stages[-1].explainedVariance), clustering.explained(model), before.purity, after.purity, after.silhouette, after.calinski_harabasz, after.davies_bouldin, fix, sample_size is not None, "completed")],
        "id string, n_samples long, n_clusters int, pca_n_components int, variance_explained double, purity_before double, purity double, silhouette double, calinski_harabasz double, davies_bouldin double, post_processing_applied boolean, sampling_applied boolean, status string",
    ).drop("id").withColumn("timestamp", now()).withColumn("grade", grade(F.col("purity")))
    assignments = final.select(F.col("key").alias("filename"), "cluster_id", F.col("label").alias("true_label"))
    meta = sampling.metadata(full, chosen, "label", sample_size, strategy).withColumn("timestamp", now())
    record = None
    if search is not None:
        record = search.agg(F.array_sort(F.collect_list(F.struct(*search.columns))).alias("results")).withColumn("recommendation", F.struct(F.lit(k).alias("k"))).withColumn("timestamp", now())
    save_run(store, run_id, info, assignments, metrics.profiles(final), meta, record)
    save_model(store, run_id, model)
    clustering.centres_of(fitted, store.spark).write.mode("overwrite").parquet(store.path(f"models/{run_id[:8]}-centres"))
    return {"run_id": run_id, "k": k, "purity_before": before.purity, "purity": after.purity, "silhouette": after.silhouette}


def predict(store: Store, model_id: str, rows: DataFrame) -> DataFrame:
    """Prediction records of new vectors (``filename``, ``vector``) with a saved model."""
    model = store.model(model_id)
    centres = store.read(f"models/{model_id[:8]}-centres")
    run_id = store.run_by_prefix(model_id)
    names = store.read("cluster_profiles").where(F.col("run_id") == run_id).select("cluster_id", F.col("dominant_label").alias("cluster_label"))
    return metrics.predictions(clustering.projected(rows, model), centres, names)


def predict_images(store: Store, model_id: str, folder: str, embed: Callable[[Column], Column], names: list[str] | None = None) -> DataFrame:
    """Prediction records of the images in a folder (or only of ``names``); images that can't be decoded have none."""
    wanted = None if names is None else store.spark.createDataFrame([(n,) for n in names], "key string")
    files = contents(store.spark, folder, wanted).where(F.lower("key").rlike(r"\.(jpe?g|png|bmp|gif)$"))
    rows = files.select(F.col("key").alias("filename"), "content", F.lit(False).alias("is_augmented"))
    vectors = encoded(rows, embed, "clip").select("filename", F.col("clip_vector").alias("vector"))
    return predict(store, model_id, vectors)


#: Points and components of the silhouettes of an evaluation.
SILHOUETTE_SAMPLE, SILHOUETTE_COMPONENTS = 3000, 64


def evaluation(store: Store, run_id: str | None = None, gallery: bool = True, scatter: bool = True, silhouettes: bool = True) -> dict[str, DataFrame]:
    """The tables behind the evaluation charts of a run (the latest by default).  The confusion matrix has a row for each cluster and label that meet, however many there are."""
    from ..operators.aggregates import contingency

    run_id = run_id or store.latest_run()
    if run_id is None:
        raise ValueError("there is no run")
    tables = store.run(run_id)
    counts = tables["cluster_assignments"].groupBy("cluster_id", "true_label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("cluster_id").agg(F.sum("n").alias("size"))
    shares = counts.join(sizes, "cluster_id").select("cluster_id", "true_label", F.round(F.col("n") / F.col("size"), 4).alias("share"))
    out = {"results": tables["processing_results"].withColumn("evaluation_grade", grade(F.col("purity"), 0.8, 0.7)), "profiles": tables["cluster_profiles"].orderBy("cluster_id"), "confusion": counts, "confusion_normalised": shares, "contingency": contingency(tables["cluster_profiles"])}
    if gallery:  # the sample images of each cluster
        out["gallery"] = tables["cluster_profiles"].select("cluster_id", "dominant_label", F.explode("sample_filenames").alias("filename"))
    if scatter and store.exists("clip_features"):  # two components of a sample of the run's vectors
        vectors = features_of(tables["cluster_assignments"].select("filename", "cluster_id", "true_label"), store.features())
        out["scatter"] = clustering.pca_2d(vectors.select(F.col("filename").alias("key"), F.col("clip_vector").alias("vector"), "cluster_id", "true_label"))
    if silhouettes and store.exists("clip_features"):  # sorted silhouettes of each cluster, over 64 components of a sample
        vectors = features_of(tables["cluster_assignments"].select("filename", "cluster_id"), store.features())
        some = sampling.random_sample(vectors.select(F.col("filename").alias("key"), F.col("clip_vector").alias("vector"), "cluster_id"), "key", SILHOUETTE_SAMPLE)
        flat = clustering.projected(some, clustering.pca_pipeline(some, SILHOUETTE_COMPONENTS))
        out["silhouettes"] = metrics.silhouette_groups(metrics.silhouettes(flat, sample=None))
    if "k_search_metadata" in tables:
        out["k_curve"] = metrics.k_curve(tables["k_search_metadata"])
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skarn")
    p.add_argument("--root", default="warehouse")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("clean", "integrate", "transform"):
        sub.add_parser(name)
    c = sub.add_parser("cluster")
    c.add_argument("--find-k", action="store_true")
    c.add_argument("--k", type=int)
    c.add_argument("--pca", type=int, default=clustering.PCA_COMPONENTS)
    c.add_argument("--sample-size", type=int)
    c.add_argument("--sample-strategy", choices=("random", "stratified"), default="stratified")
    c.add_argument("--no-post-process", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("--run-id")
    e.add_argument("--latest", action="store_true")
    e.add_argument("--no-gallery", action="store_true")
    e.add_argument("--no-scatter", action="store_true")
    e.add_argument("--out-dir")
    n = sub.add_parser("encode")
    n.add_argument("--name", choices=("resnet", "clip"), default="clip")
    n.add_argument("--side", type=int, help="give the model normalised tensors of this side instead of encoded images")
    d = sub.add_parser("predict")
    d.add_argument("--model-id", required=True)
    d.add_argument("--image-dir")
    d.add_argument("--image-file")
    d.add_argument("--out-dir")
    for q in (n, d):
        q.add_argument("--embedder", required=True, help="module:function that gives the model, as for embedding.embedder")
    return p


def _model(name: str, side: int | None = None) -> Callable[[Column], Column]:
    module, _, function = name.partition(":")
    make = getattr(importlib.import_module(module), function)
    return embedder(make if side is None else over_tensors(make, side))


def main(args: list[str] | None = None) -> int:
    """Command line; 0 on success, 1 on an error."""
    a = parser().parse_args(args)
    store = Store(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.root)
    try:
        if a.command == "cluster":
            print(cluster_run(store, None if a.find_k else a.k, a.pca, a.sample_size, a.sample_strategy, not a.no_post_process))
        elif a.command == "evaluate":
            if a.run_id and a.latest:
                raise ValueError("--run-id and --latest exclude each other")
            for name, df in evaluation(store, a.run_id, not a.no_gallery, not a.no_scatter).items():
                df.write.mode("overwrite").json(f"{a.out_dir or store.path('evaluation')}/{name}")
        elif a.command == "encode":
            print(run_encoding(store, _model(a.embedder, a.side), a.name))
        elif a.command == "predict":
            if bool(a.image_dir) == bool(a.image_file):
                raise ValueError("give --image-dir or --image-file")
            folder, _, name = (a.image_file or "").rpartition("/")
            found = predict_images(store, a.model_id, a.image_dir or folder or ".", _model(a.embedder), [name] if a.image_file else None)
            found.write.mode("overwrite").json(a.out_dir or store.path("predictions"))
        else:
            print({"clean": run_cleaning, "integrate": run_integration, "transform": run_transformation}[a.command](store))
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
