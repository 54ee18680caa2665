import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions.images import IMAGENET_MEAN, IMAGENET_STD, decode, decode_png, encode_png
from skarn.operators.embedding import block_colours, embedder, encoded, over_tensors
from skarn.plans import stages
from skarn.sources.catalog import Config, PhotoPages, Store, contents, image_files, images, objects
from skarn.sources.sinks import delete, insert_if_absent, native, upsert
from skarn.streaming.cleaning import clean_stream, clean_stream_by_base
from tests.test_functions import picture
from tests.test_operators import SCHEMA, rows_of, sequential


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def filled(store, n=8):
    folder = store.root + "/raw/images"
    import os

    os.makedirs(folder)
    rows = []
    for i in range(n):
        name = f"pexels_{i:06d}.jpg"
        image = np.full((240, 260, 3), 50, np.uint8) if i == 1 else picture(i, 150 if i == 2 else 240, 260)
        if i != 4:
            with open(f"{folder}/{name}", "wb") as f:
                f.write(b"broken" if i == 3 else encode_png(image))
        url = None if i == 5 else f"http://a.com/{0 if i == 6 else i}"
        rows.append((name, f"raw/images/{name}", "pexels", url, "d", ["Sea", "Snow"][i % 2], 0, 0, f"2024-01-01 00:00:{i:02d}"))
    schema = "filename string, object_name string, source string, url string, description string, keyword string, width int, height int, crawled_at string"
    store.spark.createDataFrame(rows, schema).write.parquet(store.stage_path("raw"))


def test_chain(store):
    filled(store)
    want = {"ok": 2, "reject_corrupt": 2, "reject_small": 1, "reject_monotone": 1, "reject_missing_url": 1, "reject_url_dup": 1, "reject_hash_dup": 0}
    assert stages.run_cleaning(store) == want
    assert set(stages.run_cleaning(store).values()) == {0}
    assert stages.run_integration(store) == {"ok": 2, "no_file": 0}
    assert stages.run_transformation(store, side=64) == {"ok": 2, "aug": 2, "error": 0, "skip": 0}
    assert stages.run_transformation(store, side=64)["skip"] == 4
    made = store.stage("transformed")
    assert made.count() == 4 and made.where("width <> 64").isEmpty()
    name = made.where("is_augmented").first().object_name
    with open(f"{store.root}/{name}", "rb") as f:
        assert decode_png(f.read()).shape == (64, 64, 3)
    embed = embedder(lambda: block_colours)
    assert stages.run_encoding(store, embed) == {"ok": 4, "error": 0, "skipped": 0}
    assert stages.run_encoding(store, embed) == {"ok": 0, "error": 0, "skipped": 4}
    assert stages.run_encoding(store, embed, "clip")["ok"] == 2
    vector = store.read("clip_features").first()
    assert vector.clip_dim == 48 and abs(np.linalg.norm(vector.clip_vector) - 1) < 1e-4


def test_cluster_predict_evaluate(store):
    rng = np.random.default_rng(1)
    rows = [(f"f{i}", ["sea", "snow", None][i % 3], f"o{i}", [float(v) for v in rng.normal(0, 0.3, 6) + 4 * (i % 3)]) for i in range(90)]
    store.spark.createDataFrame(rows, "filename string, label string, object_name string, clip_vector array<float>").write.parquet(store.path("clip_features"))
    done = stages.cluster_run(store, pca=4, sample_size=60, restarts=2, ks=range(2, 5))
    assert done["k"] == 3 and done["purity"] == 1
    assert store.latest_run() == done["run_id"] == store.run_by_prefix(done["run_id"][:8])
    new = store.spark.createDataFrame([("n", [4.0] * 6)], "filename string, vector array<double>")
    got = stages.predict(store, done["run_id"], new).first()
    assert got.cluster_label == "snow" and 0 < got.confidence <= 1
    tables = stages.evaluation(store)
    assert tables["results"].first().n_samples == 60 and tables["k_curve"].where("is_best").first().k == 3
    assert sum(r["size"] for r in tables["profiles"].collect()) == 60
    shapes = tables["silhouettes"].collect()
    assert len(shapes) == 3 and sum(len(r.scores) for r in shapes) == 60 and all(r.scores == sorted(r.scores) and r["mean"] > 0.5 for r in shapes)
    with pytest.raises(FileNotFoundError):
        store.model("missing-model")


def as_jpeg(spark, png, path):
    """Writes the picture of a PNG file as JPEG, with the JVM's encoder."""
    java = spark._jvm
    found = java.javax.imageio.ImageIO.read(java.java.io.File(str(png)))
    assert java.javax.imageio.ImageIO.write(found, "jpg", java.java.io.File(str(path)))


def smooth(seed, h=240, w=260):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([127 + 120 * np.sin(x / rng.uniform(10, 60) + rng.uniform(0, 6)) * np.cos(y / rng.uniform(10, 60)) for _ in range(3)], 2).astype(np.uint8)


def test_jpeg_images_go_through_the_chain(store, tmp_path):
    """Real JPEG files are decoded, transformed, encoded and predicted; only wanted objects are read."""
    import os

    folder = store.root + "/raw/images"
    os.makedirs(folder)
    rows = []
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(encode_png(smooth(i)))
        as_jpeg(store.spark, tmp_path / f"{i}.png", f"{folder}/p_{i}.jpg")
        rows.append((f"p_{i}.jpg", f"raw/images/p_{i}.jpg", "pexels", f"http://a.com/{i}", "d", "Sea", 0, 0, f"2024-01-0{i + 1}"))
    with open(f"{folder}/p_0.jpg", "rb") as f:
        assert f.read(2) == b"\xff\xd8"
    found = {r.key: decode(bytes(r.content)) for r in contents(store.spark, folder).collect()}
    assert all(np.abs(found[f"p_{i}.jpg"].astype(int) - smooth(i)).mean() < 12 for i in range(3))
    some = contents(store.spark, folder, store.spark.createDataFrame([("p_1.jpg",), ("gone.jpg",)], "key string"))
    assert [r.key for r in some.collect()] == ["p_1.jpg"]
    assert contents(store.spark, folder, store.spark.createDataFrame([("p_1.jpg",)], "key string"), few=0).count() == 1
    schema = "filename string, object_name string, source string, url string, description string, keyword string, width int, height int, crawled_at string"
    store.spark.createDataFrame(rows, schema).write.parquet(store.stage_path("raw"))
    assert stages.run_cleaning(store)["ok"] == 3
    stages.run_integration(store)
    assert stages.run_transformation(store, side=64)["ok"] == 3
    embed = embedder(lambda: block_colours)
    assert stages.run_encoding(store, embed, "clip")["ok"] == 3
    done = stages.cluster_run(store, k=2, pca=3, restarts=2)
    every = stages.predict_images(store, done["run_id"], store.root + "/preprocessed/images/sea", embed).collect()
    assert len(every) == 6 and all(0 < r.confidence <= 1 for r in every)
    one = ["--root", store.root, "predict", "--model-id", done["run_id"], "--embedder", "tests.test_stages:toy", "--out-dir", str(tmp_path / "out"), "--image-file", f"{folder}/p_2.jpg"]
    assert stages.main(one) == 0 and [r.filename for r in store.spark.read.json(str(tmp_path / "out")).collect()] == ["p_2.jpg"]
    assert stages.main([*one[:-2]]) == 1
    tables = stages.evaluation(store, gallery=False)
    assert "gallery" not in tables and tables["scatter"].count() == 3
    assert stages.evaluation(store, scatter=False)["gallery"].count() == 3


def toy():
    return block_colours


def channel_means():
    return lambda batch: batch.mean((2, 3))


def test_models_over_tensors(store):
    """A model gets normalised channel-first tensors; images that can't be decoded are left out."""
    image = np.zeros((40, 60, 3), np.uint8)
    image[:, :, 0] = 255
    rows = store.spark.createDataFrame([("a", bytearray(encode_png(image)), False), ("b", bytearray(b"bad"), False), ("c", None, False)], "filename string, content binary, is_augmented boolean")
    got = encoded(rows, embedder(over_tensors(channel_means, 32)), "clip").collect()
    want = (np.array([1, 0, 0]) - np.array(IMAGENET_MEAN)) / np.array(IMAGENET_STD)
    assert [r.filename for r in got] == ["a"] and got[0].clip_vector == pytest.approx(want / np.linalg.norm(want), abs=1e-5)


def test_encoding_with_tensors_from_the_command_line(store, tmp_path):
    filled(store)
    stages.run_cleaning(store)
    stages.run_integration(store)
    stages.run_transformation(store, side=64)
    assert stages.main(["--root", store.root, "encode", "--side", "16", "--embedder", "tests.test_stages:channel_means"]) == 0
    rows = store.read("clip_features").collect()
    assert len(rows) == 2 and all(r.clip_dim == 3 for r in rows)


def test_empty_features_and_unknown_stage(store):
    store.spark.createDataFrame([], "filename string, label string, object_name string, clip_vector array<float>").write.parquet(store.path("clip_features"))
    with pytest.raises(ValueError):
        store.features()
    with pytest.raises(ValueError):
        store.stage("nothing")


def test_sinks(store):
    df = lambda rows: store.spark.createDataFrame(rows, "k int, v string")
    insert_if_absent(store, "t", df([(1, "a"), (2, "b")]), "k")
    insert_if_absent(store, "t", df([(2, "x"), (3, "c"), (3, "c")]), "k")
    read = lambda: sorted(tuple(r) for r in store.read("t").collect())
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
    upsert(store, "t", df([(3, "z"), (4, None)]), "k")
    assert read() == [(1, "a"), (2, "b"), (3, "z"), (4, None)]
    delete(store, "t", "v = 'a'")
    assert read() == [(2, "b"), (3, "z"), (4, None)]
    assert native({1: np.float32(2), "a": np.arange(2)}) == {"1": 2.0, "a": [0, 1]}


def test_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.png", encode_png(picture())), ("B.PNG", b"bad"), ("c.txt", b"x"), ("sub/d.png", encode_png(picture(2)))):
        (tmp_path / name).write_bytes(data)
    assert sorted(r.path.rpartition("/")[2] for r in image_files(spark, str(tmp_path)).collect()) == ["B.PNG", "a.png"]
    assert {r.key for r in objects(spark, str(tmp_path), "sub/").collect()} == {"sub/d.png"}
    assert [(r.width, r.height) for r in images(spark, str(tmp_path / "a.png")).collect()] == [(320, 240)]
    (tmp_path / "pages").mkdir()
    for page in (1, 2):
        (tmp_path / "pages" / f"{page}.json").write_text(json.dumps({"page": page, "photos": [{"id": page * 10 + i, "src": {"large": "u"}} for i in range(3)]}))
    spark.dataSource.register(PhotoPages)
    rows = spark.read.format("photo_pages").load(str(tmp_path / "pages"))
    assert rows.count() == 6 and rows.select(F.from_json("payload", "src struct<large:string>").src.large).distinct().first()[0] == "u"
    monkeypatch.setenv("SKARN_KEYWORDS", "a, b")
    assert Config.from_env().keywords == ("a", "b")


def test_stream_equals_batch(spark, store, tmp_path):
    rows = sorted(rows_of(120, 9), key=lambda r: (r[7], r[0]))
    source = str(tmp_path / "in")
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        clean_stream(spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    got = {r.filename: r.reject_reason for r in store.read("images_clean").collect()}
    assert got == sequential(rows)


def test_stateful_stream_equals_batch(spark, store, tmp_path):
    """States outlive restarts: the fold goes on though its earlier verdicts can't be read any more."""
    rows = sorted(rows_of(150, 9), key=lambda r: (r[7], r[0]))
    rows = [(*r[:4], None if i % 10 == 3 and r[3] == 150 else r[4], *r[5:]) for i, r in enumerate(rows)]
    source, got = str(tmp_path / "in"), {}
    schema = spark.createDataFrame([], SCHEMA).schema
    for k, part in enumerate((rows[:60], rows[60:90], rows[90:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        clean_stream_by_base(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp"), f"clean_{k}").awaitTermination()
        found = store.read(f"clean_{k}").collect()
        assert len(found) == len(part) and all(r.cleaned == (r.reject_reason is None) for r in found)
        got |= {r.filename: r for r in found}
    want = sequential([r if r[4] is not None else (*r[:3], None, *r[4:]) for r in rows])
    assert {k: r.reject_reason for k, r in got.items()} == want
    assert all(tuple(got[r[0]])[:8] == r for r in rows)


def test_command_line_reports_errors(spark, tmp_path):
    assert stages.main(["--root", str(tmp_path / "none"), "clean"]) == 1
    with pytest.raises(SystemExit):
        stages.main(["cluster", "--sample-strategy", "other"])
