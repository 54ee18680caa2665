import os
import threading

import pytest
from pyspark.sql import functions as F

from skarn.sources import tables
from skarn.sources.catalog import Store
from skarn.sources.sinks import absent, append, create_indexes, delete, insert_if_absent, upsert
from skarn.sources.tables import Conflict, Table


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def frame(store, rows, schema="k int, v string"):
    return store.spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_and_changes(store):
    t = store.table("t")
    assert not t.exists() and t.snapshot() is None
    append(store, "t", frame(store, [(1, "a"), (2, "b"), (3, None)]).repartition(3))
    upsert(store, "t", frame(store, [(2, "z"), (4, "d")]), "k")
    delete(store, "t", "v = 'a'")
    insert_if_absent(store, "t", frame(store, [(4, "no"), (5, "e"), (5, "f")]), "k")
    assert {r[0] for r in rows(store.read("t"))} == {2, 3, 4, 5} and store.read("t").count() == 4
    assert rows(t.read(0)) == [(1, "a"), (2, "b"), (3, None)]
    assert rows(t.read(1)) == [(1, "a"), (2, "z"), (3, None), (4, "d")]
    assert rows(t.read(2)) == [(2, "z"), (3, None), (4, "d")]
    assert [h["change"] for h in t.history()] == ["append", "upsert", "delete", "insert"]
    delete(store, "t", "k = 99")
    assert len(t.history()) == 4
    t.replace(frame(store, []))
    assert store.read("t").count() == 0 and store.read("t").columns == ["k", "v"]


def test_files_without_changes_are_kept(store):
    append(store, "t", store.spark.range(100).repartitionByRange(5, "id"))
    t = store.table("t")
    before = set(t.snapshot().files)
    delete(store, "t", "id = 3")
    upsert(store, "t", store.spark.createDataFrame([(99,)], "id long"), "id")
    assert len(before & set(t.snapshot().files)) == 3 and store.read("t").count() == 99


def test_partitions_and_new_columns(store):
    append(store, "t", frame(store, [(1, "a b"), (2, "x/y"), (3, None)]), "v")
    append(store, "t", frame(store, [(4, "a b", 1.5)], "k int, v string, w double"), "v")
    assert rows(store.read("t")) == sorted([(1, "a b", None), (2, "x/y", None), (3, None, None), (4, "a b", 1.5)], key=repr)
    delete(store, "t", "v = 'x/y'")
    assert rows(store.read("t").select("k")) == [(1,), (3,), (4,)]


def test_plain_folders_are_adopted(store):
    frame(store, [(1, "a"), (2, "b")]).write.parquet(store.path("t"))
    assert store.read("t").count() == 2
    upsert(store, "t", frame(store, [(2, "c")]), "k")
    assert rows(store.read("t")) == [(1, "a"), (2, "c")] and rows(store.table("t").read(0)) == [(1, "a"), (2, "b")]


def test_many_versions(store, monkeypatch):
    monkeypatch.setattr(tables, "WHOLE_EVERY", 4)
    for i in range(11):
        append(store, "t", frame(store, [(i, "x")]).coalesce(1))
        if i % 3 == 2:
            delete(store, "t", f"k = {i - 1}")
    left = sorted(set(range(11)) - {1, 4, 7})
    assert [r[0] for r in rows(store.read("t"))] == sorted(left, key=lambda k: repr((k, "x")))
    t = store.table("t")
    assert [t.read(v).count() for v in t.versions()] == [1, 2, 3, 2, 3, 4, 5, 4, 5, 6, 7, 6, 7, 8]
    gone = t.vacuum(keep=1, older_than=-60)
    assert len(gone) == 3 and store.read("t").count() == 8


def test_a_reader_never_misses_the_table(store):
    append(store, "t", frame(store, [(i, "a") for i in range(20)]))
    seen, failed, stop = set(), [], threading.Event()

    def look():
        while not stop.is_set():
            try:
                seen.add(tuple(r[0] for r in Table(store.spark, store.path("t")).read().groupBy("v").count().select("count").collect()))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for v in "bcdef":
        upsert(store, "t", frame(store, [(i, v) for i in range(20)]), "k")
    stop.set()
    reader.join()
    assert not failed and seen == {(20,)}


@pytest.mark.parametrize("way", ["append", "insert", "upsert"])
def test_writers_lose_no_rows(store, way):
    append(store, "t", frame(store, [(-1, "first")]))
    failed = []

    def work(n):
        try:
            for i in range(3):
                new = frame(store, [(k, f"w{n}") for k in range(i * 10, i * 10 + 10)] + [(1000 + n * 10 + i, "own")])
                {"append": lambda: append(store, "t", new), "insert": lambda: insert_if_absent(store, "t", new, "k"), "upsert": lambda: upsert(store, "t", new, "k")}[way]()  # noqa: B023
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    keys = [r.k for r in store.read("t").collect()]
    assert sum(k >= 1000 for k in keys) == 9 and len(set(keys)) == 40
    assert len(keys) == (100 if way == "append" else 40)


def test_a_killed_task_leaves_nothing(store):
    append(store, "t", frame(store, [(1, "a")]))
    before = {f for f in store.table("t").folder.files()}

    def die(batches):
        for b in batches:
            if 150 in b.column("id").to_pylist():
                os._exit(9)
            yield b

    broken = store.spark.range(0, 200, 1, 4).mapInArrow(die, "id long").select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v"))
    for write in (lambda: append(store, "t", broken), lambda: upsert(store, "t", broken, "k"), lambda: insert_if_absent(store, "t", broken, "k")):
        with pytest.raises(Exception, match="."):
            write()
        assert {f for f in store.table("t").folder.files()} == before and len(store.table("t").folder.names("data")) == 1
    assert rows(store.read("t")) == [(1, "a")]


def test_an_entry_is_created_once(store):
    folder = store.table("t").folder
    folder.create("_log/1.json", "one")
    with pytest.raises(Conflict):
        folder.create("_log/1.json", "two")
    assert folder.text("_log/1.json") == "one" and folder.names("_log") == ["1.json"]
    folder.create("_log/a", "x")
    folder.rename("_log/a", "_log/b")
    folder.create("_log/a", "y")
    with pytest.raises(FileExistsError):
        folder.rename("_log/a", "_log/b")


def test_absent_takes_the_same_row_each_time(spark):
    new = spark.createDataFrame([(i % 5, f"v{i}", {"a": i}) for i in range(100)] + [(None, "n", None)] * 2, "k int, v string, m map<string,int>")
    old = spark.createDataFrame([(3,)], "k int")
    a, b = ({r.k: r.v for r in absent(new.repartition(n), old, "k").collect()} for n in (1, 7))
    assert a == b and set(a) == {0, 1, 2, 4, None}
    assert rows(absent(spark.createDataFrame([(1,), (1,), (3,)], "k int"), old, "k")) == [(1,)]


def rows_read(df):
    """Rows that the scans of a query give, by Spark's own metrics."""
    df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_an_index_skips_files(store):
    spark = store.spark
    rows = spark.range(20_000).select(F.format_string("f%06d", (F.col("id") * 7919) % 20_000).alias("filename"), F.col("id").alias("v"))
    append(store, "t", rows.repartition(8))
    t = store.table("t")
    name = "f012345"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows, several files
    create_indexes(store, {"t": ("filename",)})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert t.snapshot().index == ("filename",) and len(t.snapshot().files) >= 4 and store.read("t").count() == 20_000
    version = t.snapshot().version
    create_indexes(store, {"t": ("filename",), "none": ("k",)})
    assert t.snapshot().version == version
    one = t.lookup("filename", name)
    assert one.count() == 1 and one.first().filename == name
    assert rows_read(t.lookup("filename", name)) <= 20_000 / 2.5 and rows_read(t.lookup("filename", "zzz")) == 0
    # the resume join of a few new names reads the files that can hold them
    new = spark.createDataFrame([(f"f{i:06d}",) for i in (5, 7, 19_999_9)], "filename string")
    whole, some = rows_read(new.join(store.read("t"), "filename", "left_anti")), rows_read(new.join(t.candidates(new), "filename", "left_anti"))
    assert whole == 20_000 and some <= 20_000 / 2.5
    assert [r.filename for r in new.join(t.candidates(new), "filename", "left_anti").collect()] == ["f199999"]
    # rows that come later are in ranges too, and changes keep the index
    insert_if_absent(store, "t", spark.createDataFrame([("f000005", -1), ("g", -2)], "filename string, v long"), "filename")
    upsert(store, "t", spark.createDataFrame([(name, -3)], "filename string, v long"), "filename")
    delete(store, "t", "filename = 'f000007'")
    at = t.snapshot()
    assert at.index == ("filename",) and set(at.ends) == set(at.files) and store.read("t").count() == 20_000
    assert t.lookup("filename", name).first().v == -3 and t.lookup("filename", "g").first().v == -2 and t.lookup("filename", "f000005").first().v >= 0
    assert rows_read(t.lookup("filename", name)) <= 20_000 / 2.5


def test_bloom_filters_are_written(store):
    import pyarrow.parquet as pq

    append(store, "t", store.spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id")))
    store.table("t").cluster("k")
    f = store.table("t").snapshot().files[0]
    with open(f"{store.path('t')}/{f}", "rb") as file:
        size = len(file.read())
    plain = store.path("plain")
    store.spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id")).orderBy("k").coalesce(1).write.parquet(plain)
    assert pq.ParquetFile(f"{store.path('t')}/{f}").metadata.num_rows > 0 and size > 0
    assert sum(os.path.getsize(f"{store.path('t')}/{n}") for n in store.table("t").snapshot().files) > sum(os.path.getsize(f"{plain}/{n}") for n in os.listdir(plain) if n.endswith(".parquet")) + 500_000


def test_load_order_of_versions(store):
    for i in range(3):
        append(store, "t", store.spark.createDataFrame([(f"v{i}", 9 - k) for k in range(3)], "a string, k int").coalesce(1))
    got = store.table("t").in_order().orderBy("position").collect()
    assert [(r.a, r.k) for r in got] == [(f"v{i}", 9 - k) for i in range(3) for k in range(3)]
    frame(store, [(3, "x"), (1, "y")]).coalesce(1).write.parquet(store.path("plain"))
    assert [r.k for r in store.table("plain").in_order().orderBy("position").collect()] == [3, 1]
