"""Faults that only larger tables showed, on small tables of the same kind."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn import queries
from skarn.functions import scalar as S
from skarn.operators import aggregates as A
from skarn.operators import cleaning as C
from skarn.operators import clustering as K
from skarn.operators import metrics as M


def rows_and_sql(spark, folder, name):
    """Sorted rows of a query and of its SQL over the tables in ``folder``."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = queries.QUERIES[name](spark, str(folder))
    wanted = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(wanted)


def test_ratio_rounds_as_sql_does(spark, tmp_path):
    """quotients that lie just beside a half."""
    pairs = [(89050.5, 22.0), (40786.25, 5.0), (96614.25, 3.0), (1000.5, 1.0), (2.5, 1.0), (1.0, 0.0), (7.0, 3.0)]
    df = spark.createDataFrame(pairs, "l_extendedprice double, l_quantity double")
    got = [r.v for r in df.select(S.ratio(F.col("l_extendedprice"), F.col("l_quantity") * 500).alias("v")).collect()]
    wanted = [duckdb.sql(f"SELECT round({p}::DOUBLE / nullif({q}::DOUBLE * 500, 0), 3)").fetchall()[0][0] for p, q in pairs]
    assert got == wanted and got[0] == 8.095


def test_histogram_of_halves(spark, tmp_path):
    """4.0005 rounds to 4.0 in SQL, which is inside of the range."""
    rows = [(150.0, 1.0), (1000.0, 1.0), (2000.0, 1.0), (2000.25, 1.0), (4000.5, 2.0)]
    spark.createDataFrame(rows, "l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got, wanted = rows_and_sql(spark, tmp_path, "histogram_ratio_40")
    assert got == wanted and sum(n for _, n in got) == 5


def test_batch_groups_of_many_pages(spark, tmp_path, monkeypatch):
    """clusters of more files than a page holds are one row of the query."""
    monkeypatch.setattr(A, "GROUP_PAGE", 3)
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, wanted = rows_and_sql(spark, tmp_path, "batch_groups")
    assert got == wanted and max(len(r[3]) for r in got) > 3


@pytest.mark.parametrize("name", ["filename_pad_and_stem", "max_id_by_regex"])  # F2, F4
@pytest.mark.parametrize("keys", [(7, 999998, 1000000, 1234567), (999999,), (1000000, 999999), ()])
def test_names_of_large_numbers(spark, tmp_path, name, keys):
    spark.createDataFrame([(k, 20) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got, wanted = rows_and_sql(spark, tmp_path, name)
    assert got == wanted


def test_partitions_share_their_distances(spark, monkeypatch):
    """F8, F10, F11: the scores of k partitions need one comparison of all pairs, and equal those of each partition alone."""
    calls, whole = [], M.silhouettes_of
    monkeypatch.setattr(M, "silhouettes_of", lambda *a, **k: calls.append(a) or whole(*a, **k))
    queries.QUERIES["k_curve"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 3, 2).astype(float).tolist(), i % 3 - 1, 7 if i == 11 else i % 2, 5, "a") for i in range(70)]  # equal points, negative ids, a single member, one cluster
    p = spark.createDataFrame(rows, "key long, vector array<double>, x int, y int, z int, label string")
    alone = {c: {r.key: r.s for r in M.silhouettes(p.withColumn("cluster_id", F.col(c)), sample=None).collect()} for c in "xyz"}
    for r in whole(p, ["x", "y", "z"], sample=None).collect():
        assert r.scores == pytest.approx([alone[c][r.key] for c in "xyz"], abs=1e-12)
    for c, row in zip("xy", M.bundles(p, ["x", "y"], sample=None), strict=True):
        assert row.collect() == M.bundle(p.withColumn("cluster_id", F.col(c)), sample=None).collect()


def test_pass_adds_all_models(spark):
    """models of one k meet the points together; sizes, squared norms and sums are those of the plain rule, the first of equally near centres."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (700, 3)).astype(float)
    models = {0: x[:2], 3: x[[5, 5, 9]], 4: x[10:13], 7: x[20:22], 8: x[:1]}
    assert [(ids, c.shape) for ids, c in K._stacked(models)] == [([0, 7], (2, 2, 3)), ([3, 4], (3, 2, 3)), ([8], (1, 1, 3))]
    found = K._pass(spark.createDataFrame([(v,) for v in x.tolist()], "vector array<double>"), models)
    for m, c in models.items():
        own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            mine = x[own == j]
            assert found[m][j].tolist() == [len(mine), (mine**2).sum(), *mine.sum(0)]
        assert K._stepped(c, found[m])[0].cost == pytest.approx(((x - c[own]) ** 2).sum())


def test_kmeans_goes_on_to_rest(spark, monkeypatch):
    """a tolerance that lets points move stands for a large table, where a point shifts its centre by less than the real one."""
    monkeypatch.setattr(K, "TOLERANCE", 0.2)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert queries.QUERIES["kmeans_is_stable"](spark, "/root/testdata/sf0.01").collect()[0].asDict() == {"moved": 0, "n": df.count()}


def test_hashes_of_many_groups(spark, monkeypatch):
    """large distances compare all pairs, each once, in cells of two groups; bases of one group and of several, texts as keys."""
    monkeypatch.setattr(C, "GROUP_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(f"k{i:03d}", int(h), b) for b, n in (("x", 100), ("y", 9), ("z", 1)) for i, h in enumerate(rng.integers(-(2**63), 2**63, n) & ~0xFFFFFFFFFF)] + [("n", None, "x"), ("m", 5, None)]
    got = C.near_hash_pairs(spark.createDataFrame(rows, "id string, bits long, base string"), "id", "bits", "base", 7).collect()
    far = lambda a, b: ((a[1] ^ b[1]) & (2**64 - 1)).bit_count()
    real = rows[:-2]
    wanted = sorted((a[0], b[0], far(a, b)) for a in real for b in real if a[2] == b[2] and a[0] < b[0] and far(a, b) <= 7)
    assert sorted(map(tuple, got)) == wanted and len(wanted) > 100
