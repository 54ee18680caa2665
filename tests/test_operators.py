import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import aggregates as A
from skarn.operators import clustering as K
from skarn.operators import metrics as M
from skarn.operators import sampling as P
from skarn.operators.cleaning import _Base, cells, cleaning_fold, cleaning_stats, near_hash_pairs
from skarn.operators.graph import components
from skarn.operators.integration import next_ids, stored
from skarn.operators.ordering import numbered
from skarn.sources.staging import Staging

SCHEMA = "filename string, url string, downloaded boolean, width int, height int, gray_std double, phash string, crawled_at string"


def rows_of(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            h ^= 1 << rng.randrange(64)
        url = rng.choice([None, "", f"http://H{rng.randrange(3)}.com/p{rng.randrange(3)}?q={rng.randrange(12)}"])
        out.append((f"f{i:04d}", url, rng.random() > 0.1, rng.choice([None, 150, 300, 400]), rng.choice([300, 500]), rng.choice([2.0, 8.0, 30.0]), f"{h:016x}", f"2024-01-{1 + i // 50:02d}"))
    return out


def sequential(rows):
    """The plain rule over all rows in order."""
    from urllib.parse import urlparse

    seen, hashes, out = set(), {}, {}
    for name, url, ok, w, h, std, phash, _ in sorted(rows, key=lambda r: (r[7], r[0])):
        if not url:
            out[name] = "missing_url"
            continue
        p = urlparse(url)
        norm, base = f"http://{p.netloc.lower()}{p.path}?{p.query}", f"{p.netloc.lower()}{p.path}"
        if norm in seen:
            out[name] = "duplicate_url"
        elif not ok:
            out[name] = "download_failed"
        elif w is None:
            out[name] = "corrupt_image"
        elif w < 200 or h < 200:
            out[name] = f"too_small_{w}x{h}"
        elif std < 8:
            out[name] = "monotone"
        else:
            near = [n for n, v in hashes.get(base, []) if bin(v ^ int(phash, 16)).count("1") <= 2]
            if near:
                out[name] = f"duplicate_phash_of_{near[0]}"
            else:
                out[name] = None
                seen.add(norm)
                hashes.setdefault(base, []).append((name, int(phash, 16)))
    return out


@pytest.mark.parametrize("hot", [10**6, 30, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_sequential_rule(spark, seed, hot):
    rows = rows_of(400, seed)
    got = {r.filename: r.reject_reason for r in cleaning_fold(spark.createDataFrame(rows, SCHEMA), hot_rows=hot).collect()}
    assert got == sequential(rows)


@pytest.mark.parametrize("hot", [10**6, 0])
def test_fold_in_two_runs(spark, hot):
    rows = sorted(rows_of(300, 3), key=lambda r: (r[7], r[0]))
    first = cleaning_fold(spark.createDataFrame(rows[:150], SCHEMA), hot_rows=hot).persist()
    second = cleaning_fold(spark.createDataFrame(rows[150:], SCHEMA), first.where("cleaned"), hot_rows=hot)
    got = {r.filename: r.reject_reason for r in first.unionByName(second).collect()}
    assert got == sequential(rows)


def test_every_row_has_its_own_verdict(spark):
    """Rows that share a filename or have none keep their verdicts."""
    rows = [(*r[:7], f"2024-01-01 {i:04d}") for i, r in enumerate(rows_of(60, 7))]
    named = {r[0]: v for r, v in zip(rows, [sequential(rows)[r[0]] for r in rows], strict=True)}
    odd = [(None if i % 3 == 0 else "same", *r[1:]) for i, r in enumerate(rows)]
    got = cleaning_fold(spark.createDataFrame(odd, SCHEMA)).collect()
    plain = lambda v: v and v.split("_of_")[0]
    assert len(got) == len(rows) and sorted(str((r.url, plain(r.reject_reason))) for r in got if r.url) == sorted(str((r[1], plain(named[r[0]]))) for r in rows if r[1])


@pytest.mark.parametrize("most", [1024, 2])
def test_many_centroids_in_blocks(spark, monkeypatch, most):
    """Blocks of centroids give what one array gives."""
    monkeypatch.setattr(M, "MAX_CENTROIDS", most)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    own = np.arange(80) % 7
    points = spark.createDataFrame([(i, [float(v) for v in x[i]], int(own[i]), "l") for i in range(80)], "key long, vector array<double>, cluster_id int, label string")
    centre = np.array([x[own == c].mean(0) for c in range(7)])
    far = np.sqrt(((x[:, None] - centre[None]) ** 2).sum(2))
    got = {r.key: (r.cluster_id, r.distance) for r in M.nearest(points, M.centroids(points)).collect()}
    assert {k: c for k, (c, _) in got.items()} == dict(enumerate(far.argmin(1).tolist()))
    assert [got[i][1] for i in range(80)] == pytest.approx(far.min(1))
    spread = np.array([far[own == c, c].mean() for c in range(7)])
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + np.diag([np.inf] * 7)
    assert M.davies_bouldin(points).first()[0] == pytest.approx(((spread[:, None] + spread[None]) / gap).max(1).mean())
    size = np.bincount(own)
    ch = ((size * ((centre - x.mean(0)) ** 2).sum(1)).sum() / 6) / ((far[np.arange(80), own] ** 2).sum() / 73)
    assert M.calinski_harabasz(points).first()[0] == pytest.approx(ch)


def test_index_finds_the_first_near_hash():
    """Against comparing with all accepted hashes, among clusters of near hashes."""
    rng = random.Random(4)
    state, seen, base = _Base(2), [], [rng.getrandbits(64) for _ in range(20)]
    for i in range(4000):
        h = rng.choice(base) if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(64)
        want = next((n for n, v in seen if (v ^ h).bit_count() <= 2), None)
        assert state.near(f"{h:016x}") == want
        if want is None:
            state.accept(None, f"{h:016x}", f"n{i}")
            seen.append((f"n{i}", h))


def test_index_grows_in_proportion():
    """One base of distinct hashes: eight times the rows take about eight times as long."""
    import time

    def spent(n):
        rng = random.Random(1)
        rows = [f"{rng.getrandbits(64):016x}" for _ in range(n)]
        state, began = _Base(2), time.process_time()
        for h in rows:
            if state.near(h) is None:
                state.accept(None, h, h)
        return time.process_time() - began

    spent(10_000)
    assert spent(240_000) < 3 * 8 * max(spent(30_000), 0.02)


def test_hot_base_is_split(spark):
    """A base of many unlike hashes becomes many cells; near hashes, and URLs with unlike hashes, stay together."""
    rng = random.Random(6)
    rows = [("b", f"u{i}", f"{rng.getrandbits(64):016x}") for i in range(3000)]
    near = [("b", f"v{i}", f"{int(r[2], 16) ^ (1 << i % 64) ^ (1 << i * 7 % 64):016x}") for i, r in enumerate(rows[:200])]
    same = [("b", "u7", f"{rng.getrandbits(64):016x}"), ("b", "u7", None), ("b", "w", None)]
    with Staging(spark, "test") as staging:
        made = cells(spark.createDataFrame(rows + near + same, "base string, norm string, phash string"), staging).collect()
    of = {}
    for r in made:
        of.setdefault(r.norm, set()).add(r.cell)
    assert all(of[f"v{i}"] == of[f"u{i}"] for i in range(200))
    assert len(of["u7"]) == 1 and of["w"] & of["u7"] == set()
    assert len({c for v in of.values() for c in v}) > 2900


def test_components(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    zigzag = [(2000 + i, 2099 - i) for i in range(50)] + [(2099 - i, 2001 + i) for i in range(49)]
    edges = spark.createDataFrame(path + star + zigzag + [(7, 7), (5, 4)], "a long, b long")
    with Staging(spark, "test") as staging:
        got = {r.v: r.component for r in components(edges, staging).collect()}
        assert components(edges.limit(0), staging).count() == 0
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(50)}, **{2000 + i: 2000 for i in range(100)}}


def test_stats_of_nothing(spark):
    row = cleaning_stats(spark.createDataFrame([], "reject_reason string")).first()
    assert row.processed == 0 and row.pass_rate is None


def test_near_hash_pairs_loses_none(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(5)]
    rows = [(i, h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)), 0) for i in range(60) for h in [rng.choice(base)]]
    rows += [(100 + i, h, 0) for i, h, _ in rows[:20]]
    first = {}
    for i, h, _ in sorted(rows):
        first.setdefault(h, i)
    classes = [(i, h) for h, i in first.items()]
    for distance in (2, 3, 6):
        got = {(r.a, r.b) for r in near_hash_pairs(spark.createDataFrame(rows, "id int, bits long, base int"), "id", "bits", "base", distance).collect()}
        assert got == {(a[0], b[0]) for a in classes for b in classes if a[0] < b[0] and bin(a[1] ^ b[1]).count("1") <= distance}


def test_stored_by_either_key(spark):
    rows = spark.createDataFrame([("a", "x/a"), ("b", None), ("c", "x/c"), ("d", "raw/images/d")], "filename string, object_name string")
    objects = spark.createDataFrame([("x/a",), ("raw/images/b",), ("raw/images/d",)], "path string")
    assert sorted(r.filename for r in stored(rows, objects).collect()) == ["a", "b", "d"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_next_ids_of_a_million_rows(spark, adaptive):
    """Same ids with and without AQE, with extra columns, ties and a key that a third of all rows share."""
    n = 1_000_000
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.hash("id") % 1000)
    rows = spark.range(n).select((n - F.col("id")).alias("name"), key.alias("k"), F.concat(F.lit("x"), F.col("id")).alias("url"), F.array("id").alias("tags"), F.lit("own").alias("id"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = next_ids(rows, spark.createDataFrame([(7,), (3,)], "n int"), "n", "k", "name")
        assert got.columns == ["name", "k", "url", "tags", "id"]
        found = got.select("k", "name", "id", (F.col("url") == F.concat(F.lit("x"), n - F.col("name"))).alias("same")).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert found.same.all() and len(found) == n
    found = found.sort_values(["k", "name"])
    assert (found.id.to_numpy() == np.arange(8, n + 8)).all()


def test_next_ids_of_repeated_rows_and_nothing(spark):
    rows = spark.createDataFrame([("a", 1)] * 500 + [(None, 2), ("b", None)], "k string, v int")
    ids = {}
    for r in next_ids(rows, spark.createDataFrame([], "n int"), "n", "k").collect():
        ids.setdefault(r.k, []).append(r.id)
    assert sorted(ids["a"]) == list(range(2, 502)) and ids[None] == [1] and ids["b"] == [502]
    assert next_ids(rows.limit(0), spark.createDataFrame([(1,)], "n int"), "n", "k").count() == 0


def test_numbers_keep_the_order_of_written_rows(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(100, 0, -1)], "a int, b int").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = numbered(spark.read.parquet(str(tmp_path / "t")), "b").orderBy("position").collect()
    assert [r.a for r in got] == list(range(100, 0, -2)) + list(range(99, 0, -2))


def cloud(n=120, d=4, k=3, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, k, n)
    return rng.normal(0, 1, (n, d)) + 3 * label[:, None], label


def frame(spark, x, cid, label=None):
    label = cid if label is None else label
    return spark.createDataFrame([(i, [float(v) for v in r], int(c), f"l{lab}") for i, (r, c, lab) in enumerate(zip(x, cid, label, strict=True))], "key long, vector array<double>, cluster_id int, label string")


def test_metrics_equal_numpy(spark):
    x, cid = cloud()
    points = frame(spark, x, cid)
    ids, own = np.unique(cid, return_inverse=True)
    centre = np.array([x[own == c].mean(0) for c in range(len(ids))])
    far = np.sqrt(((x - centre[own]) ** 2).sum(1))
    fit = K.Fit(centre, np.bincount(own), centre * np.bincount(own)[:, None], np.bincount(own, far**2))
    s, (ch, db) = K._silhouette(x, own, len(ids)), K._separation(fit, centre, np.bincount(own, far))
    assert M.silhouette(points, sample=None).first()[0] == pytest.approx(s)
    assert M.calinski_harabasz(points).first()[0] == pytest.approx(ch)
    assert M.davies_bouldin(points).first()[0] == pytest.approx(db)
    assert M.purity(points).first()[0] == 1


def test_silhouette_of_a_single_member(spark):
    points = frame(spark, np.array([[0.0], [0.1], [9.0]]), np.array([0, 0, 1]))
    assert {r.key: r.s for r in M.silhouettes(points, sample=None).collect()}[2] == 0


@pytest.mark.parametrize(("rows", "columns"), [(8192, 16384), (512, 300)])
def test_silhouettes_in_cells(spark, monkeypatch, rows, columns):
    """Cells of any size give what one matrix gives; repeated keys and points keep their rows."""
    monkeypatch.setattr(M, "ROWS", rows)
    monkeypatch.setattr(M, "COLUMNS", columns)
    monkeypatch.setattr(M, "_cells", lambda n: (max(1, -(-n // 400)), max(1, -(-n // columns))))
    x, cid = cloud(1000, 5, 4, seed=2)
    x[10], cid[10], x[11], cid[11] = x[12], cid[12], x[12], cid[12]
    cid[13] = 9
    points = frame(spark, x, cid)
    far = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    want = []
    for i in range(len(x)):
        own = cid == cid[i]
        a = far[i, own].sum() / max(own.sum() - 1, 1)
        b = min(far[i, cid == c].mean() for c in set(cid.tolist()) - {cid[i]})
        want.append((b - a) / max(a, b) if own.sum() > 1 else 0)
    got = {r.key: r.s for r in M.silhouettes(points, sample=None).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, abs=1e-9)
    twice = points.withColumn("key", F.col("key") % 500)
    assert sorted(r.s for r in M.silhouettes(twice, sample=None).collect()) == pytest.approx(sorted(want), abs=1e-9)
    assert M.silhouettes(points, sample=100).count() == 100 and M.silhouettes(points.limit(0), sample=None).count() == 0


def test_silhouettes_of_many_points(spark):
    """More points than a task holds: a random part of them is checked against all points."""
    n = 60_000
    rng = np.random.default_rng(3)
    part = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("cluster_id"), F.array(*[F.rand(k) + (F.col("id") % 3) for k in range(3)]).alias("vector"))
    data = part.toPandas().sort_values("key")
    x, cid = np.array(data.vector.tolist()), data.cluster_id.to_numpy()
    points = spark.createDataFrame(data)
    got = M.silhouettes(points, sample=None).toPandas().set_index("key").s
    assert len(got) == n
    for i in rng.choice(n, 20).tolist():
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        a = d[cid == cid[i]].sum() / ((cid == cid[i]).sum() - 1)
        b = min(d[cid == c].mean() for c in range(3) if c != cid[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def contaminated(spark, bad):
    x = [[0.0, 0.0]] * (25 - bad) + [[1.0, 1.0]] * bad + [[5.0, 5.0]] * 4
    label = ["a"] * (25 - bad) + ["b"] * bad + ["b"] * 4
    return spark.createDataFrame([(i, v, 0 if i < 25 else 1, lab) for i, (v, lab) in enumerate(zip(x, label, strict=True))], "key long, vector array<double>, cluster_id int, label string")


@pytest.mark.parametrize(("bad", "moved"), [(2, 0), (3, 3)])
def test_contamination_threshold_is_strict(spark, bad, moved):
    rows = M.contamination_fix(contaminated(spark, bad)).where("new_cluster_id <> cluster_id").collect()
    assert len(rows) == moved and all(r.new_cluster_id == 1 and r.label == "b" for r in rows)


def test_contamination_without_target(spark):
    points = contaminated(spark, 5).where("cluster_id = 0")
    assert M.contamination_fix(points).where("new_cluster_id <> cluster_id").count() == 0


def test_dominant_tie_takes_the_smallest_label(spark):
    points = frame(spark, np.zeros((4, 1)), np.zeros(4, int), ["z", "b", "b", "z"])
    assert M.dominant(points).first().dominant_label == "lb"


def test_ties_follow_the_load_order(spark, tmp_path):
    """Rows are loaded against the order of their keys and labels: the first loaded one wins, as in a loop over rows."""
    from skarn.sources.tables import Table

    rows = [(9 - i, [float(i % 2)], 0, "zzyyxx"[i % 6]) for i in range(8)] + [(100 - i, [1.0], 1, "ba"[i % 2]) for i in range(6)]
    table = Table(spark, str(tmp_path / "t"))
    for part in (rows[:5], rows[5:]):
        table.append(spark.createDataFrame(part, "key long, vector array<double>, cluster_id int, label string").coalesce(1))
    points = table.in_order()
    got = {r.cluster_id: r for r in M.profiles(points, order="position").collect()}
    assert (got[0].dominant_label, got[0].medoid_filename, got[0].sample_filenames) == ("z", 9, [9, 8, 7, 6, 5])
    assert (got[1].dominant_label, got[1].medoid_filename, got[1].sample_filenames) == ("b", 100, [100, 99, 98, 97, 96])
    plain = {r.cluster_id: r for r in M.profiles(points).collect()}
    assert (plain[1].dominant_label, plain[1].medoid_filename, plain[1].sample_filenames) == ("a", 95, [95, 96, 97, 98, 99])


def test_profiles_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_LABELS", 3)
    points = frame(spark, np.zeros((9, 1)), np.array([0] * 6 + [1] * 3), ["a", "b", "c", "d", "e", "a", "x", "y", "x"])
    got = {r.cluster_id: r.label_distribution for r in M.profiles(points).collect()}
    assert got == {0: None, 1: {"lx": 2, "ly": 1}}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_repair_with_many_targets(spark, monkeypatch, limit):
    monkeypatch.setattr(M, "SENT_BYTES", limit)
    rng = np.random.default_rng(5)
    n = 400
    own, label = rng.integers(0, 12, n), rng.integers(0, 3, n)
    label = np.where(rng.random(n) < 0.7, own % 3, label)
    x = rng.normal(size=(n, 4))
    points = frame(spark, x, own, label)
    got = {r.key: r.new_cluster_id for r in M.contamination_fix(points).collect()}
    count = np.array([[((own == c) & (label == k)).sum() for k in range(3)] for c in range(12)])
    top, centre = count.argmax(1), np.array([x[own == c].mean(0) for c in range(12)])
    for i in range(n):
        c, k = own[i], label[i]
        others = [t for t in range(12) if top[t] == k and t != c]
        moves = k != top[c] and count[c, k] / count[c].sum() > M.THRESHOLD and others
        assert got[i] == (min(others, key=lambda t: (np.linalg.norm(x[i] - centre[t]), t)) if moves else c)


def test_nearest_tie_takes_the_lowest_id(spark):
    centres = spark.createDataFrame([(2, [1.0]), (1, [-1.0])], "cluster_id int, centroid array<double>")
    assert M.nearest(frame(spark, np.array([[0.0]]), np.array([9])), centres).first().cluster_id == 1


def test_k_votes_tie(spark):
    table = spark.createDataFrame([(2, 0.9, 1.0, 1.0), (3, 0.1, 9.0, 0.5)], "k int, silhouette double, calinski_harabasz double, davies_bouldin double")
    assert {r.k: r.votes for r in M.k_votes(table).collect()} == {2: 3, 3: 3} and M.recommended_k(table).first().k == 2


def test_standardised_columns(spark):
    x, cid = cloud()
    x[:, 3] = 7
    z = np.array([r.vector for r in K.standardised(frame(spark, x, cid)).collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z[:, :3].std(0), 1) and np.allclose(z[:, 3], 0)


def test_pca_keeps_distances(spark):
    x, cid = cloud()
    points = frame(spark, x, cid)
    model = K.pca_pipeline(points, 99)
    y = np.array([r.vector for r in K.projected(points, model).orderBy("key").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert y.shape == x.shape and K.explained(model) == pytest.approx(1)
    assert np.allclose(np.linalg.norm(y[0] - y[1]), np.linalg.norm(z[0] - z[1]))


def test_kmeans_and_search_find_the_clusters(spark):
    x, cid = cloud(90, 3, 3)
    points = frame(spark, 4 * x, cid).drop("cluster_id")
    found = K.assigned(points, K.kmeans(points, 3, restarts=3))
    assert M.purity(found).first()[0] > 0.9
    table = K.k_search(points, range(2, 6), restarts=3)
    assert table.count() == 4 and M.recommended_k(table).first().k == 3


@pytest.mark.parametrize("sizes", [{"a": 97, "b": 2, "c": 1}, {"a": 300, "b": 200, "c": 501}])
def test_stratified_quotas(spark, sizes):
    rows = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "key string, label string")
    n = sum(sizes.values())
    quota = {r.label: r.quota for r in P.quotas(rows, "label", 50).collect()}
    assert sum(quota.values()) == 50 and all(abs(quota[k] - 50 * s / n) < 1 for k, s in sizes.items())
    got = P.stratified(rows, "key", "label", 50).collect()
    assert len(set(got)) == 50 and all(sum(r.label == k for r in got) == quota[k] for k in sizes)
    assert sorted(got) == sorted(P.stratified(rows.repartition(7), "key", "label", 50).collect())
    assert P.stratified(rows, "key", "label", None).count() == n


@pytest.mark.parametrize("few", [16_384, 1])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    """Groups of one value, of all signs and sizes, with infinities, nulls and NaN; intervals down to single values."""
    from skarn.operators import quantiles as Q

    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", 16)
    rng = np.random.default_rng(1)
    data = {
        "normal": rng.normal(size=900), "one": np.array([3.5]), "same": np.full(400, -2.0), "whole": rng.integers(0, 50, 800).astype(float), "two": np.array([1.0, 2.0]),
        "spread": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 300)), np.zeros(9)]), "near": 1 + rng.integers(0, 9, 300) * 2.0**-52, None: rng.exponential(size=100),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    shares = (0.0, 0.25, 0.5, 0.98, 1.0)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.q for r in Q.quantiles(df, "v", shares, "k").collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, shares), rel=1e-12), k
    every = np.concatenate(list(data.values()))
    assert Q.quantiles(df, "v", shares).first().q == pytest.approx(np.quantile(every, shares), rel=1e-12)
    ends = spark.createDataFrame([(float(v),) for v in (*[float("-inf")] * 3, *range(-40, 40), *[float("inf")] * 5)], "v double")
    assert Q.quantiles(ends, "v", (0.0, 0.5, 1.0)).first().q == [float("-inf"), 0.5, float("inf")]


def test_described_without_numbers(spark):
    rows = spark.createDataFrame([("a", None)], "k string, v double")
    assert A.described(rows, "v").first().asDict() == {"count": 0, "mean": None, "std": None, "min": None, "q25": None, "q50": None, "q75": None, "max": None}
    assert A.quantile(rows, "v", 0.5).first().value is None
    assert A.middle_by(rows, "k", "v").first().asDict() == {"k": "a", "median": None, "min": None, "max": None}
    assert A.box_stats(rows, "k", "v").count() == 0


def test_shares_follow_the_domain(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("x",)], "k string")
    assert {r.k: (r.n, r.pct) for r in A.shares(rows, "k", ["a", "b"]).collect()} == {"a": (2, 100.0), "b": (0, 0.0)}


def test_histogram_closes_the_last_bin(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert {r.bin: r.n for r in A.histogram(rows, F.col("v"), 10).collect()} == {i: (2 if i == 10 else 1) for i in range(1, 11)}


def test_pass_rate_of_an_absent_source(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("a", None)], "s string, ok boolean")
    got = {r.s: (r.passed, r.rejected, r.rate, r.mean_rate) for r in A.pass_rates(rows, "s", F.col("ok"), ["a", "b"]).collect()}
    assert got == {"a": (1, 2, 33.3333, 16.6667), "b": (0, 0, 0.0, 16.6667)}
