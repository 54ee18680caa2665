"""Cluster metrics, dominant labels, contamination repair and profiles.

``points`` have ``key``, ``vector`` (array of numbers), ``cluster_id`` and ``label``.  Means of vectors are one aggregate that combines before the
shuffle.  Tables with one row for each cluster are computed once: up to ``MAX_CENTROIDS`` rows they are sent to the tasks, more of them are
joined by a shuffle, or compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import confidence
from ..functions.vectors import distance, doubles
from ..sources.staging import Staging
from .ordering import FILE, ROW, placed

MAX_CENTROIDS = 1024
SAMPLE = 5000
#: Points that the task of a silhouette cell holds, and points of its rows, at most about.
COLUMNS, ROWS = 16_384, 8_192
THRESHOLD = 0.08


def centroids(points: DataFrame, by: str = "cluster_id") -> DataFrame:
    """``by`` and the mean vector ``centroid``."""
    mean = Summarizer.mean(array_to_vector(doubles(F.col("vector"))))
    return points.groupBy(by).agg(vector_to_array(mean).alias("centroid"))


def few(table: DataFrame, most: int | None = None) -> DataFrame:
    """A table with a row for each cluster, computed once: up to ``most`` rows are marked for broadcast, more stay a distributed table."""
    most = MAX_CENTROIDS if most is None else most
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


#: Bytes of vectors that a broadcast table may hold.
SENT_BYTES = 64 << 20


def sent(table: DataFrame, column: str = "c") -> DataFrame:
    """A table with a vector in each row, marked for broadcast if its rows and vectors are small together; its size is measured first."""
    size = table.agg(F.sum(8 * F.size(column) + 64)).first()[0] or 0
    return F.broadcast(table) if size <= SENT_BYTES else table


def blocks(table: DataFrame, most: int | None = None) -> list[DataFrame]:
    """One-row tables that together hold the rows of ``table`` as arrays ``rows``, about ``most`` in each."""
    most = MAX_CENTROIDS if most is None else most
    n = max(1, -(-table.count() // most))
    cut = table.select(F.struct(*table.columns).alias("row"), F.pmod(F.xxhash64(table.columns[0]), F.lit(n)).alias("block"))
    return [F.broadcast(cut.where(F.col("block") == i).agg(F.array_sort(F.collect_list("row")).alias("rows"))) for i in range(n)]


def nearest(points: DataFrame, centres: DataFrame, by: str = "cluster_id") -> DataFrame:
    """``points`` with ``cluster_id`` of the nearest centroid (ties: the lowest id) and ``distance``.  The centroids travel as arrays, block by block."""
    rest = points.drop("cluster_id", "distance")
    found = rest.select(F.struct("*").alias("skarn_row"), F.col("vector").alias("skarn_vector"), F.lit(None).cast("struct<distance:double,id:int>").alias("best"))
    for block in blocks(few(centres.select(F.col(by).cast("int").alias("id"), F.col("centroid").alias("c")))):
        best = F.array_min(F.transform("rows", lambda r: F.struct(distance(F.col("skarn_vector"), r["c"]).alias("distance"), r["id"].alias("id"))))
        found = found.crossJoin(block).withColumn("best", F.array_min(F.array_compact(F.array("best", best)))).drop("rows")
    return found.select("skarn_row.*", F.col("best.id").alias("cluster_id"), F.col("best.distance").alias("distance"))


def predictions(points: DataFrame, centres: DataFrame, names: DataFrame) -> DataFrame:
    """Prediction records: nearest centroid, its label (``unknown`` without one), distance and confidence."""
    labelled = nearest(points, centres).join(few(names), "cluster_id", "left")
    return labelled.select("filename", "cluster_id", F.coalesce("cluster_label", F.lit("unknown")).alias("cluster_label"), F.round("distance", 4).alias("distance_to_centroid"), confidence(F.col("distance")).alias("confidence"))


def label_counts(points: DataFrame, order: str | None = None) -> DataFrame:
    """``n`` of each cluster and label, and the ``first`` place of the label in ``order`` (else the label itself)."""
    return points.groupBy("cluster_id", "label").agg(F.count("*").alias("n"), F.min(order or "label").alias("first"))


def dominant(points: DataFrame, order: str | None = None) -> DataFrame:
    """``cluster_id``, ``size``, ``dominant_label`` (most rows; ties: the label that comes first in ``order``, a column, else the smallest) and ``n_dominant``."""
    best = F.min(F.struct((-F.col("n")).alias("minus"), "first", F.col("label").alias("label")))
    return label_counts(points, order).groupBy("cluster_id").agg(F.sum("n").alias("size"), best.alias("best")).select("cluster_id", "size", F.col("best.label").alias("dominant_label"), (-F.col("best.minus")).alias("n_dominant"))


def purity(points: DataFrame, digits: int = 4) -> DataFrame:
    return dominant(points).agg(F.round(F.sum("n_dominant") / F.sum("size"), digits).alias("purity"))


def contamination_fix(points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``points`` with ``new_cluster_id``.

    In each cluster, the rows of a non-dominant label whose share is above ``threshold`` move to the nearest other cluster that this label
    dominates; labels that dominate no other cluster stay.  Only the given assignment is read, so the order of rows is irrelevant.
    It uses true labels: report scores before and after.
    """
    top = dominant(points)
    counted = label_counts(points).join(top, "cluster_id")
    dirty = counted.where((F.col("label") != F.col("dominant_label")) & (F.col("n") / F.col("size") > threshold)).select("cluster_id", "label")
    targets = top.select(F.col("dominant_label").alias("label"), F.col("cluster_id").alias("target"))
    # a pair (cluster, label) meets the clusters that the label dominates one by one; centroids come by their own join, and only the nearest target stays with a row
    plan = dirty.join(targets, "label").where("target <> cluster_id").join(centroids(points).select(F.col("cluster_id").alias("target"), F.col("centroid").alias("c")), "target")
    staging = Staging(points.sparkSession, "repair")
    fixed = placed(staging.write(points, "points"))
    moving = fixed.join(sent(plan), ["cluster_id", "label"])
    best = F.min(F.struct(distance(F.col("vector"), F.col("c")).alias("d"), F.col("target").alias("id"))).alias("best")
    moved = moving.groupBy(FILE, ROW).agg(best)
    return fixed.join(moved, [FILE, ROW], "left").select(*points.columns, F.coalesce("best.id", "cluster_id").alias("new_cluster_id"))


def within(points: DataFrame) -> DataFrame:
    """Squared distance sum, mean distance, size and centroid of each cluster."""
    d = distance(F.col("vector"), F.col("centroid"))
    sums = points.join(few(centroids(points)), "cluster_id").withColumn("d", d).groupBy("cluster_id")
    return few(sums.agg(F.sum(F.col("d") * F.col("d")).alias("sse"), F.avg("d").alias("spread"), F.count("*").alias("size"), F.first("centroid").alias("centroid")))


def inertia(points: DataFrame) -> DataFrame:
    return within(points).agg(F.sum("sse").alias("inertia"))


def calinski_harabasz(points: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """[between / (k - 1)] / [within / (n - k)]; null where it has no value.  The overall mean is that of the centroids, weighted by size."""
    groups = within(points) if groups is None else groups
    weighted = groups.select(F.transform("centroid", lambda x: x * F.col("size")).alias("vector"), "size")
    centre = weighted.agg((Summarizer.mean(array_to_vector("vector"))).alias("m"), F.avg("size").alias("w")).select(vector_to_array("m").alias("m"), "w")
    overall = centre.select(F.transform("m", lambda x: x / F.col("w")).alias("overall"))
    d = distance(F.col("centroid"), F.col("overall"))
    row = groups.crossJoin(F.broadcast(overall)).agg(F.sum(F.col("size") * d * d).alias("b"), F.sum("sse").alias("w"), F.sum("size").alias("n"), F.count("*").alias("k"))
    return row.select(F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Mean over clusters of the largest (s_i + s_j) / d_ij; each cluster is compared with arrays of all, block by block."""
    groups = within(points) if groups is None else groups
    found = groups.select("cluster_id", "spread", "centroid", F.lit(None).cast("double").alias("r"))
    for block in blocks(groups.select("cluster_id", "spread", "centroid")):
        others = F.filter("rows", lambda o: o["cluster_id"] != F.col("cluster_id"))
        most = F.array_max(F.transform(others, lambda o: F.try_divide(F.col("spread") + o["spread"], distance(F.col("centroid"), o["centroid"]))))
        found = found.crossJoin(block).withColumn("r", F.greatest("r", most)).drop("rows")
    return found.agg(F.avg("r").alias("davies_bouldin"))


def _cells(n: int) -> tuple[int, int]:
    """Row groups and column groups of the pairs of ``n`` points."""
    return max(1, -(-n // min(ROWS, max(512, n // 16)))), max(1, -(-n // COLUMNS))


def silhouettes(points: DataFrame, key: str = "key", sample: int | None = SAMPLE, seed: int = 42) -> DataFrame:
    """``key``, ``cluster_id`` and Euclidean silhouette ``s`` of all points (``sample`` is None) or of a seeded sample of them; single members get 0."""
    return silhouettes_of(points, ["cluster_id"], key, sample, seed).select(key, "cluster_id", F.col("scores")[0].alias("s"))


def silhouettes_of(points: DataFrame, partitions: Sequence[str], key: str = "key", sample: int | None = SAMPLE, seed: int = 42) -> DataFrame:
    """``key``, the columns ``partitions`` (cluster ids of several partitions of the same points) and ``scores``, the silhouettes in each of them.

    All pairs are compared, in cells and once for all partitions: points are dealt into row groups and column groups by hash, and the task of a cell holds its
    columns (``COLUMNS`` at most, about) and reads its rows one piece after the other.  It passes on one sum of distances for each row and cluster; these are
    added by key.  Nothing but the sizes of the clusters is broadcast, and a point travels to as many cells as there are groups of the other kind.
    """
    own_ids = F.array(*[F.col(c).cast("long") for c in partitions]).alias("clusters")
    chosen = points.select(key, own_ids, doubles(F.col("vector")).alias("vector"))
    if sample is not None:
        chosen = chosen.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample)
    staging = Staging(points.sparkSession, "silhouettes")
    fixed = placed(staging.write(chosen, "points"))
    point = F.struct(FILE, ROW)
    sizes: list[dict[int, int]] = [{} for _ in partitions]
    for r in fixed.select(F.posexplode("clusters").alias("part", "cluster_id")).groupBy("part", "cluster_id").agg(F.count("*").alias("n")).collect():  # one row for each cluster
        sizes[r.part][r.cluster_id] = r.n
    ids = [np.array(sorted(s), np.int64) for s in sizes]
    start = np.cumsum([0, *map(len, ids)])  # clusters of all partitions, one partition after the other
    count = np.array([s[c] for s, i in zip(sizes, ids, strict=True) for c in i.tolist()], float)
    n = sum(sizes[0].values())
    rows, columns = _cells(n)
    hashed = fixed.withColumn("own", F.pmod(F.xxhash64(F.lit(seed), FILE, ROW), F.lit(rows))).withColumn("other", F.pmod(F.xxhash64(F.lit(seed + 1), FILE, ROW), F.lit(columns)))
    cell = lambda r, c: (r * columns + c).cast("int").alias("cell")
    line = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = hashed.withColumn("r", line(rows)).select(cell(F.col("r"), F.col("other")), F.lit(0).alias("side"), F.lit(None).cast(f"struct<{FILE}:string,{ROW}:bigint>").alias("point"), "clusters", "vector")
    read = hashed.withColumn("c", line(columns)).select(cell(F.col("own"), F.col("c")), F.lit(1).alias("side"), point.alias("point"), "clusters", "vector")
    met = held.unionByName(read).repartition(rows * columns, "cell").sortWithinPartitions("cell", "side")

    def places(clusters: pa.Array) -> np.ndarray:
        """Place of each row's cluster among all clusters, a column for each partition."""
        found = clusters.flatten().to_numpy().reshape(len(clusters), -1)
        return np.column_stack([np.searchsorted(i, found[:, j]) + start[j] for j, i in enumerate(ids)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, matrix = None, [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cut = np.append(np.flatnonzero(np.diff(2 * cells + sides, prepend=-1)), len(cells))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if cells[lo] != now:
                    now, parts, matrix = cells[lo], [], None
                x = part.column("vector").flatten().to_numpy().reshape(hi - lo, -1)
                if not sides[lo]:
                    parts.append((x, places(part.column("clusters"))))
                    continue
                if matrix is None:
                    if not parts:
                        continue
                    # columns in the order of their clusters; those with the same clusters in all partitions are added together first
                    kinds, number = np.unique(np.concatenate([o for _, o in parts]), axis=0, return_inverse=True)
                    number = number.ravel()
                    order = np.argsort(number, kind="stable")
                    matrix = np.concatenate([p for p, _ in parts])[order]
                    edge = np.flatnonzero(np.diff(number[order], prepend=-1))
                    matrix = np.column_stack([-2 * matrix, np.ones(len(matrix)), (matrix**2).sum(1)]).T
                    spread = np.zeros((len(kinds), len(count)))
                    spread[np.arange(len(kinds))[:, None], kinds] = 1
                for k in range(0, hi - lo, 32):
                    y = x[k : k + 32]
                    d = np.column_stack([y, (y**2).sum(1), np.ones(len(y))]) @ matrix
                    d *= d >= 1e-14  # the rounding of equal points
                    np.sqrt(d, out=d)
                    sums = np.add.reduceat(d, edge, axis=1) @ spread
                    at = pa.array(np.arange(0, sums.size + 1, len(count), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("point").slice(k, len(y)), pa.ListArray.from_arrays(at, pa.array(sums.ravel()))], ["point", "sums"])

    found = met.mapInArrow(compare, f"point struct<{FILE}:string,{ROW}:bigint>, sums array<double>")
    total = found.groupBy("point").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    total = fixed.select(key, "clusters", FILE, ROW).join(total.select("point.*", "sums"), [FILE, ROW])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, own, i = batch.column("sums").flatten().to_numpy().reshape(len(batch), -1), places(batch.column("clusters")), np.arange(len(batch))
            scores = np.zeros((len(batch), len(ids)))
            for j in range(len(ids)):
                sums, size, mine = every[:, start[j] : start[j + 1]], count[start[j] : start[j + 1]], own[:, j] - start[j]
                a = sums[i, mine] / np.maximum(size[mine] - 1, 1)
                means = sums / size
                means[i, mine] = np.inf
                b = means.min(1)
                scores[:, j] = np.where((size[mine] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            at = pa.array(np.arange(0, scores.size + 1, len(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("clusters"), pa.ListArray.from_arrays(at, pa.array(scores.ravel()))], [key, "clusters", "scores"])

    kind = points.schema[key].dataType.simpleString()
    scored = total.select(key, "clusters", "sums").mapInArrow(score, f"`{key}` {kind}, clusters array<long>, scores array<double>")
    return scored.select(key, *[F.col("clusters")[j].alias(c) for j, c in enumerate(partitions)], "scores")


def silhouette(points: DataFrame, key: str = "key", sample: int | None = SAMPLE) -> DataFrame:
    return silhouettes(points, key, sample).agg(F.avg("s").alias("silhouette"))


def silhouette_groups(scores: DataFrame) -> DataFrame:
    """Sorted scores and their mean for each cluster (of a sample)."""
    return scores.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.round("s", 6))).alias("scores"), F.round(F.avg("s"), 6).alias("mean"))


def bundle(points: DataFrame, key: str = "key", sample: int | None = SAMPLE) -> DataFrame:
    """One row: silhouette (4 digits, never a negative zero), Calinski-Harabasz (2), Davies-Bouldin (4), purity (4)."""
    return _bundle(points, silhouette(points, key, sample))


def _bundle(points: DataFrame, score: DataFrame) -> DataFrame:
    groups = within(points)
    row = score
    for p in (calinski_harabasz(points, groups), davies_bouldin(points, groups), purity(points)):
        row = row.crossJoin(F.broadcast(p))  # one row each
    return row.select((F.round("silhouette", 4) + 0.0).alias("silhouette"), F.round("calinski_harabasz", 2).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"), "purity")


def bundles(points: DataFrame, partitions: Sequence[str], key: str = "key", sample: int | None = SAMPLE) -> list[DataFrame]:
    """The ``bundle`` of each of several partitions of ``points`` (columns of cluster ids); distances for their silhouettes are computed once."""
    scores = silhouettes_of(points, partitions, key, sample)
    means = scores.agg(*[F.avg(F.col("scores")[j]).alias(f"s{j}") for j in range(len(partitions))]).collect()[0]
    one = lambda s: points.sparkSession.createDataFrame([(s,)], "silhouette double")
    return [_bundle(points.withColumn("cluster_id", F.col(c)), one(s)) for c, s in zip(partitions, means, strict=True)]


def medoids(points: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """The point nearest to each centroid (ties: the first in ``order``, else the smallest key)."""
    d = distance(F.col("vector"), F.col("centroid"))
    near = F.min(F.struct(F.round(d, 9).alias("d"), F.col(order or key).alias("at"), F.col(key).alias("k"))).alias("best")
    return points.join(few(centroids(points)), "cluster_id").groupBy("cluster_id").agg(near).select("cluster_id", F.col("best.k").alias("medoid"))


def first_keys(points: DataFrame, key: str = "key", n: int = 5, order: str | None = None) -> DataFrame:
    """The first ``n`` keys of each cluster in ``order`` (else the smallest).  Keys are ranked in salted parts first, so that no task ranks a whole cluster."""
    at = [order, key] if order else [key]
    part = W.partitionBy("cluster_id", "salt").orderBy(*at)
    some = points.select("cluster_id", *dict.fromkeys(at)).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= n)
    listed = F.slice(F.array_sort(F.collect_list(F.struct(F.col(at[0]).alias("at"), F.col(key).alias("k")))), 1, n)  # 64 * n at most
    return some.groupBy("cluster_id").agg(F.transform(listed, lambda x: x["k"]).alias("samples"))


#: Labels of a cluster that its map in a profile holds; more of them stay rows (``label_counts``).
MOST_LABELS = 10_000


def profiles(points: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """Size, share, dominant label, purity, label counts, medoid and five samples of each cluster.

    ``order`` is a column that says which row comes first (``sources.tables.Table.in_order`` adds the load order); it decides between equal labels and
    distances, and which rows are samples.  Without it keys and labels decide.  A cluster of more than ``MOST_LABELS`` labels has a null map.
    """
    top = dominant(points, order)
    total = top.agg(F.sum("size").alias("total"))
    counts = label_counts(points)
    kinds = counts.groupBy("cluster_id").agg(F.count("*").alias("kinds")).where(F.col("kinds") <= MOST_LABELS).select("cluster_id")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), "n"))))
    spread = counts.join(kinds, "cluster_id", "left_semi").groupBy("cluster_id").agg(entries.alias("label_distribution"))
    table = top.crossJoin(F.broadcast(total)).join(spread, "cluster_id", "left").join(medoids(points, key, order), "cluster_id").join(first_keys(points, key, order=order), "cluster_id")
    return table.select(
        "cluster_id", "size", F.round(F.col("size") * 100.0 / F.col("total"), 2).alias("percentage"), "dominant_label", F.round(F.col("n_dominant") / F.col("size"), 4).alias("dominant_purity"),
        "label_distribution", F.col("medoid").alias("medoid_filename"), F.col("samples").alias("sample_filenames"),
    )


def k_votes(table: DataFrame) -> DataFrame:
    """Votes of each k: silhouette 3 and Calinski-Harabasz 2 for their maxima, Davies-Bouldin 1 for its minimum; first k on ties."""
    best = lambda c, sign: F.max_by("k", F.struct(sign * F.col(c), -F.col("k")))
    row = table.agg(best("silhouette", 1).alias("s"), best("calinski_harabasz", 1).alias("c"), best("davies_bouldin", -1).alias("d"))
    return row.select(F.expr("stack(3, s, 3, c, 2, d, 1) AS (k, votes)")).groupBy("k").agg(F.sum("votes").cast("long").alias("votes"))


def recommended_k(table: DataFrame) -> DataFrame:
    """The k with most votes; the smaller one on ties."""
    return k_votes(table).agg(F.max_by("k", F.struct("votes", -F.col("k"))).alias("k"))


def k_curve(metadata: DataFrame) -> DataFrame:
    """One row for each k of a search record, with the recommended one marked."""
    return metadata.select(F.explode("results").alias("r"), F.col("recommendation.k").alias("best")).select("r.*", (F.col("r.k") == F.col("best")).alias("is_best"))


def sorted_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``values`` of each group in order, each once (labels and the like: few for a group)."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("values"))


def latest(table: DataFrame, order: Column | list[Column], n: int, then: str) -> DataFrame:
    """The ``n`` latest rows, sorted by ``then``."""
    return table.orderBy(order).limit(n).orderBy(then)
