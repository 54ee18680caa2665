"""Standardisation and PCA on ``pyspark.ml``, KMeans with restarts, and the search for k."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles

# Defaults of the clustering pipeline.
K_DEFAULT = 5
K_RANGE = tuple(range(2, 13))
PCA_COMPONENTS = 512
RESTARTS = 20
MAX_ITERATIONS = 500
SEED = 42
#: Rows on which k-means++ chooses first centres, and the shift of a centre at which a model rests.
SEED_ROWS = 5000
TOLERANCE = 1e-4


def column_moments(points: DataFrame) -> DataFrame:
    """Mean and population deviation of each dimension."""
    long = points.select(F.posexplode(doubles(F.col("vector"))).alias("d", "x"))
    return long.groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardised(points: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Columns to mean 0 and population deviation 1; columns without spread are only centred."""
    moments = column_moments(points) if moments is None else moments
    listed = moments.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std")))), lambda s: F.struct(s["mean"].alias("mean"), s["std"].alias("std"))).alias("moments"))
    fresh = F.zip_with(doubles(F.col("vector")), F.col("moments"), lambda x, m: (x - m["mean"]) / m["std"])
    return points.crossJoin(F.broadcast(listed)).withColumn("vector", fresh).drop("moments")  # one row


def pca_pipeline(points: DataFrame, k: int = PCA_COMPONENTS, scale: bool = True) -> PipelineModel:
    """Standardise (or only centre) and project; k is clamped to the number of rows and dimensions.

    ``StandardScaler`` divides by the sample deviation; against the population form all columns are off by one common factor,
    which the projection keeps.
    """
    first = points.select(F.size("vector").alias("d")).first()
    if first is None:
        raise ValueError("no vectors")
    k = max(1, min(k, first.d, points.count()))
    scaler = StandardScaler(inputCol="ml", outputCol="scaled", withMean=True, withStd=scale)
    return Pipeline(stages=[scaler, PCA(k=k, inputCol="scaled", outputCol="projected")]).fit(_ml(points))


def _ml(points: DataFrame) -> DataFrame:
    return points.withColumn("ml", array_to_vector(doubles(F.col("vector"))))


def projected(points: DataFrame, model: PipelineModel) -> DataFrame:
    """``points`` with the projected vector; each component's largest loading is made positive."""
    loadings = model.stages[-1].pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    out = model.transform(_ml(points)).withColumn("vector", vector_to_array("projected"))
    flip = F.array(*[F.lit(float(s)) for s in signs])
    return out.withColumn("vector", F.zip_with("vector", flip, lambda x, s: x * s)).drop("ml", "scaled", "projected")


def explained(model: PipelineModel) -> float:
    return float(model.stages[-1].explainedVariance.toArray().sum())


def pca_2d(points: DataFrame, sample: int = 5000, seed: int = SEED) -> DataFrame:
    """Two components without scaling, of a seeded sample."""
    some = points.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(sample)
    flat = projected(some, pca_pipeline(some, 2, scale=False))
    return flat.withColumn("x", F.col("vector")[0]).withColumn("y", F.try_element_at("vector", F.lit(2))).drop("vector")


@dataclass(frozen=True)
class Fit:
    """Centres of one model and what its last pass over the points found for each of them."""

    centres: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @property
    def cost(self) -> float:
        return float(self.squares.sum())


def _spread_seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on a sample."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = _far(x, centres).min(1)
        pick = rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[pick]])
    return centres


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["model", "totals"])


#: Points that a step compares at once with all centres of one k; distances and memberships of a block stay in a core's cache.
BLOCK = 512


def _stacked(models: dict[int, np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """Models of one k together, as (k, models, dimensions)."""
    by_k: dict[int, list[int]] = {}
    for m, c in models.items():
        by_k.setdefault(len(c), []).append(m)
    return [(ids, np.stack([models[m] for m in ids], 1)) for ids in by_k.values()]


def _pass(points: DataFrame, models: dict[int, np.ndarray], around: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """One pass over ``points`` for all ``models`` (centres): a row (size, squared norms, sums ...) for each centre.

    With ``around`` the second number is the sum of distances to those vectors instead.  Tasks send one row a model, which are added by model.
    All models of one k meet a block of points in one product of matrices, and their sums are a second one.
    """
    sent = points.sparkSession.sparkContext.broadcast((models, around))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, around = sent.value
        stacks = []
        for ids, c in _stacked(models):
            flat = c.reshape(-1, c.shape[2])
            stacks.append((ids, c.shape[0], np.column_stack([(flat**2).sum(1), np.zeros(len(flat)), -2 * flat]), np.zeros((len(flat), 2 + c.shape[2]))))
        seen = False
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                x = _matrix(batch.column("vector")[lo : lo + BLOCK])
                n = len(x)
                seen |= n > 0
                rows = np.column_stack([np.ones(n), (x**2).sum(1), x])
                for ids, k, weights, totals in stacks:
                    d = (weights @ rows.T).reshape(k, len(ids), n)  # squared distances, less the squared norm of the point
                    own = (d == d.min(0)).astype(float)
                    if own.sum() != len(ids) * n:  # equally near centres: the first
                        own = (d.argmin(0) == np.arange(k)[:, None, None]).astype(float)
                    totals += own.reshape(-1, n) @ rows
                    if around is not None:
                        for j, m in enumerate(ids):
                            far = np.sqrt(((x - around[m][own[:, j].argmax(0)]) ** 2).sum(1))
                            totals.reshape(k, len(ids), -1)[:, j, 1] += own[:, j] @ (far - rows[:, 1])
        if seen:
            yield _packed({m: totals.reshape(k, len(ids), -1)[:, j] for ids, k, _, totals in stacks for j, m in enumerate(ids)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, blob in zip(batch.column("model").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                totals[m] = totals.get(m, 0) + np.frombuffer(blob)
        yield _packed(totals)

    schema = "model int, totals binary"
    rows = points.mapInArrow(work, schema).repartition("model").mapInArrow(added, schema).collect()  # a row for each model
    sent.unpersist()
    return {r.model: np.frombuffer(r.totals).reshape(models[r.model].shape[0], -1) for r in rows}


def _stepped(centres: np.ndarray, t: np.ndarray) -> tuple[Fit, np.ndarray]:
    """What a pass found for ``centres``, and the centres of the next step; an empty cluster keeps its centre."""
    squares = np.maximum(t[:, 1] - 2 * (centres * t[:, 2:]).sum(1) + t[:, 0] * (centres**2).sum(1), 0)
    return Fit(centres, t[:, 0], t[:, 2:], squares), np.where(t[:, :1] > 0, t[:, 2:] / np.maximum(t[:, :1], 1), centres)


def _fits(points: DataFrame, ks: Sequence[int], restarts: int, iterations: int, seed: int, seeds: np.ndarray) -> dict[int, Fit]:
    """The fit of least cost for each k.  All models of all k take their Lloyd steps together, one pass over the points a step, until they rest."""
    models = {i: _spread_seeds(seeds, k, seed + r) for i, (k, r) in enumerate((k, r) for k in ks for r in range(restarts))}
    moving, done = dict(models), {}
    for _ in range(iterations):
        for m, t in _pass(points, moving).items():
            done[m], new = _stepped(models[m], t)
            if np.sqrt(((new - models[m]) ** 2).sum(1)).max() <= TOLERANCE:
                del moving[m]
            else:
                models[m] = moving[m] = new
        if not moving:
            break
    return {k: min((done[i * restarts + r] for r in range(restarts)), key=lambda f: f.cost) for i, k in enumerate(ks)}


def _sample(points: DataFrame, sample: int, seed: int) -> np.ndarray:
    """A matrix of ``sample`` rows at most, by hash order."""
    rows = points.select(doubles(F.col("vector")).alias("vector")).orderBy(F.xxhash64(F.lit(seed), "vector")).limit(sample).collect()
    return np.array([r.vector for r in rows], float).reshape(len(rows), -1)


def kmeans(points: DataFrame, k: int = K_DEFAULT, restarts: int = RESTARTS, iterations: int = MAX_ITERATIONS, seed: int = SEED) -> Fit:
    """The fit of least cost over ``restarts`` seedings (k-means++ on ``SEED_ROWS`` rows at most; all points take part in every step)."""
    seeds = _sample(points, SEED_ROWS, seed)
    data = points.select(doubles(F.col("vector")).alias("vector")).persist()
    try:
        return _fits(data, [k], restarts, iterations, seed, seeds)[k]
    finally:
        data.unpersist()


def settled(points: DataFrame, fit: Fit, steps: int = 10_000) -> Fit:
    """``fit`` after as many further Lloyd steps as it takes until no point changes its cluster.

    ``kmeans`` ends at shifts of ``TOLERANCE`` or after its iterations, when single points of a large table may still move.  Here a model rests when its
    centres stay the same but for the rounding of sums; a point that moves shifts a centre by its distance divided by the size of the cluster.
    """
    data = points.select(doubles(F.col("vector")).alias("vector")).persist()
    try:
        for _ in range(steps):
            fit, new = _stepped(fit.centres, _pass(data, {0: fit.centres})[0])
            if np.abs(new - fit.centres).max() <= 1e-13 * np.abs(new).max():
                break
            fit = Fit(new, fit.sizes, fit.sums, fit.squares)
        return fit
    finally:
        data.unpersist()


def centres_of(fit: Fit, spark) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fit.centres)], "cluster_id int, centroid array<double>")


def assigned(points: DataFrame, fit: Fit) -> DataFrame:
    from .metrics import nearest

    return nearest(points, centres_of(fit, points.sparkSession)).drop("distance")


def lloyd(points: DataFrame, seeds: DataFrame, iterations: int) -> DataFrame:
    """``points`` with ``cluster_id`` after so many Lloyd steps from the centroids ``seeds`` (``cluster_id``, ``centroid``)."""
    from .metrics import centroids, nearest

    centres = seeds
    out = nearest(points, centres)
    for _ in range(iterations - 1):
        rows = centroids(out).collect()  # k rows
        centres = points.sparkSession.createDataFrame([(r.cluster_id, r.centroid) for r in rows], seeds.schema)
        out = nearest(points, centres)
    return out


def _silhouette(x: np.ndarray, own: np.ndarray, k: int) -> float:
    size, s = np.bincount(own, minlength=k), []
    for i in range(0, len(x), 512):
        d = np.sqrt(_far(x[i : i + 512], x))
        sums = np.stack([d[:, own == c].sum(1) for c in range(k)], 1)
        rows, mine = np.arange(len(d)), own[i : i + 512]
        a = sums[rows, mine] / np.maximum(size[mine] - 1, 1)
        mean = sums / np.maximum(size, 1)
        mean[:, size == 0] = np.inf
        mean[rows, mine] = np.inf
        b = mean.min(1)
        s.append(np.where((size[mine] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0))
    return float(np.concatenate(s).mean())


def _separation(fit: Fit, means: np.ndarray, spread: np.ndarray) -> tuple[float, float]:
    """Calinski-Harabasz and Davies-Bouldin from what is known of each cluster."""
    full = fit.sizes > 0
    n, k, size, centre = fit.sizes.sum(), int(full.sum()), fit.sizes[full], means[full]
    overall = fit.sums.sum(0) / n
    inside = (fit.squares[full] - size * ((fit.centres[full] - centre) ** 2).sum(1)).sum()  # about the means, not the centres
    ch = ((size * ((centre - overall) ** 2).sum(1)).sum() / max(k - 1, 1)) / max(inside / max(n - k, 1), 1e-300)
    far = spread[full] / size
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    return float(ch), float(((far[:, None] + far[None]) / np.maximum(gap, 1e-300)).max(1).mean()) if k > 1 else 0.0


RESULT = "k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double, time_s double"


def k_search(points: DataFrame, ks: Sequence[int] = K_RANGE, restarts: int = RESTARTS, iterations: int = MAX_ITERATIONS, sample: int = 5000, seed: int = SEED) -> DataFrame:
    """Silhouette (of a sample), Calinski-Harabasz, Davies-Bouldin and inertia for each k.

    One way for tables of any size: the models of all k are fitted together, pass by pass over the distributed points.  ``time_s`` is an
    equal share of the run's time.
    """
    spark, began = points.sparkSession, time.perf_counter()
    n = points.count()
    ks = [k for k in ks if k < n]
    if not ks:
        return spark.createDataFrame([], RESULT)
    seeds, shown = _sample(points, SEED_ROWS, seed), _sample(points, sample, seed + 1)
    data = points.select(doubles(F.col("vector")).alias("vector")).persist()
    try:
        fits = _fits(data, ks, restarts, iterations, seed, seeds)
        means = {k: np.where(f.sizes[:, None] > 0, f.sums / np.maximum(f.sizes[:, None], 1), f.centres) for k, f in fits.items()}
        spread = _pass(data, {k: f.centres for k, f in fits.items()}, means)
    finally:
        data.unpersist()
    sent = spark.sparkContext.broadcast((shown, {k: f.centres for k, f in fits.items()}))  # a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, centres = sent.value
        for batch in batches:
            wanted = batch.column("k").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int32()), pa.array([_silhouette(x, _far(x, centres[k]).argmin(1), k) for k in wanted], pa.float64())], ["k", "s"])

    scored = dict(spark.createDataFrame([(k,) for k in ks], "k int").repartition(len(ks), "k").mapInArrow(run, "k int, s double").collect())
    share = (time.perf_counter() - began) / len(ks)
    return spark.createDataFrame([(k, scored[k], *_separation(f, means[k], spread[k][:, 1]), f.cost, share) for k, f in fits.items()], RESULT)
