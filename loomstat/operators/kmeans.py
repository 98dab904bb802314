"""k-means with restarts, the inertia and silhouette sweeps, and the automatic k.

All models of a run (every k, every restart) advance together: one pass over the rows updates
all of them, so a sweep over ten k with five restarts reads the data as often as its slowest
model needs, not fifty times as often. Starts come from one set of candidates drawn over all rows in
rounds, each row with the weight of its squared distance to those drawn before (k-means||), weighted
by the rows nearest to them, so copies of a row neither crowd out others nor are overlooked. The
result is a fixed point of the full data. A pass leaves one partial sum per (model, cluster,
coordinate) and partition. Only candidates and centres ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .evaluate import silhouettes
from .neighbors import stack

# Fixed values of the clustering rules.
SEED = 42
RESTARTS = 10
SWEEP_RESTARTS = 5
MAX_SWEEP = 10
MAX_CLUSTERS = 15
MIN_ROWS_FOR_SWEEP = 10
DEFAULT_K = 2

MAX_ITERATIONS = 300
TOLERANCE = 1e-4
START_ROUNDS = 5
DRAWN_PER_CENTER = 4


@dataclass
class KMeansFit:
    k: int
    inertia: float
    centers: np.ndarray            # ordered by first, second, ... coordinate

    def labels(self, df: DataFrame, key: str, features: str = "features") -> DataFrame:
        """(key, cluster): the nearest centre of each row, one pass without a shuffle."""
        centers = self.centers

        def assign(batches):
            for pdf in batches:
                got = nearest(stack(pdf["__vec"]), centers)[0] if len(pdf) else []
                yield pd.DataFrame({key: pdf[key], "cluster": np.asarray(got, dtype="int32")})

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, F.col(features).alias("__vec")).mapInPandas(
            assign, f"`{key}` {kind}, cluster int")


def clamp_k(k: int, rows: int) -> int:
    """Between 2 and 15, and at most half the rows; fewer than 4 rows cannot be clustered."""
    if rows < 4:
        raise ValueError("clustering needs at least 4 rows")
    return min(max(2, k), min(MAX_CLUSTERS, rows // 2))


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the closest centre of each row."""
    norms = (centers * centers).sum(axis=1)
    label = (norms - 2.0 * (x @ centers.T)).argmin(axis=1)
    gap = x - centers[label]
    return label, (gap * gap).sum(axis=1)


def spread_start(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over weighted points: each further centre is drawn with the weight of its points
    times their squared distance."""
    picked = [x[rng.choice(len(x), p=weight / weight.sum())]]
    gap = ((x - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k:
        mass = gap * weight
        at = rng.choice(len(x), p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(len(x))
        picked.append(x[at])
        gap = np.minimum(gap, ((x - x[at]) ** 2).sum(axis=1))
    return np.array(picked)


def settle(x: np.ndarray, weight: np.ndarray, centers: np.ndarray, stop: float, limit: int) -> np.ndarray:
    """Move centres on the weighted candidates, so that few passes over all rows remain."""
    for _ in range(limit):
        label = nearest(x, centers)[0]
        size = np.bincount(label, weights=weight, minlength=len(centers))[:, None]
        total = np.stack([np.bincount(label, weights=weight * x[:, j], minlength=len(centers))
                          for j in range(x.shape[1])], axis=1)
        new = np.where(size > 0, total / np.where(size > 0, size, 1.0), centers)
        moved = ((new - centers) ** 2).sum()
        centers = new
        if moved <= stop:
            break
    return centers


def _draw(vec: DataFrame, known: np.ndarray | None, wanted: int, seed: int) -> np.ndarray:
    """Up to ``wanted`` rows, drawn without replacement with the weight of their squared distance to
    the known candidates. Every task keeps its rows with the largest keys, the largest of all win."""

    def keyed(batches):
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        best = pd.DataFrame({"rank": pd.Series(dtype="float64"), "vec": pd.Series(dtype="object")})
        for pdf in batches:
            if not len(pdf):
                continue
            x = stack(pdf["vec"])
            weight = np.ones(len(x)) if known is None else nearest(x, known)[1]
            draws = rng.random(len(x))
            with np.errstate(divide="ignore"):
                rank = np.where(weight > 0, np.log(draws) / weight, -np.inf)
            pdf = pd.DataFrame({"rank": rank, "vec": list(x)})
            best = pd.concat([best, pdf[pdf["rank"] > -np.inf]]).nlargest(wanted, "rank")
        yield best

    top = (vec.mapInPandas(keyed, "rank double, vec array<double>")
           .orderBy(F.desc("rank"), "vec").limit(wanted).collect())
    return np.array([r.vec for r in top], dtype="float64")


def candidates(vec: DataFrame, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights): candidates for starts of up to ``most`` centres, drawn over all rows."""
    points = _draw(vec, None, 1, seed)
    if not len(points):
        raise ValueError("no rows to cluster")
    for turn in range(START_ROUNDS):
        drawn = _draw(vec, points, DRAWN_PER_CENTER * most, seed + turn + 1)
        if not len(drawn):
            break                                       # every row is a candidate
        points = np.unique(np.concatenate([points, drawn]), axis=0)
    return points, _advance(vec, {0: points})[2][0]


def _advance(vec: DataFrame, models: dict[int, np.ndarray]) -> tuple[dict, dict, dict]:
    """One pass: new centres, the cost under the old ones and the rows of each, per model."""

    def partial(batches):
        sums = {m: np.zeros((len(c), c.shape[1] + 2)) for m, c in models.items()}
        for pdf in batches:
            if not len(pdf):
                continue
            x = stack(pdf["vec"])
            for m, c in models.items():
                label, gap = nearest(x, c)
                k, total = len(c), sums[m]
                for j in range(x.shape[1]):
                    total[:, j] += np.bincount(label, weights=x[:, j], minlength=k)
                total[:, -2] += np.bincount(label, minlength=k)
                total[:, -1] += np.bincount(label, weights=gap, minlength=k)
        for m, total in sums.items():
            held = np.flatnonzero(total[:, -2])
            yield pd.DataFrame({
                "model": np.int32(m), "cluster": np.repeat(held, total.shape[1]).astype("int32"),
                "slot": np.tile(np.arange(total.shape[1], dtype="int32"), len(held)),
                "value": total[held].ravel()})

    rows = (vec.mapInPandas(partial, "model int, cluster int, slot int, value double")
            .groupBy("model", "cluster", "slot").agg(F.sum("value").alias("value")).collect())
    totals = {m: np.zeros((len(c), c.shape[1] + 2)) for m, c in models.items()}
    for r in rows:
        totals[r.model][r.cluster, r.slot] = r.value
    centers, costs, sizes = {}, {}, {}
    for m, t in totals.items():
        held = t[:, -2:-1] > 0
        centers[m] = np.where(held, t[:, :-2] / np.where(held, t[:, -2:-1], 1.0), models[m])
        costs[m] = float(t[:, -1].sum())
        sizes[m] = t[:, -2]
    return centers, costs, sizes


def fit_all(df: DataFrame, jobs: list[tuple[int, int]], features: str = "features",
            max_iterations: int = MAX_ITERATIONS) -> list[KMeansFit]:
    """One fit per (k, seed), all advanced by the same passes."""
    vec = df.select(F.col(features).cast("array<double>").alias("vec"))
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        points, weight = candidates(vec, max(k for k, _ in jobs), min(seed for _, seed in jobs))
        middle = np.average(points, axis=0, weights=weight)
        stop = TOLERANCE * float(np.average((points - middle) ** 2, axis=0, weights=weight).mean())
        models = {i: settle(points, weight, spread_start(points, weight, k, np.random.default_rng(seed)),
                            stop, max_iterations) for i, (k, seed) in enumerate(jobs)}
        moving = set(models)
        for _ in range(max_iterations):
            new, _cost, _size = _advance(vec, {m: models[m] for m in moving})
            for m in list(moving):
                if ((new[m] - models[m]) ** 2).sum() <= stop:
                    moving.discard(m)
                models[m] = new[m]
            if not moving:
                break
        _last, costs, _size = _advance(vec, models)
    finally:
        vec.unpersist()
    fits = []
    for i, (k, _seed) in enumerate(jobs):
        c = models[i]
        fits.append(KMeansFit(k, costs[i], c[np.lexsort(c.T[::-1])]))
    return fits


def fit_kmeans(df: DataFrame, k: int, features: str = "features", restarts: int = RESTARTS,
               seed: int = SEED) -> KMeansFit:
    """The cheapest of several starts."""
    fits = fit_all(df, [(k, seed + i) for i in range(restarts)], features)
    return min(fits, key=lambda f: f.inertia)


def sweep(df: DataFrame, ks: list[int], features: str = "features",
          restarts: int = SWEEP_RESTARTS, seed: int = SEED) -> dict[int, KMeansFit]:
    """Best fit per k; the same fits serve the inertia and the silhouette curve."""
    best: dict[int, KMeansFit] = {}
    for f in fit_all(df, [(k, seed + i) for k in ks for i in range(restarts)], features):
        if f.k not in best or f.inertia < best[f.k].inertia:
            best[f.k] = f
    return best


def inertia_table(fits: dict[int, KMeansFit], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f.inertia) for k, f in sorted(fits.items())],
                                 "k int, inertia double")


def inertia_given_labels(points: DataFrame, features: str = "features",
                         label: str = "cluster") -> DataFrame:
    """Sum of squared distances to the cluster mean, from per-cluster moments in one pass."""
    vec = array_to_vector(F.col(features).cast("array<double>"))
    stats = points.select(F.col(label).alias("cluster"), vec.alias("v")).groupBy("cluster").agg(
        F.count("*").alias("n"), Summarizer.variance(F.col("v")).alias("s"))
    scatter = F.aggregate(vector_to_array("s"), F.lit(0.0), lambda acc, v: acc + v) * (F.col("n") - 1)
    return stats.agg(F.sum(scatter).alias("inertia"))


def elbow_k(curve: DataFrame) -> DataFrame:
    """(elbow_k): where the second difference of (k, inertia) is largest, ties to the smaller k.

    The curve has at most ten rows, so its window runs over a tiny table.
    """
    at = Window.orderBy("k")
    bends = curve.withColumn("bend", F.abs(
        F.lead("inertia").over(at) - 2 * F.col("inertia") + F.lag("inertia").over(at)))
    best = F.min_by("k", F.struct(-F.col("bend"), F.col("k")))
    return bends.filter(F.col("bend").isNotNull()).agg(
        F.coalesce(best, F.lit(DEFAULT_K)).cast("int").alias("elbow_k"))


def label_all(df: DataFrame, key: str, fits: list[KMeansFit], features: str = "features") -> DataFrame:
    """(key, features, labels): the cluster of each row in every fit, in one pass."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = stack(pdf[features])
                each = np.column_stack([nearest(x, f.centers)[0] for f in fits])
                yield pdf.assign(labels=list(each.astype("int32")))

    rows = df.select(F.col(key), F.col(features).cast("array<double>").alias(features))
    return rows.mapInPandas(run, f"`{key}` {kind}, `{features}` array<double>, labels array<int>")


def silhouette_sweep(df: DataFrame, key: str, fits: dict[int, KMeansFit],
                     features: str = "features") -> DataFrame:
    """(k, silhouette) for every fitted k above 1; an undefined score counts as 0. The distances are
    measured once for all k."""
    ks = sorted(k for k in fits if k >= 2)
    if not ks:
        return df.sparkSession.createDataFrame([], "k int, silhouette double")
    labelled = label_all(df, key, [fits[k] for k in ks], features)
    found = {r.labeling: r.silhouette for r in silhouettes(labelled, key, "labels", features).collect()}
    return df.sparkSession.createDataFrame([(k, float(found.get(i) or 0.0)) for i, k in enumerate(ks)], "k int, silhouette double")


def combine_k(elbow: int, silhouette: int, largest: int) -> int:
    return max(2, min(int((elbow + silhouette) / 2), largest))


def optimal_k(df: DataFrame, key: str, features: str = "features",
              largest: int = MAX_SWEEP) -> DataFrame:
    """(optimal_k, elbow_k, silhouette_k): one row."""
    spark = df.sparkSession
    schema = "optimal_k int, elbow_k int, silhouette_k int"
    rows = df.count()
    if rows < MIN_ROWS_FOR_SWEEP:
        return spark.createDataFrame([(DEFAULT_K, DEFAULT_K, DEFAULT_K)], schema)
    largest = min(largest, rows // 2)
    fits = sweep(df, list(range(1, largest + 1)), features)
    elbow = elbow_k(inertia_table(fits, spark)).first()[0]
    scores = silhouette_sweep(df, key, fits, features)
    best = scores.agg(F.min_by("k", F.struct(-F.col("silhouette"), F.col("k")))).first()[0] or DEFAULT_K
    return spark.createDataFrame([(combine_k(elbow, best, largest), elbow, best)], schema)


def nearest_center(df: DataFrame, key: str, centers: dict[int, list[float]],
                   features: str = "features", keep_features: bool = False) -> DataFrame:
    """(key, cluster, distance) of the closest of k given centres, ties to the smaller number."""
    def gap(c: list[float]):
        return F.sqrt(F.aggregate(
            F.zip_with(features, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0), lambda acc, v: acc + v))
    best = F.array_min(F.array(*[
        F.struct(gap(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in sorted(centers.items())]))
    kept = [features] if keep_features else []
    return df.select(key, *kept, best.alias("b")).select(key, *kept, "b.cluster", "b.distance")
