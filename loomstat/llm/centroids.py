"""Exact integer clustering around centroids, with dot products kept up incrementally.

Every vector has its dot product with every centroid in a written table. A round changes few
centroids in few components; only those changes are multiplied with the vectors and added, and the
nearest centroid follows from |x|^2 - 2 x.c + |c|^2. All of it is integer arithmetic, so neither the
order of rows nor the number of rounds makes an error. A centroid's sum changes by the vectors that
came and went, so a round reads the components of those alone. The driver holds k centroids and k
sums, whatever the number of vectors.

Vectors take part if they have ``size`` components, none null or non-finite and none so large that
a 64-bit distance could overflow (2^27 after scaling). Equal vectors are separate rows; a null key
is an ordinary row, whose hash is that of the seed alone. Fewer than k vectors make fewer
centroids; an empty table stays empty. Sums of distances beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, discard

LARGEST = 1 << 27


def scaled(df: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(key, x): the vectors that take part, as integers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST / scale))
    kept = df.filter((F.size(v) == size) & fits)
    return kept.select(F.col(f"`{key}`").alias("key"), F.transform(v, lambda e: F.floor(e * scale).cast("int")).alias("x"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k rows whose keys have the smallest hashes; rows of one key by their components."""
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), width)


def _array(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def advance(state: DataFrame, change: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """The state under centroids that differ from those before by ``change`` (k x size): dot products
    moved on by the components that changed, then the nearest centroid anew. Without a column ``dots``
    the table is the vectors alone and every dot product begins at zero."""
    k, size = centroids.shape
    parts = [(j, np.flatnonzero(row), row[np.flatnonzero(row)]) for j, row in enumerate(change) if row.any()]
    norms = (centroids * centroids).sum(axis=1)
    begun = "dots" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.int64, size)
            dots = _matrix(batch.column(2), np.int64, k).copy() if begun else np.zeros((len(x), k), np.int64)
            for j, at, by in parts:
                dots[:, j] += x[:, at] @ by
            far = norms[None, :] - 2 * dots
            nearest = far.argmin(axis=1)                                    # the smallest number of equals
            distance = far[np.arange(len(x)), nearest] + (x * x).sum(axis=1)
            before = batch.column(3) if begun else pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _array(dots, pa.int64()), pa.array(nearest, pa.int32()), before,
                 pa.array(distance, pa.int64())], ["key", "x", "dots", "cluster", "before", "distance"])

    kind = state.schema["key"].dataType.simpleString()
    columns = ["key", "x", "dots", "cluster"] if begun else ["key", "x"]
    return state.select(*columns).mapInArrow(
        run, f"key {kind}, x array<int>, dots array<bigint>, cluster int, before int, distance bigint")


def sums_of_moved(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(k x size, k): what the vectors that changed their cluster add to its sums and counts, and
    take from those of the one they left. Merged in every task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            x = np.column_stack([_matrix(batch.column(0), np.int64, size), np.ones(batch.num_rows, np.int64)])
            np.add.at(total, np.asarray(batch.column(1)), x)
            left = np.asarray(batch.column(2).fill_null(-1))
            np.subtract.at(total, left[left >= 0], x[left >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], ["place", "value"])

    moved = state.filter(F.col("before").isNull() | (F.col("before") != F.col("cluster")))
    got = moved.select("x", "cluster", "before").mapInArrow(run, "place int, value bigint") \
        .groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k * (size + 1), np.int64)
    for r in got:
        total[r.place] = r.value
    total = total.reshape(k, size + 1)
    return total[:, :size], total[:, size]


def cluster(df: DataFrame, key: str, vector: str, size: int, k: int, rounds: int, scale: int = 1, seed: str = "") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector
    that takes part, after ``rounds`` moves of the centroids and a last assignment. The centroid is an
    array of integers; the hash is of its decimals joined by commas."""
    points = scaled(df, key, vector, size, scale)
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select(F.col("key").alias(key)).selectExpr(
            f"`{key}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia",
            "array(0L) as centroid", "'' as centroid_sha256").limit(0)
    k = len(centroids)
    state = cut_lineage(advance(points, centroids, centroids))
    sums, counts = np.zeros_like(centroids), np.zeros(k, np.int64)
    for _ in range(rounds):
        added, joined = sums_of_moved(state, k, size)
        sums, counts = sums + added, counts + joined
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        following = cut_lineage(advance(state, moved - centroids, moved))
        discard(state)
        state, centroids = following, moved
    return _report(state, centroids, key)


def _report(state: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    by_cluster = {r.cluster: r.total for r in state.groupBy("cluster").agg(total.alias("total")).collect()}
    every = sum(by_cluster.values())

    def long(value) -> int | None:
        return int(value) if value is not None and value < 1 << 63 else None

    rows = [(j, long(by_cluster.get(j)), long(every), [int(v) for v in c],
             hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = state.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string")
    # one row per centroid
    return state.select(F.col("key").alias(key), "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
