"""Cluster evaluation: silhouette, statistics, balance, label tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import q, side_by_side
from ..functions.keys import any_key, is_integral
from ..functions.ranking import math_ceil
from ..functions.text import text
from ..session import cut_lineage
from . import far
from .blocks import HELD, PAIRS, SWEEPS, matrix
from .clean import assign_row_id
from .neighbors import choose_pivots, distances, nearest_pivot, stack

ROWS_PER_TILE = 2_000
NUMBERS = 500_000       # distances measured at once
SUMMARY_CELLS = 512

# Fixed values of the balance rules.
IMBALANCE_WARNING = 0.2
IMBALANCE_REPORT = 0.3


def _score(sums: DataFrame) -> DataFrame:
    """(id, labeling, cluster, silhouette) from (id, labeling, own, cluster, total distance, rows) summed over all rows."""
    per = sums.groupBy("id", "labeling", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.col("cluster") == F.col("own")
    return _values(per.groupBy("id", "labeling", "own").agg(
        # the row itself adds distance 0 to its own cluster
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
        F.max(F.when(mine, F.col("n"))).alias("size")))


def _values(scored: DataFrame) -> DataFrame:
    """(id, labeling, cluster, silhouette) from (id, labeling, own, a, b, size)."""
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return scored.select("id", "labeling", F.col("own").alias("cluster"),
                         F.when(F.col("size") > 1, F.coalesce(value, F.lit(0.0)))
                         .otherwise(F.lit(0.0)).alias("silhouette"))


SUMS = pa.schema([("id", pa.int64()), ("labeling", pa.int32()), ("own", pa.int32()), ("cluster", pa.int32()),
                  ("total", pa.float64()), ("n", pa.int64())])


def straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by one product; those that it leaves to rounding are measured directly."""
    middle = b.mean(axis=0)
    p, o = a - middle, b - middle
    pp, oo = (p * p).sum(axis=1), (o * o).sum(axis=1)
    # one product gives p.p + o.o - 2 p.o
    out = np.column_stack([p, pp, np.ones(len(p))]) @ np.column_stack([-2.0 * o, np.ones(len(o)), oo]).T
    least = 1e-7 * max(float(pp.max(initial=0.0) + oo.max(initial=0.0)), 1e-300)
    i, j = np.nonzero(out <= least)
    np.maximum(out, 0.0, out=out)
    np.sqrt(out, out=out)
    step = max(1, PAIRS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        out[i[s:s + step], j[s:s + step]] = np.sqrt(((a[i[s:s + step]] - b[j[s:s + step]]) ** 2).sum(axis=1))
    return out


class _Totals:
    """Distance sums of the rows x to the clusters of all rows that are added, for every labeling; a row
    without a cluster in a labeling (NaN) neither asks nor answers in it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray):
        self.ids, self.x, self.own = ids, x, own
        self.place: list[dict[int, int]] = [{} for _ in range(own.shape[1])]     # of a cluster among the columns
        self.which: list[int] = []
        self.cluster: list[float] = []
        self.totals, self.sizes = np.zeros((len(x), 0)), np.zeros(0)

    def add(self, y: np.ndarray, labels: np.ndarray) -> None:
        at, columns = [], []
        for c, place in enumerate(self.place):
            for name in np.unique(labels[:, c][~np.isnan(labels[:, c])]):
                if name not in place:
                    place[name] = len(self.which)
                    self.which.append(c)
                    self.cluster.append(name)
                at.append(place[name])
                columns.append(labels[:, c] == name)
        if not at:
            return
        if more := len(self.which) - len(self.sizes):
            room = max(0, len(self.which) - self.totals.shape[1])
            if room:
                self.totals = np.hstack([self.totals, np.zeros((len(self.x), max(room, self.totals.shape[1])))])
            self.sizes = np.append(self.sizes, np.zeros(more))
        member = np.column_stack(columns).astype(float)
        self.sizes[at] += member.sum(axis=0)
        step = max(1, NUMBERS // len(y))
        for s in range(0, len(self.x), step):
            self.totals[s:s + step, at] += straight(self.x[s:s + step], y) @ member

    def tables(self, rows: int = 10_000):
        which, cluster = np.array(self.which, dtype=int), np.array(self.cluster)
        for s in range(0, len(self.x) if len(which) else 0, rows):
            asks = self.own[s:s + rows][:, which]
            i, c = np.nonzero(~np.isnan(asks))
            yield _table([[self.ids[s + i], which[c], asks[i, c], cluster[c], self.totals[s + i, c], self.sizes[c]]])


def _table(parts: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 6
    return pa.table([pa.array(c.astype(f.type.to_pandas_dtype(), copy=False), f.type) for c, f in zip(columns, SUMS)], schema=SUMS)


def _tile_sums(rows: DataFrame, n: int, rows_per_tile: int) -> DataFrame:
    """Distance sums per (row, labeling, cluster): the rows are cut into at most ``SWEEPS`` parts, or more if
    a part would exceed ``HELD`` rows; a task holds its part while all rows stream past, measures each
    distance once for all labelings, and gives one record per (row, labeling, cluster), never the pairs.
    A row is written once per part, however many rows there are."""
    tasks = max(1, min(SWEEPS, math_ceil(n, rows_per_tile)), math_ceil(n, HELD))
    part = F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(tasks - 1)), lambda t: F.struct(t.alias("task"), F.lit(True).alias("gives")))
    met = rows.withColumn("at", F.explode(F.concat(F.array(F.struct(part.alias("task"), F.lit(False).alias("gives"))), each))) \
        .select("id", "labels", "vec", "at.task", "at.gives").repartitionById(tasks, "task").sortWithinPartitions("gives") \
        .select("gives", "id", "labels", "vec")

    def run(batches):
        held, sums = [], None
        for batch in batches:
            ask = batch.num_rows - batch.column(0).true_count
            if ask:
                held.append(batch.slice(0, ask))
            if ask == batch.num_rows:
                continue
            if sums is None:
                if not held:
                    return
                t = pa.Table.from_batches(held).combine_chunks()
                sums = _Totals(t.column("id").to_numpy(), matrix(t.column("vec")), matrix(t.column("labels")))
            for s in range(ask, batch.num_rows, ROWS_PER_TILE):
                y = batch.slice(s, ROWS_PER_TILE)
                sums.add(matrix(y.column(3)), matrix(y.column(2)))
        if sums is not None:
            for t in sums.tables():
                yield from t.to_batches()

    return met.mapInArrow(run, "id long, labeling int, own int, cluster int, total double, n long")


def _exact(rows: DataFrame, rows_per_tile: int) -> DataFrame:
    """(id, labeling, cluster, silhouette) of rows (id, vec, labels): by a tree where many rows have few coordinates, else pair by pair."""
    n = rows.count()
    if not far.suits(rows, n):
        return _score(_tile_sums(rows, n, rows_per_tile))
    rows = cut_lineage(rows)
    each = rows.select("id", "vec", F.posexplode("labels").alias("labeling", "own"))
    return _values(each.join(far.nearness(rows), ["vec", "labeling", "own"]))


def _summary_sums(rows: DataFrame, cells: int) -> DataFrame:
    """Distance sums per (row, cluster) against cell centroids: linear in the rows.

    A cell's rows are replaced by their centroid times their number, which changes a mean
    distance by at most the mean cell radius. At most cells * clusters centroids are sent out.
    """
    pivots = choose_pivots(rows.select("id", "vec"), cells)
    celled = nearest_pivot(rows.select("id", "vec"), pivots).select("id", "cell")
    joined = rows.join(celled, "id")
    summary = joined.groupBy("own", "cell").agg(
        F.count("*").alias("n"), Summarizer.mean(array_to_vector("vec")).alias("m")).collect()
    owner = np.array([r.own for r in summary])
    weight = np.array([r.n for r in summary], dtype=float)
    centre = np.array([r.m.toArray() for r in summary])
    names = np.unique(owner)
    member = (owner[:, None] == names[None, :]) * weight[:, None]
    sizes = member.sum(axis=0)

    def batch(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            totals = distances(stack(pdf["vec"]), centre) @ member
            for j, c in enumerate(names):
                yield pd.DataFrame({"id": pdf["id"], "labeling": 0, "own": pdf["own"], "cluster": int(c),
                                    "total": totals[:, j], "n": int(sizes[j])})

    return rows.mapInPandas(batch, "id long, labeling int, own int, cluster int, total double, n long")


@any_key()
def silhouette_samples(points: DataFrame, key: str, features: str = "features",
                       label: str = "cluster", exclude_noise: bool = False,
                       method: str = "exact", rows_per_tile: int = ROWS_PER_TILE,
                       cells: int = SUMMARY_CELLS) -> DataFrame:
    """(key, cluster, silhouette) with Euclidean distances; a row alone in its cluster has 0.

    ``method`` "exact" costs n * n distance evaluations, or with one or two coordinates a number that grows
    with n (``far``; sums to about ten digits);
    "cells" measures against the centroids of ``cells`` cells per cluster instead, which is
    another, approximate number and is only used where it is asked for.
    """
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("own"),
                         F.col(features).cast("array<double>").alias("vec"))
    if exclude_noise:
        rows = rows.filter(F.col("own") != -1)
    if method not in ("exact", "cells"):
        raise ValueError(f"unknown method: {method}")
    scored = _exact(rows.select("id", "vec", F.array("own").alias("labels")), rows_per_tile) if method == "exact" \
        else _score(_summary_sums(rows, cells))
    return scored.drop("labeling").withColumnRenamed("id", key)


def silhouettes(points: DataFrame, key: str, labels: str, features: str = "features",
                rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """(labeling, silhouette): the mean score of each of several labelings, 0 with at most one cluster.

    ``labels`` is an array with one cluster per labeling, -1 for none. All labelings share one pass
    over the distances, and each score is the exact one.
    """
    table = points if is_integral(points, key) else assign_row_id(points.drop(key), key)
    some = F.transform(q(labels).cast("array<int>"), lambda c: F.when(c != -1, c))
    rows = cut_lineage(table.select(q(key).cast("long").alias("id"), q(features).cast("array<double>").alias("vec"), some.alias("labels")))
    scored = _exact(rows, rows_per_tile)
    several = F.count_distinct("cluster") > 1
    return scored.groupBy("labeling").agg(F.when(several, F.avg("silhouette")).otherwise(F.lit(0.0)).alias("silhouette"))


def silhouette_estimate(points: DataFrame, key: str, features: str = "features", label: str = "cluster",
                        sample: int = 2_000, z: float = 1.96) -> DataFrame:
    """(silhouette_score, low, high, measured): the mean exact silhouette of ``sample`` rows, drawn by hash
    from those with a cluster, against all rows, and the interval that holds the score of all rows with
    the confidence of ``z`` standard errors. Linear in the table; only the sample is sent to the tasks.
    """
    rows = points.select(F.xxhash64(q(key), F.lit(42)).alias("id"), q(label).cast("int").alias("own"),
                         q(features).cast("array<double>").alias("vec")).filter("own <> -1")
    drawn = rows.orderBy("id").limit(sample).collect()
    if not drawn:
        return points.sparkSession.createDataFrame([], "silhouette_score double, low double, high double, measured long")
    ids, own = np.arange(len(drawn)), np.array([r.own for r in drawn])
    x = np.array([r.vec for r in drawn], dtype="float64")

    def run(batches):
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            y, mine = matrix(batch.column(0)), np.asarray(batch.column(1))
            for c in np.unique(mine) if len(y) else []:
                part = y[mine == c]
                step = max(1, PAIRS // len(x))
                for s in range(0, len(part), step):
                    total[c] = total.get(c, 0.0) + straight(x, part[s:s + step]).sum(axis=1)
                count[c] = count.get(c, 0) + len(part)
        yield from _table([[ids, np.zeros(len(ids)), own, np.full(len(ids), c), t, np.full(len(ids), count[c])]
                           for c, t in total.items()]).to_batches()

    scored = _score(rows.select("vec", "own").mapInArrow(run, "id long, labeling int, own int, cluster int, total double, n long"))
    error = F.lit(z) * F.coalesce(F.stddev_samp("silhouette"), F.lit(0.0)) / F.sqrt(F.count("*"))
    return scored.agg(F.avg("silhouette").alias("silhouette_score"), error.alias("error"), F.count("*").alias("measured")).select(
        "silhouette_score", (F.col("silhouette_score") - F.col("error")).alias("low"),
        (F.col("silhouette_score") + F.col("error")).alias("high"), "measured")


def silhouette_score(samples: DataFrame) -> DataFrame:
    """One row: the mean silhouette, 0 when there is at most one cluster."""
    return samples.agg(
        F.when(F.count_distinct("cluster") > 1, F.avg("silhouette")).otherwise(F.lit(0.0))
        .alias("silhouette_score"))


def cluster_stats(points: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """(cluster, size, percentage, centroid, spread); noise counts in the percentage base only.

    spread is the mean over the dimensions of the population standard deviation.
    """
    vec = array_to_vector(F.col(features).cast("array<double>"))
    grouped = points.select(F.col(label).alias("cluster"), vec.alias("v")).groupBy("cluster").agg(
        F.count("*").alias("size"),
        Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s"))
    everything = F.sum("size").over(Window.partitionBy())      # one row per cluster
    # population variance from the sample variance
    shrink = (F.col("size") - 1) / F.col("size")
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0),
                         lambda acc, v: acc + F.sqrt(v * shrink)) / F.size("centroid")
    return grouped.withColumn("percentage", F.col("size") * 100.0 / everything) \
        .withColumn("centroid", vector_to_array("s.mean")).filter(F.col("cluster") != -1) \
        .select("cluster", "size", "percentage", "centroid", spread.alias("spread"))


def cluster_balance(stats: DataFrame) -> DataFrame:
    """(largest, smallest, balance, imbalanced, reported)."""
    return stats.agg(F.max("size").alias("largest"), F.min("size").alias("smallest")).select(
        "largest", "smallest", (F.col("smallest") / F.col("largest")).alias("balance")).withColumns(
        {"imbalanced": F.col("balance") < IMBALANCE_WARNING,
         "reported": F.col("balance") < IMBALANCE_REPORT})


def cluster_stats_table(stats: DataFrame) -> DataFrame:
    """The statistics as display text."""
    return stats.select(
        F.format_string("Cluster %s", F.col("cluster").cast("string")).alias("Cluster"),
        F.col("size").alias("Size"), text("%.1f%%", "percentage").alias("Percentage"),
        text("%.3f", "spread").alias("Spread"))


def label_table(labels: dict[str, DataFrame], key: str) -> DataFrame:
    """One ``<method>_cluster`` column per method, joined by key."""
    out = None
    for method, df in labels.items():
        one = df.select(key, F.col("cluster").alias(f"{method}_cluster"))
        out = one if out is None else out.join(one, key)
    if out is None:
        raise ValueError("no labels")
    return out


def clustering_summary(stats: DataFrame, labels: DataFrame, score: DataFrame, method: str) -> DataFrame:
    """(method, n_clusters, silhouette_score, labels_assigned, cluster_sizes): one row."""
    sizes = stats.agg(F.count("*").cast("int").alias("n_clusters"),
                      F.transform(F.array_sort(F.collect_list(F.struct("cluster", "size"))),
                                  lambda s: s["size"]).alias("cluster_sizes"))
    total = labels.agg(F.count("*").alias("labels_assigned"))
    return side_by_side(sizes, total, score).select(
        F.lit(method).alias("method"), "n_clusters", "silhouette_score", "labels_assigned",
        "cluster_sizes")


def feature_trends(df: DataFrame, labels: DataFrame, key: str, cols: list[str], n: int = 5) -> DataFrame:
    """(cluster, feature, mean, shift, rank): the n features of each cluster whose mean differs
    most from the overall mean, in overall standard deviations."""
    joined = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).join(
        labels.select(key, "cluster"), key)
    stats = joined.groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in cols])
    overall = joined.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                           for c in cols]).first()
    base = df.sparkSession.createDataFrame(
        [(c, overall[c].m, overall[c].s) for c in cols], "feature string, m double, s double")
    long = stats.unpivot(["cluster"], cols, "feature", "mean").join(F.broadcast(base), "feature")
    shift = F.coalesce(F.try_divide(F.col("mean") - F.col("m"), F.col("s")), F.lit(0.0))
    order = Window.partitionBy("cluster").orderBy(F.round(F.abs("shift"), 9).desc(), "feature")
    return long.withColumn("shift", shift).withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= n).select("cluster", "feature", "mean", "shift", "rank")
