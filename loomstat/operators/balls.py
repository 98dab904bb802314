"""DBSCAN in any dimension, exact: an epsilon-join on the tree of blocks, unions by ball.

Inside each block rows are covered by balls of radius eps / 2, so rows of one ball are neighbours of
each other: a ball that holds ``min_samples`` rows consists of core rows, and all core rows of a ball
share a cluster. Only rows of thin balls are counted, against the blocks within eps of them; a task
gives one number per row, never the pairs. For the clusters, core rows meet the core rows of each near
block once; a task joins the balls that touch and passes on one edge per ball. Components of those
edges are the clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import value_counts_ranked
from ..session import cut_lineage
from .blocks import PAIRS, build, entries, matrix, sweep, within
from .graph import connected_components

ROWS_PER_BLOCK = 2_000


def cover(x: np.ndarray, radius: float) -> np.ndarray:
    """Position of the ball centre of each row: the first row not yet covered covers all within the radius."""
    centre = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        near = ((x[left] - x[left[0]]) ** 2).sum(axis=1) <= radius * radius
        near[0] = True
        centre[left[near]] = left[0]
        left = left[~near]
    return centre


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge (node, smaller label) per node with the same components as the edges (a, b)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _counts(eps: float):
    def run(asks: pa.Table, gives: pa.Table) -> pa.Table:
        x, y = matrix(asks.column("vec")), matrix(gives.column("vec"))
        weight = gives.column("cnt").to_numpy().astype(np.int64)
        near = np.zeros(len(x), np.int64)
        if len(x) and len(y):
            step = max(1, PAIRS // len(y))
            for s in range(0, len(x), step):
                near[s:s + step] = within(x[s:s + step], y, eps) @ weight
        return pa.table({"eid": asks.column("eid"), "near": pa.array(near, pa.int64())})

    return run


def _touching(eps: float):
    def run(asks: pa.Table, gives: pa.Table) -> pa.Table:
        x, y = matrix(asks.column("vec")), matrix(gives.column("vec"))
        one, two = asks.column("ball").to_numpy(), gives.column("ball").to_numpy()
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x) and len(y):
            step = max(1, PAIRS // len(y))
            for s in range(0, len(x), step):
                i, j = np.nonzero(within(x[s:s + step], y, eps))
                u, v = one[s + i], two[j]
                ok = u != v
                pairs = np.unique(np.column_stack([u[ok], v[ok]]), axis=0)
                a, b = forest(np.concatenate([a, pairs[:, 0]]), np.concatenate([b, pairs[:, 1]]))
        return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    return run


def _lowest(eps: float):
    def run(asks: pa.Table, gives: pa.Table) -> pa.Table:
        x, y = matrix(asks.column("vec")), matrix(gives.column("vec"))
        cluster = gives.column("cluster").to_numpy().astype(np.int64)
        low = np.full(len(x), np.iinfo(np.int64).max)
        if len(x) and len(y):
            step = max(1, PAIRS // len(y))
            for s in range(0, len(x), step):
                near = within(x[s:s + step], y, eps)
                low[s:s + step] = np.where(near, cluster[None, :], np.iinfo(np.int64).max).min(axis=1)
        return pa.table({"eid": asks.column("eid"), "cluster": pa.array(low, pa.int64())})

    return run


def _summed(t: pa.Table) -> pa.Table:
    names, at = np.unique(t.column("eid").to_numpy(), return_inverse=True)
    near = np.zeros(len(names), np.int64)
    np.add.at(near, at, t.column("near").to_numpy())
    return pa.table({"eid": pa.array(names), "near": pa.array(near)})


def _joined(t: pa.Table) -> pa.Table:
    a, b = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
    return pa.table({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})


def _least(t: pa.Table) -> pa.Table:
    names, at = np.unique(t.column("eid").to_numpy(), return_inverse=True)
    low = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(low, at, t.column("cluster").to_numpy())
    return pa.table({"eid": pa.array(names), "cluster": pa.array(low)})


def dbscan_balls(rows: DataFrame, eps: float, min_samples: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, cluster, is_core) of a table (id, x); see ``dbscan.dbscan``."""
    asked = rows.select("id", F.col("x").alias("vec"), F.lit(True).alias("asks"), F.lit(True).alias("gives"))
    table, copies = entries(asked, 1)
    blocks = build(table.select("eid", "vec", "cnt"), rows_per_block)

    def balls(t: pa.Table) -> pa.Table:
        x, names, cnt = matrix(t.column("vec")), t.column("eid").to_numpy(), t.column("cnt").to_numpy()
        order = np.argsort(names)
        centre = np.empty(len(x), np.int64)
        # a hair less than half: rows of one ball stay within eps despite rounding
        centre[order] = order[cover(x[order], eps / 2 * (1 - 1e-9))]
        size = np.bincount(centre, cnt, len(x)).astype(np.int64)
        return pa.table({"eid": t.column("eid"), "vec": t.column("vec"), "cnt": t.column("cnt"), "z": t.column("z"), "block": t.column("block"),
                         "ball": pa.array(names[centre], pa.int64()), "crowd": pa.array(size[centre], pa.int64())})

    # a block that outgrew its size is covered part by part
    parts = F.pmod(F.xxhash64("eid", F.lit(5)), F.ceil(F.col("n") / F.lit(2 * rows_per_block))).cast("int")
    sizes = blocks.rows.groupBy("block").agg(F.count("*").alias("n"))
    placed = cut_lineage(
        blocks.rows.select("eid", "vec", "cnt", "z", "block").join(F.broadcast(sizes), "block").withColumn("part", parts).drop("n")
        .groupBy("block", "part").applyInArrow(balls, "eid long, vec array<double>, cnt long, z array<double>, block int, ball long, crowd long"))
    reach = F.lit(float(eps)).alias("reach")

    def near(asking: DataFrame, data: DataFrame, fn, merge, schema: str, keep: tuple[str, ...] = (), later_only: bool = False) -> DataFrame:
        return sweep(asking.select("eid", "z", "block", reach, "vec", *keep), blocks, data, fn, merge, schema, rows_per_block, later_only)

    thin = placed.filter(F.col("crowd") < min_samples)
    counted = near(thin, placed.select("eid", "block", "vec", "cnt"), _counts(eps), _summed, "eid long, near long") \
        .groupBy("eid").agg(F.sum("near").alias("near")).filter(F.col("near") >= min_samples)
    marked = cut_lineage(placed.join(counted, "eid", "left").withColumn(
        "is_core", (F.col("crowd") >= min_samples) | F.col("near").isNotNull()).drop("near", "crowd", "cnt"))
    core = marked.filter("is_core")
    edges = near(core, core.select("eid", "block", "vec", "ball"), _touching(eps), _joined, "u long, v long", ("ball",), later_only=True)
    comps = connected_components(edges.distinct())
    named = core.select("eid", "ball").join(comps, F.col("ball") == F.col("node"), "left").select(
        "eid", F.coalesce("component", "ball").alias("component"))
    # clusters are numbered by their smallest core row
    first = named.groupBy("component").agg(F.min("eid").alias("first"))
    order = value_counts_ranked(first.select("first"), "first")[0].select("first", F.col("below").alias("cluster"))
    labelled = cut_lineage(named.join(first, "component").join(order, "first").select("eid", "cluster"))
    loose = marked.filter(~F.col("is_core"))
    border = near(loose, core.select("eid", "block", "vec").join(labelled, "eid"), _lowest(eps), _least, "eid long, cluster long") \
        .groupBy("eid").agg(F.min("cluster").alias("lowest"))
    none = F.lit(np.iinfo(np.int64).max)
    out = marked.select("eid", "is_core").join(labelled, "eid", "left").join(border, "eid", "left").select(
        "eid", F.coalesce("cluster", F.when(F.col("lowest") < none, F.col("lowest")), F.lit(-1)).cast("int").alias("cluster"), "is_core")
    if copies is None:
        return out.withColumnRenamed("eid", "id")
    return out.join(copies, "eid", "left").select(F.coalesce("id", "eid").alias("id"), "cluster", "is_core")
