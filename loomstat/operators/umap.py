"""Neighbour-graph embedding after McInnes 2018.

The graph is exact. The start is spectral: leading vectors of the normalised graph by subspace
iteration, as joins of edges with vectors, begun at the principal components. The layout is stochastic
descent in steps: a step lays out every block of near rows by itself for a number of epochs, while rows of
other blocks stand still, then positions are exchanged by a join. An edge acts as often as its weight
says, and each time its row is pulled to the other end and pushed from five rows drawn independently.
Tables that fit one block are thus laid out as usual; for larger ones the result resembles that.

Equal vectors are one row of the graph and share a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import q
from ..session import cut_lineage, discard
from .blocks import build, entries, matrix, vectors
from .neighbors import graph_neighbors, knn_graph, stack
from .pca import fit_pca

# Fixed values of the embedding: the curve parameters belong to min_dist 0.1 and spread 1; small tables
# take more epochs; the start spans ten units each way.
CURVE_A = 1.576943460405378
CURVE_B = 0.8950608781227859
SEED = 42
NEGATIVES = 5
SMALL_ROWS, SMALL_EPOCHS, LARGE_EPOCHS = 10_000, 500, 200
SPAN = 10.0

ROWS_PER_BLOCK = 4_000
STEPS = 10              # exchanges of positions between blocks
POOL = 4_096            # rows of other blocks that pushes are drawn from in one step
PRODUCTS, ROUNDS = 3, 5     # of the graph with the start vectors: per round, and rounds


@F.pandas_udf(T.StructType([T.StructField("rho", T.DoubleType()), T.StructField("sigma", T.DoubleType())]))
def _bandwidth(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Per row of neighbour distances: the nearest positive one, and the sigma for which the
    weights sum to log2(k)."""
    for dists in parts:
        if not len(dists):
            yield pd.DataFrame({"rho": pd.Series(dtype="float64"), "sigma": pd.Series(dtype="float64")})
            continue
        d = stack(dists)
        target = np.log2(d.shape[1])
        rho = np.where(d > 0, d, np.inf).min(axis=1)
        rho = np.where(np.isfinite(rho), rho, 0.0)
        lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        excess = np.maximum(d - rho[:, None], 0.0)
        for _ in range(64):
            total = np.exp(-excess / mid[:, None]).sum(axis=1)
            big = total > target
            hi, lo = np.where(big, mid, hi), np.where(big, lo, mid)
            mid = np.where(np.isfinite(hi), (lo + hi) / 2.0, mid * 2.0)
        floor = 1e-3 * np.maximum(d.mean(axis=1), 1e-12)
        yield pd.DataFrame({"rho": rho, "sigma": np.maximum(mid, floor)})


def memberships(graph: DataFrame) -> DataFrame:
    """(src, dst, w): one row of k distances per source, bandwidths found batch by batch."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist", "dst"))),
                          lambda e: F.struct(e["dst"].alias("dst"), e["dist"].alias("dist")))
    rows = graph.groupBy("src").agg(ordered.alias("edges"))
    fitted = rows.withColumn("b", _bandwidth(F.col("edges.dist")))
    edge = fitted.select("src", "b", F.explode("edges").alias("e"))
    weight = F.exp(-F.greatest(F.col("e.dist") - F.col("b.rho"), F.lit(0.0)) / F.col("b.sigma"))
    return edge.select("src", F.col("e.dst").alias("dst"), weight.alias("w"))


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b and w = u + v - u * v of the two directed weights."""
    return edges.filter(F.col("src") != F.col("dst")).groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("w").alias("s"),
        F.when(F.count("w") == 2, F.max("w") * F.min("w")).otherwise(F.lit(0.0)).alias("p")) \
        .select("a", "b", (F.col("s") - F.col("p")).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of undirected edges (a, b, w)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


# ---- the start ------------------------------------------------------------------------

def _gram(table: DataFrame, left: str, right: str, m: int) -> np.ndarray:
    row = table.agg(*[F.sum(F.col(left)[i] * F.col(right)[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(m)]).first()
    return np.array([[row[f"g{i}_{j}"] for j in range(m)] for i in range(m)], dtype=float)


def _turned(column: str, by: np.ndarray):
    """The vector of a column times a small matrix."""
    return F.array(*[sum((F.col(column)[i] * float(by[i, j]) for i in range(by.shape[0])), F.lit(0.0)) for j in range(by.shape[1])])


def spectral_start(edges: DataFrame, first: DataFrame, dims: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, pos), values): orthonormal approximations of the leading vectors of the normalised graph after
    the trivial one, and their Rayleigh quotients, largest first. ``first`` (id, pos) has the guesses to
    begin with; each round multiplies them ``PRODUCTS`` times by (1 + graph) / 2, whose spectrum is positive,
    and makes them orthonormal by their Gram matrix. The driver holds matrices of dims + 1 rows."""
    m = dims + 1
    directed = both_ways(edges)
    degree = directed.groupBy("src").agg(F.sum("w").alias("degree"))
    one, two = degree.select("src", F.col("degree").alias("x")), degree.select(F.col("src").alias("dst"), F.col("degree").alias("y"))
    graph = cut_lineage(directed.join(one, "src").join(two, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("x") * F.col("y"))).alias("w")))
    # the trivial vector is the root of the degrees
    now = cut_lineage(first.join(degree, F.col("id") == F.col("src"), "left").select(
        "id", F.concat(F.array(F.sqrt(F.coalesce("degree", F.lit(0.0)))), F.slice("pos", 1, dims)).alias("v")))

    def times(table: DataFrame) -> DataFrame:
        moved = graph.join(table.select(F.col("id").alias("dst"), "v"), "dst").groupBy("src").agg(
            F.array(*[F.sum(F.col("w") * F.col("v")[j]) for j in range(m)]).alias("y"))
        return table.join(moved, F.col("id") == F.col("src"), "left").select("id", "v", F.coalesce("y", F.transform("v", lambda x: x * 0)).alias("y"))

    def orthonormal(g: np.ndarray) -> np.ndarray:
        """Takes the columns apart in their order, the trivial one first."""
        scale = 1.0 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        lower = np.linalg.cholesky(g * np.outer(scale, scale) + 1e-12 * np.eye(m))
        return scale[:, None] * np.linalg.inv(lower).T

    now_v = now.select("id", _turned("v", orthonormal(_gram(now, "v", "v", m))).alias("v"))
    for _ in range(rounds):
        for _ in range(PRODUCTS):
            now_v = times(now_v).select("id", F.zip_with("v", "y", lambda a, b: (a + b) / 2).alias("v"))
        following = cut_lineage(now_v)
        discard(now)
        now = following
        now_v = now.select("id", _turned("v", orthonormal(_gram(now, "v", "v", m))).alias("v"))
    # the best vectors of the space that was found
    found = cut_lineage(times(now_v))
    g = _gram(found, "v", "y", m)[1:, 1:]
    values, turn = np.linalg.eigh((g + g.T) / 2)
    turn = turn[:, ::-1]
    out = cut_lineage(found.select("id", F.slice("v", 2, dims).alias("v")).select("id", _turned("v", turn).alias("pos")))
    discard(now, found, graph)
    return out, values[::-1]


# ---- the layout -----------------------------------------------------------------------

def pulls(p: np.ndarray, o: np.ndarray) -> np.ndarray:
    gap = ((p - o) ** 2).sum(axis=1)
    near = np.maximum(gap, 1e-12)
    pull = np.where(gap > 0, -2.0 * CURVE_A * CURVE_B * near ** (CURVE_B - 1.0) / (1.0 + CURVE_A * near ** CURVE_B), 0.0)
    return np.clip(pull[:, None] * (p - o), -4.0, 4.0)


def pushes(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    off = ((p - r) ** 2).sum(axis=1)
    push = 2.0 * CURVE_B / ((0.001 + off) * (1.0 + CURVE_A * off ** CURVE_B))
    return np.clip(push[:, None] * (p - r), -4.0, 4.0)


def descend(pos: np.ndarray, src: np.ndarray, inside: np.ndarray, fixed: np.ndarray, rate: np.ndarray, pool: np.ndarray,
            others: float, epochs: range, total: int, rng: np.random.Generator) -> np.ndarray:
    """Positions of a block after some epochs. An edge leads from the row ``src`` to the row ``inside`` of the
    block, or to the place ``fixed`` outside where that is -1; it acts with ``rate`` times an epoch, by an even
    schedule. ``others`` is the share of all rows that lies outside, for which ``pool`` stands."""
    pos, n = pos.copy(), len(pos)
    outside = inside < 0
    parts = max(1, int(np.bincount(src, minlength=n).mean() / 2)) if len(src) else 0
    for epoch in epochs:
        alpha = 1.0 - epoch / total
        due = np.flatnonzero(np.floor((epoch + 1) * rate) > np.floor(epoch * rate))
        rng.shuffle(due)
        # in small portions, so that a row moves on before its next edge acts
        for e in np.array_split(due, parts) if parts else []:
            i = src[e]
            p = pos[i]
            o = np.where(outside[e, None], fixed[e], pos[inside[e]])
            # the edge acts from both of its ends, each time on both
            move = 2.0 * pulls(p, o)
            for _ in range(NEGATIVES):
                far = rng.random(len(e)) < others
                r = pos[rng.integers(0, n, len(e))]
                if len(pool):
                    r = np.where(far[:, None], pool[rng.integers(0, len(pool), len(e))], r)
                move += pushes(p, r)
            np.add.at(pos, i, alpha * move)
    return pos


def _stepper(span: range, pool: np.ndarray, step: int, dims: int, rows: int, epochs: int, seed: int):
    """A step over one block: (its rows, the edges that lead from them with the places of their ends)."""
    def run(own: pa.Table, links: pa.Table) -> pa.Table:
        ids, place = own.column("id").to_numpy(), matrix(own.column("pos"))
        order = np.argsort(ids)
        ids, place = ids[order], place[order]
        block = own.column("block")[0].as_py() if own.num_rows else 0
        src, dst = links.column("src").to_numpy(), links.column("dst").to_numpy()
        by = np.lexsort((dst, src))                             # the same draws whatever the order of rows
        src, dst = src[by], dst[by]
        rate, there, far = (links.column(c).to_numpy()[by] for c in ("rate", "there", "far"))
        fixed = np.column_stack([links.column(f"x{j}").to_numpy()[by] for j in range(dims)]) if links.num_rows else np.zeros((0, dims))
        at = np.searchsorted(ids, dst)
        inside = np.where(there == block, np.minimum(at, max(0, len(ids) - 1)), -1)
        if links.num_rows and own.num_rows:
            rng = np.random.default_rng((seed, step, block))
            place = descend(place, np.searchsorted(ids, src), inside, fixed, rate, pool, 1.0 - len(ids) / rows, span, epochs, rng)
        return pa.table([pa.array(ids), pa.array(np.full(len(ids), block), pa.int32()), vectors(place) if len(ids) else own.column("pos")],
                        names=["id", "block", "pos"])

    return run


def layout(start: DataFrame, edges: DataFrame, dims: int, rows: int, epochs: int | None = None, seed: int = SEED,
           steps: int | None = None) -> DataFrame:
    """(id, pos): ``start`` (id, block, pos) after all epochs over the edges (a, b, w)."""
    epochs = epochs or (SMALL_EPOCHS if rows <= SMALL_ROWS else LARGE_EPOCHS)
    heaviest = edges.agg(F.max("w")).first()[0]
    if heaviest is None:
        return start.select("id", "pos")
    blocks = start.select("block").distinct().count()
    steps = steps or (1 if blocks == 1 else min(STEPS, epochs))
    home = start.select("id", "block")
    linked = cut_lineage(
        both_ways(edges).filter(F.col("w") * epochs >= heaviest)            # lighter edges never act
        .select("src", "dst", (F.col("w") / F.lit(heaviest)).alias("rate"))
        .join(home.select(F.col("id").alias("src"), "block"), "src")
        .join(home.select(F.col("id").alias("dst"), F.col("block").alias("there")), "dst"))
    pos = start
    for step in range(steps):
        span = range(step * epochs // steps, (step + 1) * epochs // steps)
        pool = np.zeros((0, dims))
        if blocks > 1:
            drawn = pos.select("pos", F.xxhash64("id", F.lit(seed + step)).alias("h")).orderBy("h").limit(POOL).collect()
            pool = np.array([r.pos for r in drawn], dtype=float)

        known = pos.select(F.col("id").alias("dst"), "pos")
        ends = linked.join(known, "dst").select("src", "dst", "rate", "block", "there", (F.col("there") != F.col("block")).alias("far"),
                                                *[F.col("pos")[j].alias(f"x{j}") for j in range(dims)])
        own = pos.select(F.col("id").alias("id"), F.col("block").alias("block"), F.col("pos").alias("pos"))
        following = cut_lineage(own.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(
            _stepper(span, pool, step, dims, rows, epochs, seed), "id long, block int, pos array<double>"))
        if step:
            discard(pos)
        pos = following
    return pos.select("id", "pos")


def umap_embed(df: DataFrame, key: str, features: str = "features", dims: int = 2, epochs: int | None = None,
               neighbors: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(key, UMAP1..k) from the exact neighbour graph, started at its leading vectors."""
    from .clean import assign_row_id
    named = cut_lineage(assign_row_id(
        df.select(q(key).alias("__key"), q(features).cast("array<double>").alias("vec")), "id"))
    first = named.first()
    if first is None:
        raise ValueError("no rows to embed")
    dims = min(dims, len(first["vec"]))
    table, copies = entries(named.select("id", "vec", F.lit(True).alias("asks"), F.lit(True).alias("gives")), 1)
    rows = table.count()
    k = neighbors or graph_neighbors(rows)
    blocks = build(table.select("eid", "vec"), rows_per_block, rows)
    points = table.select(F.col("eid").alias("id"), "vec")
    edges = cut_lineage(fuzzy_union(memberships(knn_graph(points, "id", "vec", k))))
    main = fit_pca(points, "vec", dims).transform(points, "id", "vec").select(
        "id", F.array(*[F.col(f"PC{j + 1}") for j in range(dims)]).alias("pos"))
    leading, _ = spectral_start(edges, main, dims)
    most = leading.agg(F.max(F.array_max(F.transform("pos", lambda v: F.abs(v))))).first()[0] or 1.0
    # a hair of noise, so that rows at one place can part
    noise = [F.pmod(F.xxhash64("id", F.lit(SEED + j)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 1e-3 for j in range(dims)]
    start = cut_lineage(leading.select("id", F.array(*[F.col("pos")[j] * F.lit(SPAN / most) + noise[j] for j in range(dims)]).alias("pos"))
                        .join(blocks.rows.select(F.col("eid").alias("id"), F.col("block").cast("int").alias("block")), "id").select("id", "block", "pos"))
    final = layout(start, edges, dims, rows, epochs)
    if copies is not None:
        final = final.join(copies.select(F.col("eid").alias("id"), F.col("id").alias("row")), "id", "left") \
            .select(F.coalesce("row", "id").alias("id"), "pos")
    return final.join(named.select("id", "__key"), "id").select(
        F.col("__key").alias(key), *[F.col("pos")[j].alias(f"UMAP{j + 1}") for j in range(dims)])
