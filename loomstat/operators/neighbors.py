"""Exact nearest neighbours: kNN graph, k-distance curve, KNN imputation.

Equal vectors are searched for once. They sit in a tree of blocks (``blocks.py``). The first round
searches a vector's own block, which gives an upper bound on its k-th distance; the second the
nearest other blocks that can beat it, which tightens it; the third sweeps over what is then still within
reach, and the bound goes down on the way. Only the k best of each (vector, block) leave a task of the
first two rounds, the k best of each vector one of the third; the pairs themselves are never materialised.

Missing coordinates use the nan-Euclidean distance sqrt(d / shared * sum of squares over the
shared coordinates); blocks then keep boxes in the coordinates themselves, and the box bound
below holds for that distance too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import as_double, q, vector_of
from ..functions.keys import any_key, is_integral
from ..functions.ranking import value_counts_ranked
from ..session import cut_lineage, discard
from .blocks import PAIRS, Blocks, build, entries, first_of, matrix, rough_squares, route, sweep, visit

ROWS_PER_BLOCK = 2_000
NEAREST = 2             # blocks visited before the reach is tightened
MAX_PIVOTS = 2_048


# ---- numpy helpers run inside tasks ---------------------------------------------------

def stack(column: pd.Series) -> np.ndarray:
    """Vectors of one batch as a float matrix; nulls become NaN."""
    if not len(column):
        return np.empty((0, 0))
    return np.array([np.asarray(v, dtype="float64") for v in column])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise nan-Euclidean distances, NaN where no coordinate is shared."""
    d = a.shape[1]
    total = np.zeros((len(a), len(b)))
    holes = np.isnan(a).any() or np.isnan(b).any()
    for j in range(d):
        diff = a[:, j, None] - b[None, :, j]
        total += np.nan_to_num(diff * diff, nan=0.0) if holes else diff * diff
    if not holes:
        return np.sqrt(total)
    shared = (~np.isnan(a)).astype(float) @ (~np.isnan(b)).astype(float).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(total * d / shared), np.nan)


def box_bound(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, holes: np.ndarray) -> np.ndarray:
    """Smallest possible distance of each row of ``x`` to any row inside one box.

    Coordinates present in the query and in every row of the box always count. Coordinates
    some rows of the box lack may count; the bound takes those that lower the mean.
    """
    gap = np.maximum(0.0, np.maximum(lo - x, x - hi)) ** 2
    have = ~np.isnan(x) & ~np.isnan(lo)
    must = have & ~holes
    may = have & holes
    d = x.shape[1]
    base = np.where(must, gap, 0.0).sum(axis=1)
    size = must.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = np.where(size > 0, base / size, np.inf)
        if may.any():
            extra = np.sort(np.where(may, gap, np.inf), axis=1)
            sums = base[:, None] + np.cumsum(extra, axis=1)
            means = sums / (size[:, None] + np.arange(1, d + 1))
            best = np.minimum(best, np.nanmin(means, axis=1))
    # slack keeps rounding from cutting off a block at exactly the bound
    return np.sqrt(best * d) * (1 - 1e-12) - 1e-12


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id); NaN distances never qualify."""
    ok = np.flatnonzero(~np.isnan(dist))
    if len(ok) > k:
        cut = np.partition(dist[ok], k - 1)[k - 1]
        ok = ok[dist[ok] <= cut]
    return ok[np.lexsort((ids[ok], dist[ok]))][:k]


# ---- the block join -------------------------------------------------------------------

def choose_pivots(rows: DataFrame, wanted: int) -> np.ndarray:
    """At most MAX_PIVOTS rows, picked by a hash of the id so that reruns agree."""
    picked = (rows.select("vec", F.xxhash64("id", F.lit(42)).alias("h"))
              .orderBy("h").limit(min(wanted, MAX_PIVOTS)).select("vec").collect())
    return np.array([[np.nan if v is None else v for v in r.vec] for r in picked], dtype="float64")


def nearest_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Append ``cell``, the index of the closest pivot."""
    filled = np.where(np.isnan(pivots), 0.0, pivots)

    def assign(batches):
        norms = (filled * filled).sum(axis=1)
        for pdf in batches:
            if len(pdf):
                x = np.nan_to_num(stack(pdf["vec"]), nan=0.0)
                pdf = pdf.assign(cell=(norms - 2.0 * (x @ filled.T)).argmin(axis=1).astype("int32"))
            else:
                pdf = pdf.assign(cell=pd.Series(dtype="int32"))
            yield pdf

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(assign, f"{schema}, cell int")


def cell_boxes(celled: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{cell: (low, high, has holes)} per coordinate: at most MAX_PIVOTS * d numbers."""

    def partial(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = stack(pdf["vec"])
            cells = pdf["cell"].to_numpy()
            for c in np.unique(cells):
                part = x[cells == c]
                gone = np.isnan(part)
                now = [np.where(gone, np.inf, part).min(axis=0),
                       np.where(gone, -np.inf, part).max(axis=0), gone.any(axis=0)]
                old = seen.get(int(c))
                seen[int(c)] = now if old is None else [
                    np.minimum(old[0], now[0]), np.maximum(old[1], now[1]), old[2] | now[2]]
        yield pd.DataFrame(
            [(c, j, lo[j], hi[j], bool(gone[j])) for c, (lo, hi, gone) in seen.items()
             for j in range(len(lo))], columns=["cell", "j", "lo", "hi", "holes"])

    got = (celled.select("vec", "cell")
           .mapInPandas(partial, "cell int, j int, lo double, hi double, holes boolean")
           .groupBy("cell", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                     F.max("holes").alias("holes")).toPandas())
    boxes = {}
    for c, part in got.sort_values("j").groupby("cell"):
        lo, hi = part["lo"].to_numpy().copy(), part["hi"].to_numpy().copy()
        empty = lo > hi
        lo[empty], hi[empty] = np.nan, np.nan
        boxes[int(c)] = (lo, hi, part["holes"].to_numpy().astype(bool))
    return boxes


class BoxBlocks(Blocks):
    """Blocks over vectors with missing coordinates: boxes in the coordinates themselves."""

    def __init__(self, blocks: Blocks):
        boxes = cell_boxes(blocks.rows.select("vec", F.col("block").alias("cell")))
        width = len(next(iter(boxes.values()))[0])
        gone = np.full(width, np.nan)
        self.boxes = [boxes.get(b, (gone, gone, np.ones(width, bool))) for b in range(len(blocks.lo))]
        super().__init__(blocks.rows, blocks.lo, blocks.hi, blocks.cell, "vec")

    def near(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for b, (lo, hi, holes) in enumerate(self.boxes):
            bound = box_bound(x, lo, hi, holes)
            ok = bound <= reach
            found.append((np.flatnonzero(ok), np.full(int(ok.sum()), b), bound[ok]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def bound(self, x: np.ndarray, block: int) -> np.ndarray:
        return box_bound(x, *self.boxes[block])

    def __getstate__(self):
        return {"boxes": self.boxes, "by": self.by, "cell": self.cell}


def _search(k: int, fill: bool, holes: bool):
    """Of the entries of a block, those that hold the k nearest rows of each row that asks, or of each
    of its missing coordinates: (eid, slot, dst, dist, val)."""
    schema = pa.schema([("eid", pa.int64()), ("slot", pa.int32()), ("dst", pa.int64()), ("dist", pa.float64()), ("val", pa.float64())])

    def run(asks: pa.Table, gives: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if asks.num_rows and gives.num_rows:
            names, reach, x = (asks.column("eid").to_numpy(), asks.column("reach").to_numpy(), matrix(asks.column("vec")))
            y, ids = matrix(gives.column("vec")), gives.column("ids").combine_chunks()
            per, flat = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy()
            begin = np.cumsum(per) - per
            first = flat[begin]
            step = max(1, PAIRS // 4 // len(y))
            for s in range(0, len(x), step):
                part = x[s:s + step]
                if not holes:
                    i, at, dist = _closest(part, y, first, reach[s:s + step], k)
                    out.append([names[s + i], np.full(len(i), -1), at, dist])
                    continue
                far = distances(part, y)
                for i in range(len(part)):
                    for j in np.flatnonzero(np.isnan(part[i])) if fill else [-1]:
                        donors = np.where(np.isnan(y[:, j]), np.nan, far[i]) if fill else far[i]
                        at = _best(donors, first, k)
                        out.append([np.full(len(at), names[s + i]), np.full(len(at), j), at, donors[at]])
        if not out:
            return schema.empty_table()
        eid, slot, at, dist = (np.concatenate(c) for c in zip(*out))
        val = y[at, slot] if fill else np.zeros(len(at))
        # one row per id that an entry lists
        times = per[at]
        again = np.repeat(np.arange(len(at)), times)
        dst = flat[begin[at][again] + np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)]
        return pa.table([pa.array(eid[again], pa.int64()), pa.array(slot[again], pa.int32()), pa.array(dst),
                         pa.array(dist[again]), pa.array(val[again])], schema=schema)

    return run


def _closest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, entry, distance) of the k nearest entries of each row within its reach, ties to the smaller id.
    Rows with many entries within reach are cut at their k-th rough distance before any is measured."""
    rough, error = rough_squares(x, y)
    limit = reach ** 2 * (1 + 1e-9) + 2 * error
    near = rough <= limit[:, None]
    many = np.flatnonzero(near.sum(axis=1) > 4 * k)
    if len(many):
        top = np.partition(rough[many], k - 1, axis=1)[:, k - 1]
        limit[many] = np.minimum(limit[many], top + 2 * error[many])
        near[many] = rough[many] <= limit[many, None]
    i, j = np.nonzero(near)
    dist = np.empty(len(i))
    step = max(1, PAIRS // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        dist[s:s + step] = np.sqrt(((x[i[s:s + step]] - y[j[s:s + step]]) ** 2).sum(axis=1))
    kept = first_of([ids[j], dist], i, k)
    return i[kept], j[kept], dist[kept]


def _merge(k: int):
    def run(t: pa.Table) -> pa.Table:
        eid, slot, dst, dist = (t.column(c).to_numpy() for c in ("eid", "slot", "dst", "dist"))
        _, group = np.unique(np.column_stack([eid, slot]), axis=0, return_inverse=True) if (slot >= 0).any() else (None, eid)
        return t.take(pa.array(first_of([dst, dist], group, k)))

    return run


def _tighten(k: int):
    def run(asks: pa.Table, reach: np.ndarray, best: pa.Table) -> np.ndarray:
        """The distance of the k-th row that was found, for rows with so many."""
        eid, far = best.column("eid").to_numpy(), best.column("dist").to_numpy()
        names, at, size = np.unique(eid, return_inverse=True, return_counts=True)
        low = np.zeros(len(names))
        np.maximum.at(low, at, far)
        low[size < k] = np.inf
        rows = asks.column("eid").to_numpy()
        place = np.minimum(np.searchsorted(names, rows), len(names) - 1)
        return np.where(names[place] == rows, np.minimum(reach, low[place]), reach)

    return run


def _top(cands: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("eid", "slot").orderBy("dist", "dst")
    return cands.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def nearest_entries(rows: DataFrame, k: int, fill: bool, rows_per_block: int) -> tuple[DataFrame, DataFrame | None]:
    """((eid, slot, dst, dist, val): the k nearest giving rows of every asking vector, equal rows
    included; (id, eid) of the rows whose vector stands more than once, or None).

    Three rounds: a vector's own block, the ``NEAREST`` blocks that come next, and a sweep over what is
    then still within reach, those blocks included, whose result is whole.
    """
    schema = "eid long, slot int, dst long, dist double, val double"
    missing = F.exists("vec", lambda v: v.isNull() | F.isnan(v))
    if "gives" not in rows.columns:
        rows = rows.withColumns({"asks": F.lit(True), "gives": F.lit(True)})
    if fill:
        rows = rows.withColumn("asks", F.col("asks") & missing)
    table, copies = entries(rows.select("id", "vec", "asks", "gives"), k)
    n, holes = table.agg(F.count("*"), F.coalesce(F.max(missing), F.lit(False))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], schema), None
    blocks = build(table, rows_per_block, n)
    search = _search(k, fill, holes)
    data = blocks.rows.filter(F.size("ids") > 0).select("eid", "block", "ids", "vec")
    asking = blocks.rows.filter("asks")
    own = visit(asking.select("eid", "block", "vec", F.lit(float("inf")).alias("reach")), data, search, schema, rows_per_block)
    if len(blocks.lo) == 1:
        return _top(own, k), copies
    if holes:
        blocks = BoxBlocks(blocks)
    best = cut_lineage(_top(own, k))
    slots = F.size(F.filter("vec", lambda v: v.isNull() | F.isnan(v))) if fill else F.lit(1)

    def known() -> DataFrame:
        per_slot = best.groupBy("eid", "slot").agg(F.count("*").alias("n"), F.max("dist").alias("far"))
        reach = per_slot.groupBy("eid").agg(F.max(F.when(F.col("n") >= k, F.col("far"))).alias("far"), F.count_if(F.col("n") >= k).alias("full"))
        return asking.join(reach, "eid", "left").select(
            "eid", "z", "vec", "block", F.when(F.col("full") == slots, F.col("far")).otherwise(F.lit(float("inf"))).alias("reach"))

    # entries of one vector are one, so nothing else lies at distance zero
    open_ = known().filter(F.col("reach") > 0)
    wants = cut_lineage(route(open_, blocks, nearest_first=NEAREST))
    if not wants.isEmpty():
        # the names of rows take little space in files, and much more as a table sent to all tasks
        found = visit(wants.hint("merge").join(open_.select("eid", "vec", "reach"), "eid"), data, search, schema, rows_per_block)
        following = cut_lineage(_top(best.unionByName(found), k))
        discard(best, wants)
        best = following
    rest = cut_lineage(known().select(*dict.fromkeys(["eid", blocks.by, "vec"]), "block", "reach"))
    out = cut_lineage(sweep(rest, blocks, data, search, _merge(k), schema, rows_per_block, tighten=None if holes else _tighten(k)))
    discard(best, rest)
    return out, copies


def by_row(best: DataFrame, copies: DataFrame | None) -> DataFrame:
    """The same per row: every row takes what its vector found. Adds id."""
    if copies is None:
        return best.withColumn("id", F.col("eid"))
    return best.join(copies, "eid", "left").withColumn("id", F.coalesce("id", "eid"))


@any_key("src", "dst")
def knn_graph(df: DataFrame, key: str, features: str, k: int,
              rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(src, dst, rank, dist): the k nearest other rows of each row, ties to the smaller id."""
    rows = df.select(F.col(key).cast("long").alias("id"),
                     F.col(features).cast("array<double>").alias("vec"))
    best, copies = nearest_entries(rows, k + 1, False, rows_per_block)       # itself may be among them
    order = Window.partitionBy("id").orderBy("dist", "dst")
    return by_row(best, copies).filter("id <> dst").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select(F.col("id").alias("src"), "dst", "rank", "dist")


def graph_neighbors(rows: int) -> int:
    """Neighbours per row of the embedding graph; very small tables cannot have one."""
    k = min(15, rows // 10)
    if k < 2:
        raise ValueError("the neighbour graph needs at least 20 rows")
    return k


def k_distance(df: DataFrame, key: str, features: str, min_samples: int = 5,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(key, distance) to the ``min_samples``-th nearest row, counting the row itself."""
    graph = knn_graph(df, key, features, min_samples - 1, rows_per_block)
    return graph.groupBy(F.col("src").alias(key)).agg(F.max("dist").alias("distance"))


def k_distance_curve(kdist: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """The ascending curve in run-length form: (distance, cnt, below)."""
    return value_counts_ranked(kdist, "distance", rows_per_range)[0]


@any_key()
def impute_knn(df: DataFrame, key: str, cols: Sequence[str], k: int = 5,
               donors: DataFrame | None = None,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Fill each missing number by the mean of the k nearest rows that have it.

    Without any usable donor the column mean is used. With ``donors`` the neighbours come from
    that table of the same columns alone, so a row's result does not depend on its batch.
    """
    cols = list(cols)
    rows = df.select(q(key).cast("long").alias("id"), vector_of(cols).alias("vec"))
    pool = rows
    if donors is not None:
        # even ids ask, odd ids answer: keys of the two tables may be the same
        asking = rows.select((F.col("id") * 2).alias("id"), "vec", F.lit(True).alias("asks"), F.lit(False).alias("gives"))
        name = q(key).cast("long") if is_integral(donors, key) else F.xxhash64(q(key)).bitwiseAND(F.lit((1 << 61) - 1))
        giving = donors.select((name * 2 + 1).alias("id"), vector_of(cols).alias("vec"),
                               F.lit(False).alias("asks"), F.lit(True).alias("gives"))
        pool = asking.unionByName(giving)
    best, copies = nearest_entries(pool, k, True, rows_per_block)
    filled = best.groupBy("eid", "slot").agg(F.avg("val").alias("v"))
    fills = by_row(filled.groupBy("eid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("__fill")), copies)
    if donors is not None:
        fills = fills.filter("id % 2 = 0").withColumn("id", F.shiftright("id", 1))
    fills = fills.select("id", "__fill")
    base = donors if donors is not None else df
    means = base.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    joined = df.join(fills.withColumnRenamed("id", "__id"), q(key) == F.col("__id"), "left")
    new = {c: F.coalesce(as_double(c), F.col("__fill")[i], F.lit(means[f"m{i}"]))
           for i, c in enumerate(cols)}
    return joined.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])
