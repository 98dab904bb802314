"""DBSCAN, exact, without listing the pairs of a crowded cell: on a grid up to four dimensions, where
cells have few neighbours, and on a tree of balls (``balls.py``) beyond; both give the same clusters.

Cells have the side eps / sqrt(d), so rows of one cell are always neighbours: a cell with
``min_samples`` rows consists of core rows, and all core rows of a cell share a cluster.
Only rows of thin cells (fewer than ``min_samples`` rows) need neighbour counts; every cell
is probed by a bounded number of such rows, so this is linear in the table. Whether two
neighbouring crowded cells touch is decided on bounding boxes of ever finer subcells, and on
single rows only once few are left.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import any_key
from ..functions.ranking import ROWS_PER_RANGE, attach_by_value, range_edges, ranges_for, value_counts_ranked, with_range
from ..session import cut_lineage, discard
from .balls import dbscan_balls
from .graph import connected_components
from .neighbors import k_distance, k_distance_curve

# Fixed values of the automatic radius.
MIN_SAMPLES = 5
DEFAULT_EPS = 0.5
SENSITIVITY = 1.0

GRID_DIMENSIONS = 4
ROWS_PER_PROBE = 50_000
DIRECT_PAIRS = 10_000
CURVE_POINTS = 10_000


# ---- automatic radius -----------------------------------------------------------------

def knee(x: np.ndarray, y: np.ndarray, sensitivity: float = SENSITIVITY) -> int | None:
    """Position of the knee of a convex increasing curve (Kneedle, Satopaa 2011); ``knee_value`` finds it on tables."""
    n = len(y)
    if n < 3 or y[-1] == y[0] or x[-1] == x[0]:
        return None
    along = (x - x[0]) / (x[-1] - x[0])
    flipped = (y[-1] - y)[::-1]
    bulge = (flipped - flipped.min()) / (flipped.max() - flipped.min()) - along
    left, right = bulge[:-2], bulge[2:]
    middle = bulge[1:-1]
    peaks = set((np.flatnonzero((middle >= left) & (middle >= right)) + 1).tolist())
    dips = set((np.flatnonzero((middle <= left) & (middle <= right)) + 1).tolist())
    if bulge[0] >= bulge[1]:
        peaks.add(0)
    if bulge[-1] >= bulge[-2]:
        peaks.add(n - 1)
    if bulge[0] <= bulge[1]:
        dips.add(0)
    if bulge[-1] <= bulge[-2]:
        dips.add(n - 1)
    drop = sensitivity * abs(np.diff(along).mean())
    at, bar = None, 0.0
    for i in range(n - 1):
        if i in peaks:
            at, bar = i, bulge[i] - drop
        if i in dips:
            bar = 0.0
        if at is not None and bulge[i + 1] < bar:
            return n - 1 - at
    return None


def sampled_curve(curve: DataFrame, rows: int, points: int = CURVE_POINTS) -> np.ndarray:
    """The ascending values at equally spaced ranks: all of them up to ``points`` rows. For drawing; the
    radius is found on all rows."""
    take = min(rows, points)
    if take < 2:
        return np.array([])
    step = (rows - 1) / (take - 1)
    # wanted ranks are round(i * step); a run covers ranks below .. below + cnt - 1
    first = F.ceil((F.col("below") - 0.5) / F.lit(step))
    last = F.ceil((F.col("below") + F.col("cnt") - 0.5) / F.lit(step)) - 1
    got = curve.select("distance", F.greatest(first, F.lit(0)).alias("a"),
                       F.least(last, F.lit(take - 1)).alias("z")) \
        .filter(F.col("a") <= F.col("z")).orderBy("distance").collect()
    return np.concatenate([np.full(r.z - r.a + 1, r.distance) for r in got])


def knee_value(curve: DataFrame, sensitivity: float = SENSITIVITY,
               rows_per_range: int = ROWS_PER_RANGE) -> float | None:
    """The distance that ``knee`` finds on all rows of the curve (distance, cnt, below).

    Within a run of equal distances the difference curve only falls, so the first and last row of
    a run stand for it. The rows are numbered from the largest distance down and cut into ranges;
    what a range needs of the others comes from one row per range.
    """
    n, low, high = curve.agg(F.sum("cnt"), F.min("distance"), F.max("distance")).first()
    if not n or n < 3 or low == high:
        return None
    step = F.lit(float(n - 1))
    edges = range_edges(curve, "distance", ranges_for(n, rows_per_range))
    rows = (with_range(curve, "distance", edges, "range")
            .select((-F.col("range")).alias("range"), "distance",
                    F.explode(F.array_distinct(F.array(F.lit(n) - F.col("below") - F.col("cnt"),
                                                       F.lit(n - 1) - F.col("below")))).alias("at"))
            .withColumn("bulge", (F.lit(high) - F.col("distance")) / F.lit(high - low) - F.col("at") / step))
    inside, by_range = Window.partitionBy("range").orderBy("at"), Window.orderBy("range")
    rows = cut_lineage(rows)
    ends = (rows.groupBy("range").agg(F.min_by("bulge", "at").alias("head"), F.max_by("bulge", "at").alias("tail"))
            .select("range", F.lag("tail").over(by_range).alias("before"), F.lead("head").over(by_range).alias("after")))
    left = F.coalesce(F.lag("bulge").over(inside), "before")
    right = F.coalesce(F.lead("bulge").over(inside), "after")
    near = rows.join(F.broadcast(ends), "range").withColumns({"left": left, "right": right})
    up = F.coalesce(F.col("bulge") >= F.col("left"), F.lit(True)) & F.coalesce(F.col("bulge") >= F.col("right"), F.lit(True))
    down = F.coalesce(F.col("bulge") <= F.col("left"), F.lit(True)) & F.coalesce(F.col("bulge") <= F.col("right"), F.lit(True))
    marked = cut_lineage(near.select(
        "range", "at", "bulge", F.when(up, F.col("distance")).alias("peak"),
        F.when(down, F.lit(0.0)).when(up, F.col("bulge") - F.lit(sensitivity) / step).alias("bar")))
    passed = Window.unboundedPreceding
    carried = (marked.groupBy("range").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("peak", "bar")])
        .select("range", *[F.last(c, True).over(by_range.rowsBetween(passed, -1)).alias(f"{c}_before") for c in ("peak", "bar")]))
    state = marked.join(F.broadcast(carried), "range").select("at", "bulge", *[
        F.coalesce(F.last(c, True).over(inside.rowsBetween(passed, -1)), f"{c}_before").alias(c) for c in ("peak", "bar")])
    found = state.filter("peak is not null and bulge < bar").agg(F.min_by("peak", "at")).first()[0]
    discard(rows, marked)
    return found


def knee_eps(points: DataFrame, key: str, features: str = "features",
             min_samples: int = MIN_SAMPLES) -> float:
    """Radius at the knee of the k-distance curve; 0.5 when there is none."""
    curve = cut_lineage(k_distance_curve(k_distance(points, key, features, min_samples)))
    found = knee_value(curve)
    return float(found) if found is not None else DEFAULT_EPS


# ---- grid helpers ---------------------------------------------------------------------

def _distance(a: str, b: str, d: int) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [
        (F.col(a)[j] - F.col(b)[j]) * (F.col(a)[j] - F.col(b)[j]) for j in range(d)]))


def _grid(x: str, side: float, d: int) -> Column:
    return F.array(*[F.floor(F.col(x)[j] / F.lit(side)).cast("long") for j in range(d)])


def neighbour_offsets(d: int) -> list[tuple[int, ...]]:
    """Cell offsets that can hold a row within eps of the centre cell, itself included."""
    reach = int(np.ceil(np.sqrt(d) + 1e-9))
    return [o for o in product(range(-reach, reach + 1), repeat=d)
            if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d + 1e-9]


def _around(cell: str, offsets: list[tuple[int, ...]]) -> Column:
    # one constant array of offsets keeps the generated code small in three and more dimensions
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offsets])
    return F.explode(F.transform(steps, lambda o: F.zip_with(F.col(cell), o, lambda a, b: a + b)))


def _probe(thin: DataFrame, rows: DataFrame, offsets: list, d: int, eps: float) -> DataFrame:
    """Thin rows next to every row within eps: (id, other, ...). Crowded cells are cut into
    chunks and their few probing rows copied to each, so no task gets a whole cell."""
    chunk_count = F.ceil(F.col("cnt") / F.lit(ROWS_PER_PROBE)).cast("int")
    data = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), chunk_count).cast("int")) \
        .select(F.col("cell").alias("at"), "chunk", F.col("id").alias("other"),
                F.col("x").alias("y"), *[c for c in ("component",) if c in rows.columns])
    sizes = rows.groupBy(F.col("cell").alias("at")).agg(F.max(chunk_count).alias("chunks"))
    asks = thin.select("id", "x", _around("cell", offsets).alias("at")).join(sizes, "at") \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return asks.join(data, ["at", "chunk"]).filter(_distance("x", "y", d) <= F.lit(eps))


def _nodes(core: DataFrame, side: float, d: int) -> DataFrame:
    """One row per subcell: count, bounding box, and one member row."""
    return core.groupBy("cell", _grid("x", side, d).alias("sub")).agg(
        F.count("*").alias("n"),
        *[F.min(F.col("x")[j]).alias(f"lo{j}") for j in range(d)],
        *[F.max(F.col("x")[j]).alias(f"hi{j}") for j in range(d)],
        F.min_by("x", "id").alias("rep"))


def _touching_cells(core: DataFrame, side: float, d: int, eps: float, offsets: list,
                    direct_pairs: int) -> DataFrame:
    """(a, b): pairs of neighbouring core cells holding rows within eps of each other."""
    half = [o for o in offsets if o > tuple([0] * d)]
    found = None
    cells = core.select("cell").distinct()
    open_pairs = cells.select(F.col("cell").alias("a"), _around("cell", half).alias("b")) \
        .join(cells.select(F.col("cell").alias("b")), "b") \
        .select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    level = side
    while True:
        nodes = cut_lineage(_nodes(core, level, d))

        def one(prefix: str, cell: str, sub: str) -> DataFrame:
            return nodes.select(F.col("cell").alias(cell), F.col("sub").alias(sub),
                                *[F.col(c).alias(prefix + c) for c in nodes.columns
                                  if c not in ("cell", "sub")])

        pairs = open_pairs.join(one("p_", "a", "sa"), ["a", "sa"]).join(one("q_", "b", "sb"), ["b", "sb"])
        gap = far = F.lit(0.0)
        for j in range(d):
            plo, phi, qlo, qhi = (F.col(f"{p}{e}{j}") for p in ("p_", "q_") for e in ("lo", "hi"))
            between = F.greatest(qlo - phi, plo - qhi, F.lit(0.0))
            across = F.greatest(qhi - plo, phi - qlo)
            gap, far = gap + between * between, far + across * across
        near = _distance("p_rep", "q_rep", d) <= F.lit(eps)
        # boxes that only touch at eps up to rounding stay open and are decided on rows;
        # copies of one point have boxes of no extent, which the member rows decide
        extent = reduce(lambda s, t: s + t, [
            F.col(f"{p}hi{j}") - F.col(f"{p}lo{j}") for p in ("p_", "q_") for j in range(d)])
        state = F.when(near | (F.sqrt(far) <= F.lit(eps * (1 - 1e-12))), F.lit("yes")) \
            .when((F.sqrt(gap) > F.lit(eps * (1 + 1e-12))) | (extent == 0), F.lit("no")) \
            .otherwise(F.lit("open"))
        judged = cut_lineage(pairs.select("a", "sa", "b", "sb", state.alias("state"),
                                          (F.col("p_n") * F.col("q_n")).alias("work")))
        yes = judged.filter(F.col("state") == "yes").select("a", "b").distinct()
        found = yes if found is None else found.unionByName(yes)
        left = judged.filter(F.col("state") == "open").join(yes, ["a", "b"], "left_anti")
        few = left.filter(F.col("work") <= direct_pairs)
        many = left.filter(F.col("work") > direct_pairs)
        todo = left.agg(F.count_if(F.col("work") <= direct_pairs).alias("few"),
                        F.count_if(F.col("work") > direct_pairs).alias("many")).first()
        if todo.few:
            rows = core.select("cell", _grid("x", level, d).alias("sub"), "x")
            hit = few.select("a", "sa", "b", "sb") \
                .join(rows.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), "x"), ["a", "sa"]) \
                .join(rows.select(F.col("cell").alias("b"), F.col("sub").alias("sb"),
                                  F.col("x").alias("y")), ["b", "sb"]) \
                .filter(_distance("x", "y", d) <= F.lit(eps))
            found = cut_lineage(found.unionByName(hit.select("a", "b").distinct()))
        if not todo.many:
            return found
        # split every crowded subcell; a child is open against all children of the other side
        finer = level / (4 if d <= 2 else 2)
        kids = core.select("cell", _grid("x", level, d).alias("sub"),
                           _grid("x", finer, d).alias("kid")).distinct()
        open_pairs = many.join(found, ["a", "b"], "left_anti").select("a", "sa", "b", "sb") \
            .join(kids.select(F.col("cell").alias("a"), F.col("sub").alias("sa"),
                              F.col("kid").alias("ka")), ["a", "sa"]) \
            .join(kids.select(F.col("cell").alias("b"), F.col("sub").alias("sb"),
                              F.col("kid").alias("kb")), ["b", "sb"]) \
            .select("a", "b", F.col("ka").alias("sa"), F.col("kb").alias("sb"))
        open_pairs = cut_lineage(open_pairs)
        level = finer


# ---- DBSCAN ---------------------------------------------------------------------------

@any_key()
def dbscan(points: DataFrame, key: str, eps: float, features: str = "features",
           min_samples: int = MIN_SAMPLES, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """(key, cluster, is_core): clusters numbered by their smallest core key, noise is -1.

    A border row belongs to the lowest-numbered cluster among its core neighbours.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    rows = points.select(F.col(key).cast("long").alias("id"),
                         F.col(features).cast("array<double>").alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to cluster")
    d = len(first.x)
    if d > GRID_DIMENSIONS:
        return dbscan_balls(rows, eps, min_samples).withColumnRenamed("id", key)
    # a hair under eps / sqrt(d): rows of one cell stay within eps despite rounding
    side = eps / float(np.sqrt(d)) * (1 - 1e-9)
    offsets = neighbour_offsets(d)
    gridded = rows.withColumn("cell", _grid("x", side, d))
    sizes = gridded.groupBy("cell").agg(F.count("*").alias("cnt"))
    total = rows.count()
    base = cut_lineage(attach_by_value(gridded, sizes, "cell", total).select("id", "x", "cell", "cnt"))

    thin = base.filter(F.col("cnt") < min_samples)
    counted = _probe(thin, base, offsets, d, eps).groupBy("id").agg(F.count("*").alias("near"))
    thin_core = counted.filter(F.col("near") >= min_samples).select("id")
    core = cut_lineage(
        base.filter(F.col("cnt") >= min_samples)
        .unionByName(thin.join(thin_core, "id", "left_semi")))

    names = core.groupBy("cell").agg(F.min("id").alias("node"), F.count("*").alias("cnt"))
    touching = _touching_cells(core, side, d, eps, offsets, direct_pairs).distinct()
    edges = touching.join(names.select(F.col("cell").alias("a"), F.col("node").alias("u")), "a") \
        .join(names.select(F.col("cell").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    comps = connected_components(edges)
    cells = names.join(comps, names["node"] == comps["node"], "left").select(
        "cell", "cnt", F.coalesce("component", names["node"]).alias("component"))
    order = value_counts_ranked(cells.select("component").distinct(), "component")[0] \
        .select("component", F.col("below").cast("int").alias("cluster"))
    cells = cells.join(order, "component")

    labelled = attach_by_value(core.select("id", "x", "cell"), cells.select("cell", "cnt", "cluster"),
                               "cell", total)
    labelled = cut_lineage(labelled.select("id", "x", "cell", "cnt", "cluster"))
    loose = thin.join(labelled.select("id"), "id", "left_anti")
    border = _probe(loose, labelled.withColumnRenamed("cluster", "component"), offsets, d, eps) \
        .groupBy("id").agg(F.min("component").alias("cluster"))
    rest = loose.select("id").join(border, "id", "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.lit(False).alias("is_core"))
    return labelled.select("id", "cluster", F.lit(True).alias("is_core")).unionByName(rest) \
        .withColumnRenamed("id", key)
