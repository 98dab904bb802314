"""A tree of blocks over vectors, and joins that visit only the blocks a row can need.

Equal vectors are one entry. Entries are laid out by their leading principal coordinates: a first
level of cells is learned from a bounded sample, and cells that hold too many entries are cut again
from samples of their own. Each block keeps a box of its entries in the leading coordinates and in the
length of what those leave over, so the distance from a row to a box never exceeds the distance to an
entry inside. The sample only decides the shape of the blocks; every entry is in one, and results that
use the bound are exact.

The driver holds the boxes, at most ``FAN`` * ``FAN`` of them with ``LEAD`` + 1 coordinates. Tables too
large for that many blocks of the wanted size have larger blocks, which are handed to tasks in parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, discard

LEAD = 16               # coordinates of the projection
SAMPLE = 4_096          # rows that shape one level of a cell
FAN = 256               # cells per level
PAIRS = 4_000_000       # numbers held at once by one numpy step
SWEEPS = 24             # parts of the rows that ask in a sweep; each entry goes to each part at most once
HELD = 100_000          # rows that ask which one task of a sweep holds
MEETING = 4_096         # entries that they meet at once
FOUND = 200_000         # results that a task gathers before it merges them


# ---- arrays of vectors ----------------------------------------------------------------

def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors of an Arrow list column as rows; nulls inside become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return values.reshape(len(column), -1)


def vectors(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.float64()))


def rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by one product, a bound of their error per row of ``a``)."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return aa[:, None] + bb[None, :] - 2.0 * (a @ b.T), 1e-12 * (aa + bb.max())


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs are at most ``eps`` apart; doubtful ones are measured coordinate by coordinate."""
    rough, error = rough_squares(a, b)
    near = rough <= eps * eps
    slack = np.maximum(error, 1e-9 * eps * eps)[:, None]
    i, j = np.nonzero(np.abs(rough - eps * eps) <= slack)
    step = max(1, PAIRS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        p, o = i[s:s + step], j[s:s + step]
        near[p, o] = np.sqrt(((a[p] - b[o]) ** 2).sum(axis=1)) <= eps
    return near


# ---- entries --------------------------------------------------------------------------

def entries(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame | None]:
    """((eid, vec, asks, cnt, ids), (id, eid) of the rows whose vector stands more than once, or None).

    ``rows`` has id, vec, asks and gives. An entry is named by its smallest id, asks if one of its rows
    does, and lists the ``keep`` smallest ids of those that give.
    """
    found = cut_lineage(rows.groupBy("vec").agg(
        F.min("id").alias("eid"), F.max("asks").alias("asks"), F.max("gives").alias("gives"), F.count("*").alias("cnt")))
    none = F.array().cast("array<bigint>")
    alone = F.when(F.col("gives"), F.array("eid")).otherwise(none)
    if not found.filter("cnt > 1").limit(1).count():
        return found.select("eid", "vec", "asks", "cnt", alone.alias("ids")), None
    # joined by hash, compared in full: copies may be a third of all rows, and only they are looked up
    several = found.filter("cnt > 1").select("vec", "eid")
    copies = cut_lineage(rows.select("id", "vec", "gives").join(several, "vec").select("id", "eid", "gives"))
    order = Window.partitionBy("eid").orderBy("id")
    # each task passes on at most keep ids of an entry
    least = copies.filter("gives").withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= keep) \
        .groupBy("eid").agg(F.array_sort(F.collect_list("id")).alias("least"))
    listed = found.join(least, "eid", "left").select(
        "eid", "vec", "asks", "cnt", F.when(F.col("cnt") == 1, alone).otherwise(F.coalesce("least", none)).alias("ids"))
    return cut_lineage(listed), copies.select("id", "eid")


# ---- the tree -------------------------------------------------------------------------

def _centres(z: np.ndarray, k: int) -> np.ndarray:
    """k centres of a sample: drawn by squared distance, then moved a few times."""
    rng = np.random.default_rng(42)
    k = min(k, len(z))
    centres = z[[0]]
    gap = ((z - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        if not gap.sum() > 0:
            break
        new = z[rng.choice(len(z), p=gap / gap.sum())]
        centres = np.vstack([centres, new])
        gap = np.minimum(gap, ((z - new) ** 2).sum(axis=1))
    for _ in range(6):
        own = nearest(z, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, z)
        size = np.bincount(own, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(z), np.int64)
    step = max(1, PAIRS // len(centres))
    norms = (centres * centres).sum(axis=1)
    for s in range(0, len(z), step):
        out[s:s + step] = (norms - 2.0 * (z[s:s + step] @ centres.T)).argmin(axis=1)
    return out


@dataclass
class Projection:
    """Leading principal directions of a sample; missing coordinates count as the mean."""

    mean: np.ndarray
    axes: np.ndarray            # d x m, orthonormal columns

    @classmethod
    def learn(cls, x: np.ndarray) -> Projection:
        with np.errstate(all="ignore"):
            mean = np.nan_to_num(np.nanmean(np.where(np.isnan(x), np.nan, x), axis=0) if np.isnan(x).any() else x.mean(axis=0))
        y = np.where(np.isnan(x), 0.0, x - mean)
        axes = np.linalg.svd(y, full_matrices=False)[2][:LEAD].T
        return cls(mean, axes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Leading coordinates, then the length of the rest."""
        y = np.where(np.isnan(x), 0.0, x - self.mean)
        lead = y @ self.axes
        rest = y - lead @ self.axes.T
        return np.column_stack([lead, np.sqrt((rest * rest).sum(axis=1))])


@dataclass
class Blocks:
    """Entries with their block (columns z and block added), and the boxes of the blocks."""

    rows: DataFrame
    lo: np.ndarray              # blocks x coordinates of z
    hi: np.ndarray
    cell: np.ndarray            # the first-level cell of each block
    by: str = "z"               # the column that ``near`` takes
    project: Projection | None = None       # none for a single block

    def __getstate__(self):     # tasks get the boxes alone
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def bound(self, z: np.ndarray, block: int) -> np.ndarray:
        """What an entry of a block is away at least from each row."""
        return _gap(z, self.lo[block], self.hi[block], float(max(np.abs(self.lo).max(), np.abs(self.hi).max())))

    def near(self, z: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, bound) of all blocks that can hold an entry within reach of each row. Cells
        that are too far as a whole are passed over."""
        scale = float(max(np.abs(self.lo).max(), np.abs(self.hi).max()))
        found = []
        for cell in np.unique(self.cell):
            members = np.flatnonzero(self.cell == cell)
            rows = np.arange(len(z))
            if len(members) > 1:
                rows = rows[_gap(z, self.lo[members].min(axis=0), self.hi[members].max(axis=0), scale) <= reach]
            for b in members:
                if not len(rows):
                    break
                bound = _gap(z[rows], self.lo[b], self.hi[b], scale)
                ok = bound <= reach[rows]
                found.append((rows[ok], np.full(int(ok.sum()), b), bound[ok]))
        return _joined(found)


def _joined(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _gap(z: np.ndarray, lo: np.ndarray, hi: np.ndarray, scale: float) -> np.ndarray:
    """Distance to a box, less what rounding may have added."""
    gap = np.maximum(0.0, np.maximum(lo - z, z - hi))
    return np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-9) - 1e-9 * scale


def _placed(rows: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], added: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + added
    names = [*rows.columns, *[x.split()[0] for x in added.split(", ")]]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names)

    return rows.mapInArrow(run, schema)


def build(rows: DataFrame, rows_per_block: int, n: int | None = None) -> Blocks:
    """Blocks of about ``rows_per_block`` of the written table ``rows`` (eid, vec, ...)."""
    n = rows.count() if n is None else n
    wanted = -(-n // rows_per_block)
    if wanted <= 1:
        # one block needs no projection: everything is visited anyway
        return Blocks(rows.withColumns({"z": F.array(F.lit(0.0)).cast("array<double>"), "block": F.lit(0)}), np.zeros((1, 1)), np.zeros((1, 1)),
                      np.zeros(1, np.int64))
    width = len(rows.select("vec").first()[0])
    draw = F.xxhash64("eid", F.lit(42))
    size = min(SAMPLE, max(256, (1 << 22) // width))
    sample = rows.select("vec", draw.alias("h")).orderBy("h").limit(size).collect()
    x = np.array([[np.nan if v is None else v for v in r.vec] for r in sample], dtype="float64")
    project = Projection.learn(x)
    first = _centres(project(x), min(FAN, wanted + wanted // 4, max(1, len(x) // 4)))
    at = rows.columns.index("vec")

    def place(batch):
        z = project(matrix(batch.column(at)))
        return [vectors(z), pa.array(nearest(z, first), pa.int32())]

    celled = cut_lineage(_placed(rows, place, "z array<double>, cell int"))
    sizes = {r.cell: r["count"] for r in celled.groupBy("cell").count().collect()}
    crowded = {c: s for c, s in sizes.items() if s > 1.5 * rows_per_block}
    split: dict[int, np.ndarray] = {}
    if crowded:
        split = _split_cells(celled, crowded, rows_per_block)
    base, cells = {}, []
    for c in sorted(sizes):
        base[c] = len(cells)
        cells += [c] * len(split.get(c, [0]))
    cell_at, z_at = celled.columns.index("cell"), celled.columns.index("z")

    def deal(batch):
        cell, z = np.asarray(batch.column(cell_at)), matrix(batch.column(z_at))
        block = np.empty(len(cell), np.int64)
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            block[own] = base[c] + (nearest(z[own], split[c]) if c in split else 0)
        return [pa.array(block, pa.int32())]

    dealt = _placed(celled, deal, "block int").drop("cell")
    if split:
        placed = cut_lineage(dealt)
        discard(celled)
        dealt = placed
    dims = project.axes.shape[1] + 1
    boxes = dealt.groupBy("block").agg(*[f(F.col("z")[j]).alias(f"{s}{j}") for s, f in (("lo", F.min), ("hi", F.max))
                                         for j in range(dims)]).collect()
    # a block of the sample's centres that no entry chose is a point beside another block
    lo = np.tile([[boxes[0][f"lo{j}"] for j in range(dims)]], (len(cells), 1))
    hi = lo.copy()
    for r in boxes:
        lo[r.block], hi[r.block] = [r[f"lo{j}"] for j in range(dims)], [r[f"hi{j}"] for j in range(dims)]
    return Blocks(dealt, lo, hi, np.array(cells), project=project)


def _split_cells(celled: DataFrame, crowded: dict[int, int], rows_per_block: int) -> dict[int, np.ndarray]:
    """Centres inside each crowded cell, from a sample of its own."""
    size = F.create_map(*[F.lit(v) for kv in crowded.items() for v in kv])[F.col("cell")]
    hashed = F.pmod(F.xxhash64("eid", F.lit(7)), F.lit(1 << 30)).cast("double")
    chosen = celled.filter(size.isNotNull() & (hashed * size < F.lit(float(1 << 30) * SAMPLE))).select("cell", "z", F.col("eid"))
    wanted = {c: min(FAN, -(-s * 5 // (4 * rows_per_block))) for c, s in crowded.items()}

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["cell"].iloc[0])
        z = np.stack(pdf.sort_values("eid")["z"].to_numpy())
        return pd.DataFrame({"cell": c, "centre": [list(v) for v in _centres(z, min(wanted[c], max(1, len(z) // 4)))]})

    out: dict[int, list] = {}
    for r in chosen.groupBy("cell").applyInPandas(centres, "cell int, centre array<double>").collect():
        out.setdefault(r.cell, []).append(r.centre)
    return {c: np.array(sorted(v)) for c, v in out.items()}


# ---- joins that visit blocks ----------------------------------------------------------

def route(asking: DataFrame, blocks: Blocks, nearest_first: int) -> DataFrame:
    """(eid, block) for the ``nearest_first`` nearest blocks, besides its own, that can hold an entry within
    reach of a row (eid, the column that the blocks go by, block, reach).
    """
    near, count = blocks.near, len(blocks.lo)

    def run(batches):
        for batch in batches:
            ids, place, own = np.asarray(batch.column(0)), matrix(batch.column(1)), np.asarray(batch.column(2))
            reach = np.asarray(batch.column(3))
            step = max(1, PAIRS // (8 * count))
            for s in range(0, len(ids), step):
                i, b, bound = near(place[s:s + step], reach[s:s + step])
                mine = own[s:s + step][i]
                ok = b != mine
                i, b, bound = i[ok], b[ok], bound[ok]
                order = np.lexsort((b, bound, i))
                i, b = i[order], b[order]
                begin = np.flatnonzero(np.diff(i, prepend=-1))
                rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
                i, b = i[rank < nearest_first], b[rank < nearest_first]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:s + step][i], pa.int64()), pa.array(b, pa.int32())], ["eid", "block"])

    return asking.select("eid", blocks.by, "block", "reach").mapInArrow(run, "eid long, block int")


def visit(asking: DataFrame, data: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, per_task: int) -> DataFrame:
    """``fn`` over the rows that ask for a block (eid, block, ...) and the entries of that block.

    A block with many entries is handed out in parts, one that many rows want in copies, so no task
    holds more than some ``per_task`` of either; ``fn`` must allow its results to be merged over parts.
    """
    crowd = asking.groupBy("block").agg(F.count("*").alias("askers"))
    sizes = data.groupBy("block").agg(F.count("*").alias("entries"))
    shape = crowd.join(sizes, "block").select(
        "block", F.ceil(F.col("askers") / F.lit(2 * per_task)).cast("int").alias("copies"),
        F.ceil(F.col("entries") / F.lit(2 * per_task)).cast("int").alias("parts"))
    shape = F.broadcast(cut_lineage(shape))                     # one row per block
    left = asking.join(shape, "block") \
        .withColumn("copy", F.pmod(F.xxhash64("eid", F.lit(3)), F.col("copies")).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("copies", "parts")
    right = data.join(shape, "block") \
        .withColumn("part", F.pmod(F.xxhash64("eid", F.lit(5)), F.col("parts")).cast("int")) \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies", "parts")
    # both may come from one table: new column identities keep them apart
    left, right = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (left, right))
    keys = ("block", "part", "copy")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def first_of(keys: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first rows of each group in the order of ``keys``, the most important last."""
    order = np.lexsort((*keys, group))
    begin = np.flatnonzero(np.diff(group[order], prepend=group[order][0] - 1)) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


@dataclass
class Dealt:
    """One partition per part: the rows that ask (columns asks), then the entries that one of them can need
    (columns gives), block by block. ``wanted`` (block, task) lists the parts that a block goes to, none for one block."""

    rows: DataFrame
    asks: list[str]
    gives: list[str]
    tasks: int
    wanted: DataFrame | None


def deal(asking: DataFrame, blocks: Blocks, data: DataFrame, per_task: int, later_only: bool = False, parts: int = SWEEPS) -> Dealt | None:
    """The rows and entries of a sweep, none if no row asks. There are at most ``parts`` parts, or more if one would exceed ``HELD`` rows."""
    crowd = {r.block: r["count"] for r in asking.groupBy("block").count().collect()}
    total = sum(crowd.values())
    if not total:
        return None
    tasks = max(min(parts, -(-total // per_task)), -(-total // HELD))
    home, before = [], 0
    for b in sorted(crowd):
        first, last = before * tasks // total, (before + crowd[b] - 1) * tasks // total
        if crowd[b] * tasks <= total:
            first = last = (before + crowd[b] // 2) * tasks // total
        home.append((b, first, last - first + 1))
        before += crowd[b]
    home = asking.sparkSession.createDataFrame(home, "block int, first int, span int")      # one row per block
    part = F.col("first") + F.pmod(F.xxhash64("eid", F.lit(3)), F.col("span")).cast("int")
    mine = asking.join(F.broadcast(home), "block").withColumn("task", part).drop("first", "span")
    by, near = blocks.by, blocks.near

    def needed(batches):
        for batch in batches:
            task, place, own, reach = np.asarray(batch.column(0)), matrix(batch.column(1)), np.asarray(batch.column(2)), np.asarray(batch.column(3))
            step = max(1, PAIRS // (8 * len(blocks.cell)))
            for s in range(0, len(task), step):
                i, b, _ = near(place[s:s + step], reach[s:s + step])
                ok = b >= own[s:s + step][i] if later_only else np.ones(len(i), bool)
                found = np.unique(np.column_stack([task[s:s + step][i[ok]], b[ok]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1], pa.int32())], ["task", "block"])

    wanted = None
    if len(blocks.cell) == 1:
        theirs = data.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    else:
        wanted = cut_lineage(mine.select("task", by, "block", "reach").mapInArrow(needed, "task int, block int")
                             .groupBy("block").agg(F.collect_set("task").alias("task")))
        theirs = data.join(F.broadcast(wanted), "block").withColumn("task", F.explode("task"))
    asks, gives = list(mine.drop("task").columns), list(data.columns)
    # both may come from one table: new column identities keep them apart
    mine, theirs = (t.select(*[F.col(c).alias(c) for c in t.columns], F.lit(g).alias("gives")) for t, g in ((mine, False), (theirs, True)))
    # rows that ask come first, then entries block by block
    dealt = mine.unionByName(theirs, allowMissingColumns=True).repartitionById(tasks, "task").sortWithinPartitions("gives", "block") \
        .select("gives", *dict.fromkeys(asks + gives))
    return Dealt(dealt, asks, gives, tasks, wanted)


def streamed(batches, asks: list[str], gives: list[str]):
    """Of one part: the rows that ask as one table, then the entries some ``MEETING`` at a time."""
    held, waiting, size, begun = [], [], 0, False
    for batch in batches:
        ask = batch.num_rows - batch.column("gives").true_count
        if ask:
            held.append(batch.slice(0, ask).select(asks))
        if ask == batch.num_rows:
            continue
        if not begun:
            if not held:
                return
            yield pa.Table.from_batches(held).combine_chunks()
            held, begun = [], True
        for s in range(ask, batch.num_rows, MEETING):
            part = batch.slice(s, MEETING).select(gives)
            waiting.append(part)
            size += part.num_rows
            if size >= MEETING:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def sweep(asking: DataFrame, blocks: Blocks, data: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table],
          merge: Callable[[pa.Table], pa.Table], schema: str, per_task: int, later_only: bool = False,
          tighten: Callable[[pa.Table, np.ndarray, pa.Table], np.ndarray] | None = None) -> DataFrame:
    """``merge`` over what ``meet`` finds for the rows that ask (eid, the column that the blocks go by,
    block, reach, ...) in all entries (eid, block, ...) of blocks within their reach.

    The rows that ask are cut into at most ``SWEEPS`` parts along the blocks, or more if a part would
    exceed ``HELD`` rows. A task holds its part while the entries that one of its rows can need stream
    past, so a row is written once and an entry as often as there are parts, however many blocks there are.
    A row meets an entry at most once; it may meet some beyond its reach. ``merge`` is applied again and
    again within a task, and ``tighten`` then gives the reach that is still needed. With ``later_only`` a
    block is met by rows of blocks up to it.
    """
    dealt = deal(asking, blocks, data, per_task, later_only)
    if dealt is None:
        return asking.sparkSession.createDataFrame([], schema)
    by, asks, gives = blocks.by, dealt.asks, dealt.gives

    def run(batches):
        parts = streamed(batches, asks, gives)
        rows = next(parts, None)
        if rows is None:
            return
        place, reach, own = matrix(rows.column(by)), rows.column("reach").to_numpy().copy(), rows.column("block").to_numpy()
        found, count, merged = [], 0, 0
        for entries_ in parts:
            wants = np.zeros(len(place), bool)
            for b in np.unique(entries_.column("block").to_numpy()):
                ok = blocks.bound(place, int(b)) <= reach
                wants |= ok & (own <= b) if later_only else ok
            if not wants.any():
                continue
            some = rows.set_column(rows.column_names.index("reach"), "reach", pa.array(reach))
            got = meet(some if wants.all() else some.filter(pa.array(wants)), entries_)
            if got.num_rows:
                found.append(got)
                count += got.num_rows
            if count - merged > max(FOUND, merged):
                found = [merge(pa.concat_tables(found).combine_chunks())]
                count = merged = found[0].num_rows
                if tighten is not None:
                    reach = tighten(rows, reach, found[0])
        if found:
            yield from merge(pa.concat_tables(found).combine_chunks()).to_batches(10_000)

    return dealt.rows.mapInArrow(run, schema)
