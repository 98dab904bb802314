"""Sums of distances in one or two dimensions without measuring every pair.

The sum of the distances from a point to many far ones is smooth. Points sit in the leaves of a tree of
boxes; near leaves are measured pair by pair, and a box whose gap is at least as wide as itself and the leaf
that asks is met through its Chebyshev nodes: its points hand their number to the nodes by polynomials of
degree ``NODES`` - 1, and the sums at the nodes of the leaf are read off by the same polynomials. The error
falls as (2 + 5 ** 0.5) ** -NODES; a sum came out right to 1e-11 of itself, where distances by one product
have nine digits. No point is left out, and the work grows with the rows, not with their square.

The driver holds the boxes, of at most some ``LEAVES`` leaves (larger tables have larger leaves), and which
of them meet. A bounded sample only decides where boxes are cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .blocks import HELD, PAIRS, SWEEPS, matrix, vectors

NODES = 12              # Chebyshev nodes per dimension
APART = 2.0             # gap between boxes that meet through nodes, in halves of the wider one
LEAF = 1_000            # points of a leaf
LEAVES = 4_096
SAMPLE = 65_536         # points that decide where boxes are cut
WIDTH = 2               # dimensions; nodes are a power of it
COLUMNS = 64            # clusters of all labelings together
FEWEST = 20_000         # rows from which the tree is worth its steps

_K = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_T = np.cos(np.arange(NODES)[:, None] * np.arccos(_K)[None, :])     # degree x node


class Tree:
    """Cuts of space: a node has ``dim`` -1 if it is a leaf; the boxes are those of the points inside."""

    def __init__(self, z: np.ndarray, share: float, leaf: float):
        self.dim, self.cut, self.child, self.parent = [], [], [], []
        todo = [(z, -1, 0)]
        while todo:
            x, parent, side = todo.pop()
            here = len(self.dim)
            self.dim.append(-1), self.cut.append(0.0), self.child.append([-1, -1]), self.parent.append(parent)
            if parent >= 0:
                self.child[parent][side] = here
            if len(x) * share <= leaf:
                continue
            lo, hi = x.min(axis=0), x.max(axis=0)
            j = int((hi - lo).argmax())
            middle = lo[j] + (hi[j] - lo[j]) / 2
            if not lo[j] <= middle < hi[j]:
                continue
            self.dim[here], self.cut[here] = j, float(middle)
            left = x[:, j] <= middle
            todo += [(x[~left], here, 1), (x[left], here, 0)]
        self.dim, self.cut, self.child, self.parent = map(np.array, (self.dim, self.cut, self.child, self.parent))

    def place(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            go = np.flatnonzero(self.dim[at] >= 0)
            if not len(go):
                return at
            right = x[go, self.dim[at[go]]] > self.cut[at[go]]
            at[go] = self.child[at[go], right.astype(int)]

    def bound(self, leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The boxes, from those of the leaves that hold points; children are numbered after their parent."""
        self.lo, self.hi = np.full((len(self.dim), lo.shape[1]), np.inf), np.full((len(self.dim), lo.shape[1]), -np.inf)
        self.lo[leaves], self.hi[leaves] = lo, hi
        for i in range(len(self.dim) - 1, 0, -1):
            p = self.parent[i]
            self.lo[p], self.hi[p] = np.minimum(self.lo[p], self.lo[i]), np.maximum(self.hi[p], self.hi[i])

    def meetings(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((leaf, node) that meet through nodes, (leaf, leaf) that are measured)."""
        far, near = [], []
        a, b = leaves, np.zeros(len(leaves), np.int64)
        while len(a):
            gap = np.sqrt((np.maximum(0.0, np.maximum(self.lo[a] - self.hi[b], self.lo[b] - self.hi[a])) ** 2).sum(axis=1))
            half = np.maximum((self.hi[a] - self.lo[a]).max(axis=1), (self.hi[b] - self.lo[b]).max(axis=1)) / 2
            apart = (gap > 0) & (gap >= APART * half)
            end = ~apart & (self.dim[b] < 0)
            far.append(np.column_stack([a[apart], b[apart]]))
            near.append(np.column_stack([a[end], b[end]]))
            more = ~apart & ~end
            a, b = np.repeat(a[more], 2), self.child[b[more]].ravel()
            some = np.isfinite(self.lo[b, 0])
            a, b = a[some], b[some]
        return np.concatenate(far), np.concatenate(near)

    def nodes(self, box: int) -> np.ndarray:
        """The Chebyshev nodes of a box."""
        middle, half = (self.lo[box] + self.hi[box]) / 2, (self.hi[box] - self.lo[box]) / 2
        axes = np.meshgrid(*[m + h * _K for m, h in zip(middle, half)], indexing="ij")
        return np.column_stack([a.ravel() for a in axes])

    def weights(self, x: np.ndarray, box: int) -> np.ndarray:
        """What each node counts for points of a box: points x nodes."""
        out = np.ones((len(x), 1))
        for j in range(x.shape[1]):
            middle, half = (self.lo[box, j] + self.hi[box, j]) / 2, (self.hi[box, j] - self.lo[box, j]) / 2
            t = np.clip((x[:, j] - middle) / half, -1.0, 1.0) if half > 0 else np.zeros(len(x))
            one = (1.0 + 2.0 * np.cos(np.arccos(t)[:, None] * np.arange(1, NODES)) @ _T[1:]) / NODES
            out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
        return out


def add_distances(out: np.ndarray, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> None:
    """Adds the distances from each x to all y times their counts, by column."""
    step = max(1, PAIRS // 8 // max(1, len(y)))
    for s in range(0, len(x), step):
        d = np.subtract.outer(x[s:s + step, 0], y[:, 0])
        if x.shape[1] == 1:
            np.abs(d, out=d)
        else:
            d *= d
            for j in range(1, x.shape[1]):
                e = np.subtract.outer(x[s:s + step, j], y[:, j])
                e *= e
                d += e
            np.sqrt(d, out=d)
        out[s:s + step] += d @ counts


def totals(tree: Tree, x: np.ndarray, leaf: int, near: list[tuple[np.ndarray, np.ndarray]], far: list[tuple[int, np.ndarray]], columns: int) -> np.ndarray:
    """Distances from the points x of a leaf, summed by column, to the points (y, counts) of near leaves and the nodes (box, counts) of far boxes."""
    out = np.zeros((len(x), columns))
    for y, counts in near:
        add_distances(out, x, y, counts)
    if far:
        by_nodes = len(x) > NODES ** x.shape[1]
        at = tree.nodes(leaf) if by_nodes else x
        sums = np.zeros((len(at), columns))
        for s in range(0, len(far), 16):
            add_distances(sums, at, np.concatenate([tree.nodes(b) for b, _ in far[s:s + 16]]), np.concatenate([c for _, c in far[s:s + 16]]))
        out += tree.weights(x, leaf) @ sums if by_nodes else sums
    return out


def suits(rows: DataFrame, n: int) -> bool:
    """Whether rows (id, vec, labels) are many, of few dimensions and clusters, and without missing coordinates."""
    if n < FEWEST:
        return False
    ok = F.aggregate("vec", F.lit(True), lambda a, v: a & F.coalesce((v > F.lit(-1e150)) & (v < F.lit(1e150)), F.lit(False)))
    r = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.min(F.coalesce(ok, F.lit(False))).alias("ok")).first()
    if not (r.ok and r.least == r.most and 1 <= r.most <= WIDTH):
        return False
    return rows.select(F.posexplode("labels").alias("labeling", "own")).filter("own is not null").distinct().limit(COLUMNS + 1).count() <= COLUMNS


def nearness(rows: DataFrame) -> DataFrame:
    """(vec, labeling, own, a, b, size) for each different one of the rows (id, vec, labels): the mean distance to the
    others of its cluster, the least mean distance to another cluster, and the rows of its cluster."""
    spark = rows.sparkSession
    points = cut_lineage(rows.select("vec", F.posexplode("labels").alias("labeling", "own")).filter("own is not null")
                         .groupBy("vec", "labeling", "own").agg(F.count("*").alias("n")))
    sizes = points.groupBy("labeling", "own").agg(F.sum("n").alias("n"), F.count("*").alias("points")).orderBy("labeling", "own").collect()
    column = {(r.labeling, r.own): i for i, r in enumerate(sizes)}
    which, size, count = np.array([r.labeling for r in sizes]), np.array([float(r.n) for r in sizes]), sum(r.points for r in sizes)
    if not sizes:
        return points.select("vec", "labeling", "own", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), "n").limit(0)
    sample = points.select("vec").orderBy(F.xxhash64("vec", "labeling", "own")).limit(SAMPLE).collect()
    z = np.array([r.vec for r in sample], dtype="float64")
    tree, width = Tree(z, count / len(z), max(LEAF, count / LEAVES)), z.shape[1]

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                own = [column[k] for k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), batch.column(3), pa.array(tree.place(matrix(batch.column(0))), pa.int32())],
                                                 ["vec", "col", "n", "leaf"])

    placed = cut_lineage(points.select("vec", "labeling", "own", "n").mapInArrow(deal, "vec array<double>, col int, n long, leaf int"))
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.col("vec")[j]).alias(f"{s}{j}") for s, f in (("lo", F.min), ("hi", F.max))
                                                                   for j in range(width)]).orderBy("leaf").collect()
    leaves = np.array([r.leaf for r in boxes])
    tree.bound(leaves, *[np.array([[r[f"{s}{j}"] for j in range(width)] for r in boxes]) for s in ("lo", "hi")])
    far, near = tree.meetings(leaves)

    # parts of leaves that lie together, as nodes are numbered down each side of a cut
    tasks = max(min(SWEEPS, len(leaves)), -(-count // HELD))
    before = np.cumsum([0] + [r.n for r in boxes])
    task = np.zeros(len(tree.dim), np.int64)
    task[leaves] = (before[:-1] * tasks) // before[-1]
    used = np.zeros(len(tree.dim), bool)
    used[far[:, 1]] = True

    def moments(t: pa.Table) -> pa.Table:
        """Of a leaf, what it adds to its own nodes and those of the boxes around it."""
        x, leaf = matrix(t.column("vec")), int(t.column("leaf")[0].as_py())
        col, n = t.column("col").to_numpy(), t.column("n").to_numpy().astype(float)
        kinds = np.unique(col)
        member = (col[:, None] == kinds) * n[:, None]
        boxes_, cols, sums = [], [], []
        b = leaf
        while b >= 0:
            if used[b]:
                m = np.zeros((NODES ** width, len(kinds)))
                for s in range(0, len(x), LEAF):
                    m += tree.weights(x[s:s + LEAF], b).T @ member[s:s + LEAF]
                boxes_ += [b] * len(kinds)
                cols += kinds.tolist()
                sums += [c.tobytes() for c in np.ascontiguousarray(m.T)]
            b = int(tree.parent[b])
        return pa.table([pa.array(boxes_, pa.int32()), pa.array(cols, pa.int32()), pa.array(sums, pa.binary())], names=["node", "col", "sums"])

    def added(t: pa.Table) -> pa.Table:
        col = t.column("col").to_numpy()
        sums = np.frombuffer(b"".join(t.column("sums").to_pylist())).reshape(len(col), -1)
        kinds = np.unique(col)
        return pa.table([pa.array(np.full(len(kinds), t.column("node")[0].as_py()), pa.int32()), pa.array(kinds, pa.int32()),
                         pa.array([sums[col == k].sum(axis=0).tobytes() for k in kinds], pa.binary())], names=["node", "col", "sums"])

    schema = "node int, col int, sums binary"
    summed = placed.groupBy("leaf").applyInArrow(moments, schema).groupBy("node").applyInArrow(added, schema)

    def to_tasks(pairs: np.ndarray, name: str) -> DataFrame:
        ways = np.unique(np.column_stack([pairs[:, 1], task[pairs[:, 0]]]), axis=0)
        return F.broadcast(spark.createDataFrame([(int(a), int(b)) for a, b in ways], f"{name} int, task int"))

    # a point takes part where it is near, a box where it is far
    theirs = placed.join(to_tasks(near, "leaf"), "leaf").select("task", F.col("leaf").alias("node"), "col", "n", "vec", F.lit(None).cast("binary").alias("sums"))
    boxed = summed.join(to_tasks(far, "node"), "node").select("task", "node", "col", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("vec"), "sums")
    dealt = theirs.unionByName(boxed).repartitionById(tasks, "task").select("task", "node", "col", "n", "vec", "sums")
    order = [p[np.argsort(p[:, 0], kind="stable")] for p in (near, far)]

    def met(pairs: np.ndarray, leaf: int) -> list[int]:
        return pairs[slice(*np.searchsorted(pairs[:, 0], [leaf, leaf + 1])), 1].tolist()

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        mine = t.column("task")[0].as_py()
        node, col, n = t.column("node").to_numpy(), t.column("col").to_numpy(), t.column("n").to_numpy()
        boxed_ = np.array(t.column("vec").is_null())
        where: dict[int, np.ndarray] = {}
        far_at: dict[int, np.ndarray] = {}
        for found, some in ((where, np.flatnonzero(~boxed_)), (far_at, np.flatnonzero(boxed_))):
            some = some[np.argsort(node[some], kind="stable")]
            names, begin = np.unique(node[some], return_index=True)
            found.update(zip(names.tolist(), np.split(some, begin[1:])))
        # equal points of several clusters or labelings are measured once
        points_, asks = {}, {}
        for k, at in where.items():
            x = matrix(t.column("vec").take(pa.array(at)))
            different, back = np.unique(x, axis=0, return_inverse=True)
            counts = np.zeros((len(different), len(size)))
            np.add.at(counts, (back.ravel(), col[at]), n[at])
            points_[k], asks[k] = (different, counts), (back.ravel(), col[at], n[at])
        sums = t.column("sums")
        masses = {}
        for k, at in far_at.items():
            m = np.zeros((NODES ** width, len(size)))
            for i in at:
                m[:, col[i]] = np.frombuffer(sums[int(i)].as_py())
            masses[k] = m
        for leaf in leaves[task[leaves] == mine].tolist():
            x = points_[leaf][0]
            got = totals(tree, x, leaf, [points_[b] for b in met(order[0], leaf)], [(b, masses[b]) for b in met(order[1], leaf)], len(size))
            back, own, _ = asks[leaf]
            mean = got[back] / size
            same = which[own][:, None] == which
            rows_ = np.arange(len(own))
            same[rows_, own] = False
            b = np.where(same, mean, np.inf).min(axis=1)
            lone = size[own] <= 1
            a = got[back, own] / np.maximum(size[own] - 1, 1)
            yield pa.RecordBatch.from_arrays(
                [vectors(x[back]), pa.array(own, pa.int32()), pa.array(a, mask=lone), pa.array(b, mask=~np.isfinite(b)), pa.array(size[own].astype(np.int64))],
                ["vec", "col", "a", "b", "size"])

    scored = cut_lineage(dealt.mapInArrow(run, "vec array<double>, col int, a double, b double, size long"))
    names = spark.createDataFrame([(i, *k) for k, i in column.items()], "col int, labeling int, own int")
    return scored.join(F.broadcast(names), "col").select("vec", "labeling", "own", "a", "b", "size")
