"""Isolation forest (Liu 2008): trees grown in parallel tasks, rows scored where they are.

Every tree is grown from at most 256 rows, so the whole forest is small: its node tables go
to the driver and from there to all tasks. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.quantiles import exact_quantiles
from .neighbors import stack

# Fixed values of the forest.
TREES = 100
SAMPLE_ROWS = 256
SEED = 42
EULER_GAMMA = 0.5772156649015329


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree over n rows."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Node table (feature or -1, threshold, left, right, depth + mean path below)."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
        part = x[rows]
        if depth < limit and len(rows) > 1:
            lo, hi = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(usable):
                j = int(rng.choice(usable))
                at = float(rng.uniform(lo[j], hi[j]))
                goes = part[:, j] <= at
                left, right = add(rows[goes], depth + 1), add(rows[~goes], depth + 1)
                nodes[me] = [j, at, left, right, 0.0]
        return me

    add(np.arange(len(x)), 0)
    return np.array(nodes, dtype="float64")


def path_lengths(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Path length of each row in one tree: row sets split from the root down, so a node costs
    one comparison over the rows that reach it."""
    out = np.empty(len(x))
    columns = np.ascontiguousarray(x.T)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        feature, threshold, left, right, path = nodes[at]
        if feature < 0:
            out[rows] = path
            continue
        goes = columns[int(feature)][rows] <= threshold
        for child, part in ((int(left), rows[goes]), (int(right), rows[~goes])):
            if len(part):
                todo.append((child, part))
    return out


@dataclass
class Forest:
    trees: list[np.ndarray]
    sample: int

    def score(self, df: DataFrame, key: str, features: str = "features") -> DataFrame:
        """(key, raw_score) in [-1, 0): lower is more anomalous."""
        trees, norm = self.trees, float(average_path(self.sample)) or 1.0

        def batch(batches):
            for pdf in batches:
                if not len(pdf):
                    yield pd.DataFrame({key: pdf[key], "raw_score": pd.Series(dtype="float64")})
                    continue
                x = stack(pdf["__vec"])
                depth = sum(path_lengths(x, t) for t in trees) / len(trees)
                yield pd.DataFrame({key: pdf[key], "raw_score": -np.power(2.0, -depth / norm)})

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, F.col(features).cast("array<double>").alias("__vec")) \
            .mapInPandas(batch, f"`{key}` {kind}, raw_score double")


def fit_forest(df: DataFrame, key: str, features: str = "features", trees: int = TREES,
               sample: int = SAMPLE_ROWS, seed: int = SEED, rows: int | None = None) -> Forest:
    """Grow the trees; each draws ``sample`` of all rows without replacement by a hash of (key, tree)."""
    rows = df.count() if rows is None else rows
    if rows < 2:
        raise ValueError("the forest needs at least 2 rows")
    sample = min(sample, rows)
    # the smallest hashes win; those beyond twice the wanted number (and some) cannot be among them,
    # so each row leaves the scan only for the trees that may draw it
    enough = min(1.0, (2.0 * sample + 200) / rows)
    draws = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 40)).alias("h"))),
        lambda d: d["h"] < F.lit(int(enough * (1 << 40))))
    drawn = (df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("vec"))
             .withColumn("d", F.explode(draws)).select("id", "vec", "d.tree", "d.h"))
    order = Window.partitionBy("tree").orderBy("h", "id")
    drawn = drawn.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes = grow(stack(pdf.sort_values("rn")["vec"]), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        return out.assign(tree=tree, node=np.arange(len(out)))

    table = drawn.groupBy("tree").applyInPandas(
        build, "feature double, threshold double, left double, right double, path double, "
               "tree int, node int").toPandas()
    cols = ["feature", "threshold", "left", "right", "path"]
    grown = [part.sort_values("node")[cols].to_numpy() for _t, part in table.groupby("tree")]
    return Forest(grown, sample)


def contamination_threshold(scores: DataFrame, score: str, contamination: float) -> float:
    """The score below which a row is anomalous: the contamination quantile of all scores."""
    found = exact_quantiles(scores, [score], [contamination])[score]
    if found is None:
        raise ValueError("no scores")
    return found[0]
