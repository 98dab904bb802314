"""The tables behind each chart: bounded summaries, computed where the data is."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import aggregate_row, as_double, numeric_columns, q
from ..functions.quantiles import IN_MEMORY_VALUES, exact_quantiles, grouped_quantiles
from .prep import IQR_FACTOR

# Fixed values of the charts.
BINS = 50
CORRELATION_COLUMNS = 10
HEATMAP_COLUMNS = 10


def missing_matrix(df: DataFrame, key: str, buckets: int | None = None,
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Which cells are missing: one row per (column, row), or the missing share per
    (column, row bucket) when ``buckets`` bounds the picture."""
    cols = list(cols or [c for c in df.columns if c != key])
    flags = [q(c).isNull().cast("int").alias(c) for c in cols]
    if buckets is None:
        return df.select(q(key).alias("row"), *flags).unpivot(
            ["row"], [q(c) for c in cols], "column", "missing")
    at = aggregate_row(df, [key], {"lo": F.min, "hi": F.max})[key]
    if at["lo"] is None:
        lo, width = 0, 1.0
    else:
        lo, width = at["lo"], max(1.0, (at["hi"] - at["lo"] + 1) / buckets)
    bucket = F.floor((q(key) - F.lit(lo)) / F.lit(float(width))).cast("int").alias("bucket")
    shares = df.select(bucket, *flags).groupBy("bucket").agg(*[F.avg(q(c)).alias(c) for c in cols])
    return shares.unpivot(["bucket"], [q(c) for c in cols], "column", "missing_share")


def bin_index(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin; the largest value belongs to the last bin."""
    width = (hi - lo) / bins
    if width == 0:
        return F.lit(0)
    return F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = BINS, by: str | None = None) -> DataFrame:
    """(bin, lo, hi, count) for the non-empty equal-width bins, split by ``by`` if given."""
    at = aggregate_row(df, [column], {"lo": lambda c: F.min(c.cast("double")),
                                      "hi": lambda c: F.max(c.cast("double"))})[column]
    lo, hi = at["lo"] or 0.0, at["hi"] or 0.0
    width = (hi - lo) / bins
    keys = ["bin"] + ([by] if by else [])
    rows = df.filter(q(column).isNotNull()).withColumn("bin", bin_index(as_double(column), lo, hi, bins))
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).select(
        *keys, (F.lit(lo) + F.col("bin") * width).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "count")


def _fences(df: DataFrame, value: str, by: str, large: int) -> tuple[DataFrame, DataFrame, list]:
    """Quartiles per group: (few large groups, all other groups, the large groups).

    A group beyond ``large`` rows is measured by bounded passes over masked columns; there are
    at most rows / large of them. The others fit one aggregation buffer each.
    """
    probs = [0.25, 0.5, 0.75]
    kind = dict(df.dtypes)[by]
    rows = df.filter(q(by).isNotNull() & q(value).isNotNull())
    hot = [r[0] for r in rows.groupBy(q(by).alias("g")).agg(F.count("*").alias("n"))
           .filter(F.col("n") > large).collect()]
    found = grouped_quantiles(rows, by, value, probs, hot, large) if hot else {}
    names = ["q1", "median", "q3"]
    big = df.sparkSession.createDataFrame(
        [(g, *v) for g, v in found.items()], f"g {kind}, q1 double, median double, q3 double")
    rest = rows.filter(~q(by).isin(hot)) if hot else rows
    p = F.percentile(as_double(value), F.array(*[F.lit(x) for x in probs]))
    small = rest.groupBy(q(by).alias("g")).agg(p.alias("p")).select(
        "g", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    return big, small, hot


def box_stats(df: DataFrame, value: str, by: str | None = None,
              large: int = IN_MEMORY_VALUES) -> DataFrame:
    """(group, count, q1, median, q3, whisker_low, whisker_high): whiskers are the outermost
    values within 1.5 IQR of the box."""
    v = as_double(value)
    inside = v.between(F.col("q1") - IQR_FACTOR * (F.col("q3") - F.col("q1")),
                       F.col("q3") + IQR_FACTOR * (F.col("q3") - F.col("q1")))

    def summary(rows: DataFrame) -> DataFrame:
        return rows.groupBy("g", "q1", "median", "q3").agg(
            F.count(v).alias("count"), F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high")).select(
            F.col("g").alias(by or "group"), "count", "q1", "median", "q3", "whisker_low",
            "whisker_high")

    if by is None:
        quart = exact_quantiles(df, [value], [0.25, 0.5, 0.75], large)[value] or [None] * 3
        return summary(df.select(q(value), F.lit(None).cast("string").alias("g"), *[
            F.lit(x).cast("double").alias(n) for x, n in zip(quart, ("q1", "median", "q3"))]))
    big, small, hot = _fences(df, value, by, large)
    rows = df.select(q(by).alias("g"), q(value))
    cold = summary((rows.filter(~F.col("g").isin(hot)) if hot else rows).join(small, "g"))
    if not hot:
        return cold
    return cold.unionByName(summary(rows.filter(F.col("g").isin(hot)).join(F.broadcast(big), "g")))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(x, y, correlation) for all column pairs over the rows where both are present.

    Every task reduces its rows to four d x d matrices (counts, sums, squares, products, taken
    around the column means for accuracy), so one scan serves all pairs whatever their gaps.
    Undefined correlations (a constant column) are NULL.
    """
    cols = list(cols or numeric_columns(df)[:CORRELATION_COLUMNS])
    if len(cols) < 2:
        raise ValueError("need at least 2 numeric columns")
    d = len(cols)
    at = aggregate_row(df, cols, {"m": lambda c: F.avg(c.cast("double")),
                                  "lo": lambda c: F.min(c.cast("double")),
                                  "hi": lambda c: F.max(c.cast("double"))})
    centre = np.array([at[c]["m"] or 0.0 for c in cols])
    flat = [at[c]["lo"] is None or at[c]["lo"] == at[c]["hi"] for c in cols]

    def partial(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        slots = np.arange(4 * d * d, dtype="int32")
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.ravel())], ["slot", "v"])

    sums = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(cols)]) \
        .mapInArrow(partial, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(4 * d * d)
    for r in sums:
        total[r.slot] = r.v
    n, s, ss, p = total.reshape(4, d, d)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            value = None
            if not (flat[i] or flat[j]) and n[i, j] > 0:
                # s[i, j]: sum of column i over the rows where column j is present
                cov = p[i, j] - s[i, j] * s[j, i] / n[i, j]
                spread = (ss[i, j] - s[i, j] ** 2 / n[i, j]) * (ss[j, i] - s[j, i] ** 2 / n[i, j])
                value = float(cov / np.sqrt(spread)) if spread > 0 else None
            rows.append((a, b, 1.0 if i == j and value is not None else value))
    return df.sparkSession.createDataFrame(rows, "x string, y string, correlation double")


def pair_histogram(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """(x_bin, y_bin, count): the 2-D histogram of two columns."""
    at = aggregate_row(df, [x, y], {"lo": lambda c: F.min(c.cast("double")),
                                    "hi": lambda c: F.max(c.cast("double"))})
    present = df.filter(q(x).isNotNull() & q(y).isNotNull())
    return present.groupBy(
        bin_index(as_double(x), at[x]["lo"] or 0.0, at[x]["hi"] or 0.0, bins).alias("x_bin"),
        bin_index(as_double(y), at[y]["lo"] or 0.0, at[y]["hi"] or 0.0, bins).alias("y_bin"),
    ).agg(F.count("*").alias("count"))


def pair_histograms(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """The 2-D histogram of every column pair, from one scan for all pairs.

    A row gives one record per pair, merged map-side into at most bins * bins per pair.
    """
    at = aggregate_row(df, list(cols), {"lo": lambda c: F.min(c.cast("double")),
                                        "hi": lambda c: F.max(c.cast("double"))})
    binned = df.select(*[bin_index(as_double(c), at[c]["lo"] or 0.0, at[c]["hi"] or 0.0, bins)
                         .alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), q(a).alias("x_bin"),
                               q(b).alias("y_bin")) for a, b in combinations(cols, 2)])
    return (binned.select(F.explode(cells).alias("c")).select("c.*")
            .filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
            .groupBy("x", "y", "x_bin", "y_bin").agg(F.count("*").alias("count")))


def projection(embedding: DataFrame, labels: DataFrame, key: str, dims: int = 2) -> DataFrame:
    """The first ``dims`` components with the cluster label as text, joined by key."""
    comps = [c for c in embedding.columns if c != key][:dims]
    return embedding.select(key, *comps).join(
        labels.select(key, F.col("cluster").cast("string").alias("cluster")), key)


def score_by_index(scores: DataFrame, key: str) -> DataFrame:
    return scores.select(q(key).alias("sample"), "anomaly_score", "is_anomaly")


def score_histogram(scores: DataFrame, bins: int = BINS) -> DataFrame:
    return histogram(scores, "anomaly_score", bins, by="is_anomaly")


def anomaly_features(features: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Feature rows of the anomalous samples."""
    return features.join(scores.filter("is_anomaly").select(key), key, "left_semi")


def anomaly_heatmap(features: DataFrame, scores: DataFrame, key: str,
                    limit: int = HEATMAP_COLUMNS) -> DataFrame:
    """(key, feature, value) of the anomalous samples over the first numeric columns."""
    cols = numeric_columns(features, exclude=[key])[:limit]
    rows = anomaly_features(features, scores, key).select(key, *[as_double(c).alias(c) for c in cols])
    return rows.unpivot([key], [q(c) for c in cols], "feature", "value")
