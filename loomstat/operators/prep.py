"""Preprocessing operators.

Statistics are learned in a few fused aggregates and enter the transforming projection as
literals, so every transform is a map over the rows: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (CHUNK, aggregate_row, as_double, categorical_columns, chunks,
                                 long_form, numeric_columns, pack, q)
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import range_edges, ranges_for, with_range

# Fixed values of the adaptive rules.
HIGH_MISSING = 0.5
IQR_FACTOR = 1.5
LOW_VARIANCE = 0.01
ONE_HOT_LIMIT = 50
HASH_BUCKETS = 100
MISSING_LABEL = "Missing"
ZSCORE_LIMIT = 3.0


def replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place, keeping the column order."""
    return df.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])


# ---- missing values -------------------------------------------------------------------

def null_fractions(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    got = aggregate_row(df, cols, {"f": lambda c: F.avg(c.isNull().cast("double"))})
    return {c: (m["f"] or 0.0) for c, m in got.items()}


def drop_high_missing(df: DataFrame, threshold: float = HIGH_MISSING) -> DataFrame:
    """Drop numeric columns of which at least ``threshold`` of the rows are missing."""
    missing = null_fractions(df, numeric_columns(df))
    return df.select(*[q(c) for c in df.columns if missing.get(c, 0.0) < threshold])


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: (v[0] if v else None) for c, v in exact_quantiles(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: Sequence[str] | None = None,
                  fitted: dict[str, float | None] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else numeric_columns(df)
    fitted = fitted if fitted is not None else medians(df, cols)
    return replace(df, {c: F.coalesce(as_double(c), F.lit(fitted[c])) for c in cols})


def impute_categorical(df: DataFrame, cols: Sequence[str] | None = None,
                       label: str = MISSING_LABEL) -> DataFrame:
    cols = list(cols) if cols is not None else categorical_columns(df)
    return replace(df, {c: F.coalesce(q(c).cast("string"), F.lit(label)) for c in cols})


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) over several text columns from one scan; equal values merge map-side."""
    result = None
    for part in chunks(cols):
        counted = (df.select(*[q(c).cast("string").alias(c) for c in part])
                   .unpivot([], [q(c) for c in part], "column", "value")
                   .filter(F.col("value").isNotNull())
                   .groupBy("column", "value").agg(F.count("*").alias("n")))
        result = counted if result is None else result.unionByName(counted)
    return result


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest value."""
    best = value_counts(df, cols).groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {r["column"]: r["mode"] for r in best.collect()}


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else categorical_columns(df)
    fitted = modes(df, cols)
    return replace(df, {c: F.coalesce(q(c).cast("string"), F.lit(fitted.get(c))) for c in cols})


def forward_fill(df: DataFrame, value: str, order: str, tie: str,
                 partition: str | None = None, rows_per_range: int = 200_000) -> DataFrame:
    """Carry the last seen value forward in (order, tie) order, per ``partition`` if given.

    Each partition value is cut into ranges of ``order``; a range fills itself, and takes
    what it cannot fill from the last value of the ranges before it. The carried values are
    one row per (partition, range), so a partition value with most of the rows is spread
    over many tasks.
    """
    micros = F.unix_micros(F.col(order).cast("timestamp")) \
        if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
    work = df.withColumn("__at", micros.cast("double"))
    edges = range_edges(work, "__at", ranges_for(work.count(), rows_per_range))
    work = with_range(work, "__at", edges, "__range")
    keys = [partition] if partition else []
    seen = F.col(value).isNotNull()
    ends = work.groupBy(*keys, "__range").agg(
        F.max_by(F.when(seen, F.col(value)),
                 F.when(seen, F.struct(F.col(order), F.col(tie)))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__range") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__range",
                          F.last("__last", ignorenulls=True).over(earlier).alias("__carry"))
    within = Window.partitionBy(*keys, "__range").orderBy(order, tie) \
        .rowsBetween(Window.unboundedPreceding, 0)
    filled = work.join(carried, [*keys, "__range"]) if not keys else work.alias("w").join(
        carried.alias("c"),
        F.col(f"w.{partition}").eqNullSafe(F.col(f"c.{partition}"))
        & (F.col("w.__range") == F.col("c.__range"))).select("w.*", "c.__carry")
    filled = filled.withColumn(value, F.coalesce(
        F.last(value, ignorenulls=True).over(within), F.col("__carry")))
    return filled.select(*[q(c) for c in df.columns])


def drop_missing_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


# ---- duplicates -----------------------------------------------------------------------

def dedupe_rows(df: DataFrame, key: str) -> DataFrame:
    """Keep the row with the smallest key of each set of equal rows (key not compared).

    Equal rows merge before the shuffle, so a row copied millions of times is no hot spot.
    """
    cols = [c for c in df.columns if c != key]
    keys, back = pack(df, cols)
    at = df.columns.index(key)
    return df.groupBy(*keys).agg(F.min(q(key)).alias(key)).select(*back[:at], q(key), *back[at:])


# ---- outliers -------------------------------------------------------------------------

def quartile_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, q1, median, q3, iqr): O(columns) rows."""
    found = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, *v, v[2] - v[0]) for c, v in found.items() if v]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, iqr double")


def iqr_bounds(df: DataFrame, cols: Sequence[str],
               factor: float = IQR_FACTOR) -> dict[str, tuple[float, float]]:
    found = exact_quantiles(df, cols, [0.25, 0.75])
    return {c: (v[0] - factor * (v[1] - v[0]), v[1] + factor * (v[1] - v[0]))
            for c, v in found.items() if v}


def cap_column(c: str, lo: float, hi: float) -> Column:
    # greatest/least skip nulls, so a missing value must be kept out explicitly
    v = as_double(c)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def iqr_cap(df: DataFrame, cols: Sequence[str] | None = None,
            bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else numeric_columns(df)
    bounds = bounds if bounds is not None else iqr_bounds(df, cols)
    return replace(df, {c: cap_column(c, *bounds[c]) for c in cols if c in bounds})


def outside(c: str, lo: float, hi: float) -> Column:
    v = as_double(c)
    return (v < F.lit(lo)) | (v > F.lit(hi))


def count_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Values outside their bounds, per column, from one scan."""
    cols = list(bounds)
    if len(cols) > CHUNK:
        lo = F.array(*[F.lit(bounds[c][0]) for c in cols])
        hi = F.array(*[F.lit(bounds[c][1]) for c in cols])
        v, at = F.col("value"), F.col("pos")
        got = long_form(df.select(*[as_double(c).alias(c) for c in cols]), cols).groupBy("pos").agg(
            F.count_if((v < lo[at]) | (v > hi[at])).alias("n")).collect()
        found = {cols[r.pos]: r.n for r in got}
        return {c: found.get(c, 0) for c in cols}
    if not cols:
        return {}
    row = df.agg(*[F.count_if(outside(c, *bounds[c])).alias(f"o{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"o{i}"] for i, c in enumerate(cols)}


def outlier_counts(df: DataFrame, cols: Sequence[str] | None = None,
                   bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, outliers) against the IQR bounds."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    bounds = bounds if bounds is not None else iqr_bounds(df, cols)
    return df.sparkSession.createDataFrame(list(count_outside(df, bounds).items()),
                                           "column string, outliers long")


def iqr_filter(df: DataFrame, cols: Sequence[str] | None = None,
               bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Drop rows with any value outside the IQR bounds; missing values do not count."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    bounds = bounds if bounds is not None else iqr_bounds(df, cols)
    keep = F.lit(True)
    for c in cols:
        keep = keep & ~F.coalesce(outside(c, *bounds[c]), F.lit(False))
    return df.filter(keep)


def zscore_filter(df: DataFrame, cols: Sequence[str] | None = None,
                  limit: float = ZSCORE_LIMIT) -> DataFrame:
    """Drop rows with a value more than ``limit`` population sd from the mean."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    stats = moments(df, cols)
    keep = F.lit(True)
    for c in cols:
        mean, sd = stats[c]
        keep = keep & F.coalesce(F.abs(as_double(c) - F.lit(mean)) <= F.lit(limit * sd), F.lit(True))
    return df.filter(keep)


# ---- variance and scaling -------------------------------------------------------------

def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    got = aggregate_row(df, cols, {"mean": lambda c: F.avg(c.cast("double")),
                                   "sd": lambda c: F.stddev_pop(c.cast("double"))})
    return {c: (m["mean"] or 0.0, m["sd"] or 0.0) for c, m in got.items()}


def low_variance_columns(df: DataFrame, cols: Sequence[str],
                         threshold: float = LOW_VARIANCE) -> list[str]:
    """Columns whose population variance is at most ``threshold``; none if all would go."""
    got = aggregate_row(df, cols, {"v": lambda c: F.var_pop(c.cast("double"))})
    low = [c for c in cols if (got[c]["v"] or 0.0) <= threshold]
    return [] if len(low) == len(cols) else low


def variance_filter(df: DataFrame, cols: Sequence[str] | None = None,
                    threshold: float = LOW_VARIANCE, min_columns: int = 10) -> DataFrame:
    """Drop low-variance numeric columns of a table with more than ``min_columns`` of them."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if len(cols) <= min_columns:
        return df
    low = set(low_variance_columns(df, cols, threshold))
    return df.select(*[q(c) for c in df.columns if c not in low])


def scaled(c: str, centre: float, spread: float) -> Column:
    return (as_double(c) - F.lit(centre)) / F.lit(spread if spread else 1.0)


def standard_parameters(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    return moments(df, cols)


def robust_parameters(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    found = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return {c: (v[1], v[2] - v[0]) if v else (0.0, 0.0) for c, v in found.items()}


def minmax_parameters(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    got = aggregate_row(df, cols, {"lo": lambda c: F.min(c.cast("double")),
                                   "hi": lambda c: F.max(c.cast("double"))})
    return {c: (m["lo"] or 0.0, (m["hi"] or 0.0) - (m["lo"] or 0.0)) for c, m in got.items()}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return replace(df, {c: scaled(c, *fitted[c]) for c in fitted})


def scale_standard(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return apply_scale(df, standard_parameters(df, cols or numeric_columns(df)))


def scale_robust(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return apply_scale(df, robust_parameters(df, cols or numeric_columns(df)))


def scale_minmax(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """To [0, 1]; a constant column becomes 0."""
    return apply_scale(df, minmax_parameters(df, cols or numeric_columns(df)))


# ---- encoding -------------------------------------------------------------------------

def categories(df: DataFrame, cols: Sequence[str],
               limit: int = ONE_HOT_LIMIT) -> dict[str, tuple[int, list[str] | None]]:
    """{column: (distinct values, sorted values or None above ``limit``)}.

    Only columns at or under the limit bring their values to the driver.
    """
    if not cols:
        return {}
    counts = value_counts(df, cols)
    sizes = {r["column"]: r["n"] for r in
             counts.groupBy("column").agg(F.count("*").alias("n")).collect()}
    low = [c for c in cols if sizes.get(c, 0) <= limit]
    values: dict[str, list[str]] = {c: [] for c in low}
    if low:
        for r in value_counts(df, low).select("column", "value").collect():
            values[r["column"]].append(r["value"])
    return {c: (sizes.get(c, 0), sorted(values[c]) if c in values else None) for c in cols}


def one_hot_columns(c: str, values: Sequence[str]) -> list[Column]:
    """Boolean column per category but the first."""
    return [F.coalesce(q(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
            for v in values[1:]]


def one_hot(df: DataFrame, cols: Sequence[str], limit: int = ONE_HOT_LIMIT) -> DataFrame:
    found = categories(df, cols, limit)
    too_many = [c for c in cols if found[c][1] is None]
    if too_many:
        raise ValueError(f"more than {limit} categories in {too_many}")
    kept = [q(c) for c in df.columns if c not in cols]
    return df.select(*kept, *[x for c in cols for x in one_hot_columns(c, found[c][1])])


def hash_bucket(c: Column, method: str = "md5", buckets: int = HASH_BUCKETS) -> Column:
    if method == "xxhash64":
        return F.pmod(F.xxhash64(c), F.lit(buckets))
    head = F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")
    return head % F.lit(buckets)


def hash_encode(df: DataFrame, cols: Sequence[str], method: str = "md5") -> DataFrame:
    """Replace each column by ``<column>_hash`` in 0..99."""
    kept = [q(c) for c in df.columns if c not in cols]
    return df.select(*kept, *[hash_bucket(q(c), method).alias(f"{c}_hash") for c in cols])
