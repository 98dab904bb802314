"""Profiling and quality aggregates; every one is a single scan unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (aggregate_long, as_double, chunks, datetime_columns,
                                 numeric_columns, pack, q, side_by_side, text_columns)
from ..session import cut_lineage

BROADCAST_FINGERPRINTS = 1_000_000


def missing_cells(cols: Sequence[str]) -> Column:
    """Number of missing cells of one row; a balanced sum, so wide tables plan safely."""
    terms = [q(c).isNull().cast("int") for c in cols] or [F.lit(0)]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
    return terms[0]


def profile_missing(df: DataFrame) -> DataFrame:
    """Missing cells, all cells and the percentage (0 for an empty table)."""
    cells = F.count("*") * F.lit(len(df.columns))
    missing = F.coalesce(F.sum(missing_cells(df.columns).cast("long")), F.lit(0))
    return df.agg(missing.alias("missing_values"), cells.alias("total_cells")).select(
        "missing_values", "total_cells",
        F.coalesce(F.try_divide(F.col("missing_values") * 100.0, F.col("total_cells")), F.lit(0.0))
        .alias("missing_percentage"))


def null_fraction_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return aggregate_long(df, list(cols or df.columns),
                          {"null_fraction": lambda c: F.avg(c.isNull().cast("double"))})


def profile_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).alias("datetime_columns"))


def _fingerprints(df: DataFrame) -> list[Column]:
    """128 bits of each row in two numbers; equal rows have equal ones."""
    # -0.0 equals 0.0, and hashing passes over nulls, so where they stand is hashed as well
    same = [q(f.name) + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else q(f.name) for f in df.schema]
    gaps = F.concat_ws("", F.array(*[q(c).isNull().cast("int").cast("string") for c in df.columns]))
    return [F.xxhash64(F.lit(1), *same).alias("__f1"), F.xxhash64(F.lit(2), gaps, *same).alias("__f2")]


def repeated_rows(df: DataFrame) -> DataFrame:
    """The rows that stand several times, each once with their number ``__copies``.

    Only fingerprints of all rows are shuffled; whole rows are compared where a fingerprint stands twice.
    Types that cannot be hashed are compared as they are.
    """
    keys, _back = pack(df, df.columns)
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema) or not df.columns:
        rows = df
    else:
        first, second = _fingerprints(df)
        marked = df.withColumns({"__f1": first, "__f2": second})
        twice = cut_lineage(marked.groupBy("__f1", "__f2").agg(F.count("*").alias("n")).filter("n > 1").select("__f1", "__f2"))
        found = F.broadcast(twice) if twice.count() <= BROADCAST_FINGERPRINTS else twice
        rows = marked.join(found, ["__f1", "__f2"], "left_semi").drop("__f1", "__f2")
    return rows.groupBy(*keys).agg(F.count("*").alias("__copies")).filter("__copies > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    return repeated_rows(df).agg(
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_skewness(df: DataFrame, limit: int = 5, threshold: float = 1.0) -> DataFrame:
    """Population skewness of the first ``limit`` numeric columns."""
    cols = numeric_columns(df)[:limit]
    stats = aggregate_long(df, cols, {"skewness": lambda c: F.skewness(c.cast("double"))})
    return stats.withColumn("is_skewed", F.coalesce(F.abs("skewness") > threshold, F.lit(False)))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns whose non-null values are all equal."""
    stats = aggregate_long(df, list(cols or numeric_columns(df)), {
        "lo": lambda c: F.min(c.cast("double")), "hi": lambda c: F.max(c.cast("double"))})
    return stats.filter(F.col("lo") == F.col("hi")).select("column", F.col("lo").alias("value"))


def cardinality(df: DataFrame, cols: Sequence[str] | None = None,
                approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact counting merges (column, value) pairs before the shuffle, so only distinct values
    travel and no column is counted in one task; ``approximate`` uses a fixed-size sketch.
    """
    cols = list(cols or df.columns)
    if approximate:
        return aggregate_long(df, cols, {"n_unique": F.approx_count_distinct})
    # columns of one type travel together, so no value is turned into text to be compared
    kinds: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        if name in cols:
            kinds.setdefault(kind, []).append(name)
    result = None
    for same in kinds.values():
        for part in chunks(same):
            pairs = (df.select(*[q(c) for c in part]).unpivot([], [q(c) for c in part], "column", "value")
                     .groupBy("column", "value").agg(F.count("value").alias("n")))
            counted = pairs.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
            result = counted if result is None else result.unionByName(counted)
    return result


def input_bytes(df: DataFrame) -> DataFrame:
    """Size of the files behind ``df`` (one row per file is aggregated, nothing else)."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def data_summary(df: DataFrame, attempts: Sequence[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """The full one-row profile: counts, roles, missing cells and duplicates. With the ``attempts`` of a
    load they are listed, and with the table as it was read (``files``) its files and bytes are counted."""
    counted = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(missing_cells(df.columns).cast("long")), F.lit(0)).alias("missing_values"))
    cells = F.col("rows") * F.lit(len(df.columns))
    parts = [counted, duplicate_rows(df)] + ([input_bytes(files)] if files is not None else [])
    more = (["files", "bytes"] if files is not None else []) + (
        [F.array(*[F.lit(a) for a in attempts]).cast("array<string>").alias("load_attempts")] if attempts is not None else [])
    return side_by_side(*parts).select(
        "rows", F.lit(len(df.columns)).alias("columns"), "missing_values",
        F.coalesce(F.try_divide(F.col("missing_values") * 100.0, cells), F.lit(0.0))
        .alias("missing_percentage"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).alias("datetime_columns"),
        "duplicate_rows", *more)


def summary_statistics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sd, min, quartiles, max per numeric column."""
    from .prep import quartile_rows
    cols = list(cols or numeric_columns(df))
    moments = aggregate_long(df.select(*[as_double(c).alias(c) for c in cols]), cols, {
        "count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max})
    return moments.join(F.broadcast(quartile_rows(df, cols)), "column").select(
        "column", "count", "mean", "stddev", "min", "q1", "median", "q3", "max")
