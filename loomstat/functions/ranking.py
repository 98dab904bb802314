"""Global ranks and prefix sums without a single-partition window.

A window without PARTITION BY sends the table to one task. Here equal values are first
merged (map-side combined, so a value held by a third of the rows is one row), the merged
rows are spread over value ranges, each range is numbered on its own, and the ranges are
stitched together by a prefix sum over one row per range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

ROWS_PER_RANGE = 200_000
MAX_RANGES = 20_000


def range_edges(df: DataFrame, value: str, ranges: int) -> list[float]:
    """Increasing split points that cut ``value`` into at most ``ranges`` similar ranges."""
    if ranges <= 1:
        return []
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), at, 20 * ranges)).first()[0]
    return sorted(set(row)) if row else []


def with_range(df: DataFrame, value: str, edges: list[float], out: str) -> DataFrame:
    """Append the index of the range ``value`` falls into (deterministic in the value)."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    tmp = f"__{out}"
    spread = Bucketizer(splits=splits, inputCol=f"{tmp}v", outputCol=tmp, handleInvalid="keep")
    return (spread.transform(df.withColumn(f"{tmp}v", F.col(value).cast("double")))
            .withColumn(out, F.col(tmp).cast("int")).drop(tmp, f"{tmp}v"))


def ranges_for(rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    return max(1, min(MAX_RANGES, math_ceil(rows, rows_per_range)))


def math_ceil(a: int, b: int) -> int:
    return -(-a // b)


def value_counts_ranked(df: DataFrame, value: str,
                        rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """((value, cnt, below), total): how many rows hold each value, how many hold a smaller one."""
    merged = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("cnt"))
    total = df.agg(F.count(value)).first()[0]
    edges = range_edges(df, value, ranges_for(total, rows_per_range))
    spread = with_range(merged, value, edges, "range")
    # one row per range: the only window without PARTITION BY runs over at most MAX_RANGES rows
    offsets = (spread.groupBy("range").agg(F.sum("cnt").alias("in_range"))
               .withColumn("before", F.coalesce(F.sum("in_range").over(
                   Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("range", "before"))
    inside = Window.partitionBy("range").orderBy(value)
    ranked = (spread
              .withColumn("upto", F.sum("cnt").over(
                  inside.rowsBetween(Window.unboundedPreceding, 0)))
              .join(F.broadcast(offsets), "range")
              .select(value, "cnt", (F.col("before") + F.col("upto") - F.col("cnt")).alias("below")))
    return ranked, total


def attach_by_value(rows: DataFrame, table: DataFrame, value: str, total: int,
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Join ``rows`` to a (value, cnt, ...) table with one row per value.

    Values held by more than ``total / ranges`` rows number at most ``ranges``; only these
    are broadcast. All other values are rare enough for an ordinary join.
    """
    ranges = ranges_for(total, rows_per_range)
    if ranges == 1:
        return rows.join(table, value)
    table = cut_lineage(table)          # read three times below
    heavy = F.broadcast(table.filter(F.col("cnt") * ranges > total))
    light = table.filter(F.col("cnt") * ranges <= total)
    hot = rows.join(heavy, value)
    cold = rows.join(heavy.select(value), value, "left_anti").join(light, value)
    return hot.unionByName(cold)
