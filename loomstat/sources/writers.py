"""Sinks: one directory of part files per exported table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import q


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: arrays, maps and structs are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(q(f.name)).alias(f.name) if isinstance(f.dataType, nested)
                       else q(f.name) for f in df.schema])


def _iso(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO strings."""
    def text(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(q(f.name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(q(f.name), "yyyy-MM-dd").alias(f.name)
        return q(f.name)
    return df.select(*[text(f) for f in df.schema])


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    if fmt == "csv":
        _iso(_flat(df)).write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        _iso(df).write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
    return path


def export_tables(tables: dict[str, DataFrame], out: str, fmt: str = "csv") -> dict[str, str]:
    return {name: write_table(df, f"{out.rstrip('/')}/{name}", fmt)
            for name, df in tables.items()}


def export_log(log: DataFrame, out: str, session_id: str) -> str:
    return write_table(log, f"{out.rstrip('/')}/pipeline_log_{session_id}", "csv")
