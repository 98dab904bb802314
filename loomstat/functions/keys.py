"""Operators that work on dense or wide integer ids, made usable with any key column."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.clean import assign_row_id
from ..session import cut_lineage
from .columns import q


def is_integral(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def any_key(*outputs: str) -> Callable:
    """For a function of (df, key, ...): rows of a table whose key is not an integer are numbered
    first, and the key put back into the named output columns (default: the key itself)."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(df: DataFrame, key: str, *args, **options) -> DataFrame:
            if is_integral(df, key):
                return fn(df, key, *args, **options)
            table = cut_lineage(assign_row_id(df, "__id"))
            out = fn(table.drop(key).withColumnRenamed("__id", key), key, *args, **options)
            for c in outputs or (key,):
                names = table.select(F.col("__id").alias("__at"), q(key).alias("__name"))
                out = out.join(names, q(c) == F.col("__at")).select(
                    *[F.col("__name").alias(c) if x == c else q(x) for x in out.columns])
            return out
        return run
    return wrap
