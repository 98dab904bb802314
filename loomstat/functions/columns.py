"""Column roles, NaN handling and chunked wide aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# An aggregate over more expressions than this spends its time in planning and code
# generation, so wide tables are aggregated in column chunks (each chunk reads only
# its own columns).
CHUNK = 100


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
            and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Everything the pipeline treats as a category: all non-numeric scalar columns."""
    scalar = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema
            if isinstance(f.dataType, scalar) and f.name not in exclude]


def q(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in float columns becomes NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(q(c)), q(c)).alias(c) if c in floats else q(c) for c in df.columns])


def chunks(cols: Sequence[str], size: int = CHUNK) -> list[list[str]]:
    return [list(cols[i:i + size]) for i in range(0, len(cols), size)]


def same_kind(df: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    """Columns grouped by data type, each group fit for one array."""
    kinds: dict[str, list[str]] = {}
    types = dict(df.dtypes)
    for c in cols:
        kinds.setdefault(types[c], []).append(c)
    return list(kinds.values())


def long_form(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(pos, value) for columns of one type; merged again before any shuffle by its users."""
    return df.select(F.posexplode(F.array(*[q(c) for c in cols])).alias("pos", "value"))


def aggregate_row(df: DataFrame, cols: Sequence[str],
                  measures: dict[str, Callable[[Column], Column]]) -> dict[str, dict]:
    """{column: {measure: value}} from one scan, O(columns) on the driver.

    Up to CHUNK columns it is one wide aggregate. Wider tables are aggregated in long form
    by column position, which plans in constant time and merges map-side.
    """
    out: dict[str, dict] = {}
    if len(cols) > CHUNK:
        for same in same_kind(df, cols):
            got = long_form(df, same).groupBy("pos").agg(
                *[fn(F.col("value")).alias(m) for m, fn in measures.items()]).collect()
            seen = {r["pos"]: {m: r[m] for m in measures} for r in got}
            empty = None
            for i, c in enumerate(same):
                if i not in seen and empty is None:
                    empty = df.limit(0).agg(*[fn(q(c)).alias(m) for m, fn in measures.items()]) \
                        .first().asDict()
                out[c] = seen.get(i, empty)
        return out
    if not cols:
        return out
    row = df.agg(*[
        F.struct(*[fn(q(c)).alias(m) for m, fn in measures.items()]).alias(f"s{i}")
        for i, c in enumerate(cols)]).first()
    return {c: row[f"s{i}"].asDict() for i, c in enumerate(cols)}


def aggregate_long(df: DataFrame, cols: Sequence[str],
                   measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One output row (column, measure...) per input column, from one scan."""
    if len(cols) > CHUNK:
        result = None
        for same in same_kind(df, cols):
            names = F.array(*[F.lit(c) for c in same])
            part = long_form(df, same).groupBy("pos").agg(
                *[fn(F.col("value")).alias(m) for m, fn in measures.items()]) \
                .select(names[F.col("pos")].alias("column"), *measures)
            result = part if result is None else result.unionByName(part)
        return result
    wide = df.agg(*[
        F.struct(F.lit(c).alias("column"),
                 *[fn(q(c)).alias(m) for m, fn in measures.items()]).alias(f"s{i}")
        for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(cols))])))


def pack(df: DataFrame, cols: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """(keys, columns): what to group by so that equal rows meet, and how to get the columns
    back. Wide tables are keyed by one array per data type instead of by thousands of columns."""
    if len(cols) <= CHUNK:
        return [q(c) for c in cols], [q(c) for c in cols]
    keys, back = [], {}
    for i, same in enumerate(same_kind(df, cols)):
        keys.append(F.array(*[q(c) for c in same]).alias(f"__k{i}"))
        back.update({c: F.col(f"__k{i}")[j].alias(c) for j, c in enumerate(same)})
    return keys, [back[c] for c in cols]


def as_double(c: str) -> Column:
    return q(c).cast("double")


def vector_of(cols: Sequence[str]) -> Column:
    """Feature vector as array<double>; nulls stay null inside the array."""
    return F.array(*[as_double(c) for c in cols])


def feature_matrix(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(key, features array<double>) over the numeric columns; at least two are needed."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[key])
    if len(cols) < 2:
        raise ValueError(f"need at least 2 numeric columns, found {len(cols)}")
    return df.select(q(key).alias(key), vector_of(cols).alias("features"))


def side_by_side(*tables: DataFrame) -> DataFrame:
    """One-row tables as one row."""
    out = None
    for t in tables:
        keyed = t.withColumn("__one", F.lit(1))
        out = keyed if out is None else out.join(keyed, "__one")
    return out.drop("__one")
