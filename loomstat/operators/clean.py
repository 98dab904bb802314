"""Cleaning: empty rows and columns, names, text to number, text to timestamp."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import aggregate_row, q, text_columns
from ..session import cut_lineage

# The share of rows that must parse, and the number forms that count as one.
PARSE_SHARE = 0.8
DATE_FORMS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "yyyy/M/d H:mm:ss", "MMM d, yyyy", "MMMM d, yyyy",
              "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy")
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def drop_empty_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=list(subset) if subset else None)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep the columns that hold at least one value (one aggregate, then a projection)."""
    seen = aggregate_row(df, df.columns, {"n": F.count})
    return df.select(*[q(c) for c in df.columns if seen[c]["n"] > 0])


def unique_names(names: Sequence[str]) -> list[str]:
    """Second and later uses of a name get the suffixes _1, _2, ... As Spark does not tell names
    apart by case, neither does this; a suffixed name that is taken moves on to the next number."""
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    repeats: dict[str, int] = {}
    out = []
    for name in names:
        new, low = name, name.lower()
        while new.lower() in seen or (new != name and new.lower() in taken):
            repeats[low] = repeats.get(low, 0) + 1
            new = f"{name}_{repeats[low]}"
        seen.add(new.lower())
        out.append(new)
    return out


def rename_duplicates(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def number_or_null(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def timestamp_or_null(c: Column) -> Column:
    """ISO dates and times, then the first of DATE_FORMS that reads the text. A form is only tried on text
    with its signs, or that begins with a digit as it does: a failed try takes microseconds."""
    text = F.trim(c)

    def tried(form: str) -> Column:
        signs = [text.contains(s) for s in "/,-" if s in form] or [text.rlike("^[0-9]")]
        return F.when(reduce(Column.__and__, signs), F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz"))

    return F.coalesce(text.try_cast("timestamp_ntz"), *[tried(form) for form in DATE_FORMS])


def _convert(df: DataFrame, cols: Sequence[str], parse) -> tuple[DataFrame, list[str]]:
    if not cols:
        return df, []
    shares = aggregate_row(df, cols, {"share": lambda c: F.avg(parse(c).isNotNull().cast("int"))})
    chosen = [c for c in cols if (shares[c]["share"] or 0.0) > PARSE_SHARE]
    return df.select(*[parse(q(c)).alias(c) if c in chosen else q(c) for c in df.columns]), chosen


def infer_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Text columns of which more than 80% of all rows are numbers become doubles."""
    return _convert(df, list(cols) if cols is not None else text_columns(df), number_or_null)


def infer_datetime(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Text columns of which more than 80% of all rows are dates become timestamps."""
    return _convert(df, list(cols) if cols is not None else text_columns(df), timestamp_or_null)


def assign_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0..n-1 identity: per-partition numbering plus partition offsets.

    Rows are numbered in the order Spark reads them.
    """
    # written out once: both readers below must see the same partitions in the same order
    tagged = cut_lineage(df.withColumn("__m", F.monotonically_increasing_id()))
    # the upper bits of the id name the partition, the lower 33 count inside it
    part = F.shiftright("__m", 33)
    sizes = tagged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.withColumn("__p", part).join(F.broadcast(offsets), "__p")
            .select((F.col("__o") + inside).alias(name), *[q(c) for c in df.columns]))


def clean(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """All cleaning rules in order; returns the table and one insight per converted column."""
    df = rename_duplicates(drop_empty_columns(drop_empty_rows(df)))
    df, numbers = infer_numeric(df)
    df, dates = infer_datetime(df)
    notes = [("data_type_conversion", f"Column '{c}' converted from text to numeric", "info")
             for c in numbers]
    notes += [("data_type_conversion", f"Column '{c}' identified as datetime", "info")
              for c in dates]
    return df, notes


def drop_noise(labels: DataFrame, label: str = "cluster") -> DataFrame:
    return labels.filter(F.col(label) != -1)


def distinct_labels(labels: DataFrame, label: str = "cluster") -> DataFrame:
    return labels.select(label).distinct()
