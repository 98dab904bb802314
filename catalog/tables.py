"""Scans, cleaning and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import clean, profile
from loomstat.sources import readers

from .base import PART, PART_ROWS, TEXTS, plain, rounded, table, view

PART_ROWS_SQL = plain(PART_ROWS)
PART_SQL = plain(PART)
TEXTS_SQL = plain(TEXTS)
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def scan_parquet(spark, d):
    return readers.load_table(spark, f"{d}/part.parquet").df


def json_flatten_events(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props"))
    return readers.flatten(e).withColumnRenamed("props.k", "props_k")


def drop_empty_rows(spark, d):
    return clean.drop_empty_rows(view(spark, d, PART_ROWS))


def drop_empty_columns(spark, d):
    return clean.drop_empty_columns(view(spark, d, PART_ROWS))


def infer_numeric(spark, d):
    return clean.infer_numeric(view(spark, d, TEXTS))[0]


def infer_datetime(spark, d):
    return clean.infer_datetime(view(spark, d, TEXTS), ["mostly_date", "o_orderstatus"])[0]


def filter_noise(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label")).alias("cluster"))
    return clean.drop_noise(e)


def distinct_labels(spark, d):
    return clean.distinct_labels(table(spark, d, "embeddings"), "label")


def profile_missing(spark, d):
    return rounded(profile.profile_missing(view(spark, d, PART_ROWS)), "missing_percentage")


def null_fraction_by_column(spark, d):
    return rounded(profile.null_fraction_by_column(view(spark, d, PART_ROWS)), "null_fraction")


def profile_summary(spark, d):
    return profile.profile_summary(table(spark, d, "lineitem"))


def duplicate_rows(spark, d):
    return profile.duplicate_rows(view(spark, d, PART_ROWS))


def profile_skewness(spark, d):
    return rounded(profile.profile_skewness(table(spark, d, "events").select("value", "user_id")),
                   "skewness")


def constant_columns(spark, d):
    return profile.constant_columns(view(spark, d, PART_ROWS))


def cardinality(spark, d):
    return profile.cardinality(table(spark, d, "lineitem"))


def data_summary(spark, d):
    return rounded(profile.data_summary(view(spark, d, PART_ROWS)), "missing_percentage")


def summary_statistics(spark, d):
    s = profile.summary_statistics(table(spark, d, "lineitem"),
                                   ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(s, "mean", "stddev", "min", "q1", "median", "q3", "max")


QUERIES = {f.__name__: f for f in (
    scan_parquet, json_flatten_events, drop_empty_rows, drop_empty_columns, infer_numeric,
    infer_datetime, filter_noise, distinct_labels, profile_missing, null_fraction_by_column,
    profile_summary, duplicate_rows, profile_skewness, constant_columns, cardinality,
    data_summary, summary_statistics)}

_COLS = ["p_brand", "p_type", "p_size", "p_retailprice", "p_empty", "p_constant"]
_MISSING = " + ".join(f"case when {c} is null then 1 else 0 end" for c in _COLS)
_ALL_LINEITEM = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                 "l_discount l_tax l_returnflag l_linestatus l_shipdate").split()


def _skew_sql(c, source):
    return f"""select '{c}' as "column", round(skew, 6) as skewness,
        coalesce(abs(skew) > 1, false) as is_skewed
      from (select (sum(power(x - m, 3)) / count(*)) / power(sum(power(x - m, 2)) / count(*), 1.5) as skew
            from (select cast({c} as double) as x, avg(cast({c} as double)) over () as m
                  from {source}) a) b"""


ORACLE = {
    "scan_parquet": "select * from part",
    "json_flatten_events": """select event_id, cast(json_extract(props, '$.k') as bigint) as props_k
        from events""",
    "drop_empty_rows": f"""select * from ({PART_ROWS_SQL}) t
        where not (p_brand is null and p_type is null and p_size is null and p_retailprice is null
                   and p_empty is null and p_constant is null)""",
    "drop_empty_columns": f"""select p_brand, p_type, p_size, p_retailprice, p_constant
        from ({PART_ROWS_SQL}) t""",
    "infer_numeric": f"""select o_orderkey, try_cast(mostly_number as double) as mostly_number,
        partly_number, mostly_date, o_orderstatus from ({TEXTS_SQL}) t""",
    "infer_datetime": f"""select o_orderkey, mostly_number, partly_number,
        try_cast(mostly_date as timestamp) as mostly_date, o_orderstatus from ({TEXTS_SQL}) t""",
    "filter_noise": """select * from (select vec_id, case when vec_id % 9 = 0 then -1 else label end
        as cluster from embeddings) t where cluster <> -1""",
    "distinct_labels": "select distinct label from embeddings",
    "profile_missing": f"""select sum({_MISSING})::bigint as missing_values,
        count(*) * 6 as total_cells,
        round(sum({_MISSING}) * 100.0 / (count(*) * 6), 6) as missing_percentage
        from ({PART_ROWS_SQL}) t""",
    "null_fraction_by_column": " union all ".join(
        f"""select '{c}' as "column", round(avg(case when {c} is null then 1.0::double else 0 end), 6)
        as null_fraction from ({PART_ROWS_SQL}) t""" for c in _COLS),
    "profile_summary": """select count(*) as rows, 11 as columns, 8 as numeric_columns,
        2 as categorical_columns, 1 as datetime_columns from lineitem""",
    "duplicate_rows": f"""select (select count(*) from ({PART_ROWS_SQL}) t) -
        (select count(*) from (select distinct * from ({PART_ROWS_SQL}) u) v) as duplicate_rows""",
    "profile_skewness": _skew_sql("value", "events") + " union all " + _skew_sql("user_id", "events"),
    "constant_columns": f"""select 'p_constant' as "column", min(p_constant) as value
        from ({PART_ROWS_SQL}) t having min(p_constant) = max(p_constant)""",
    "cardinality": " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as n_unique from lineitem"""
        for c in _ALL_LINEITEM),
    "data_summary": f"""select count(*) as rows, 6 as columns, sum({_MISSING})::bigint as missing_values,
        round(sum({_MISSING}) * 100.0 / (count(*) * 6), 6) as missing_percentage,
        4 as numeric_columns, 2 as categorical_columns, 0 as datetime_columns,
        count(*) - (select count(*) from (select distinct * from ({PART_ROWS_SQL}) u) v)
        as duplicate_rows from ({PART_ROWS_SQL}) t""",
    "summary_statistics": " union all ".join(
        f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean,
        round(stddev_samp({c}), 6) as stddev, round(min({c}), 6) as min,
        round(quantile_cont({c}, 0.25), 6) as q1, round(quantile_cont({c}, 0.5), 6) as median,
        round(quantile_cont({c}, 0.75), 6) as q3, round(max({c}), 6) as max from lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")),
}
