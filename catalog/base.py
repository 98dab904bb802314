"""Table access and the views both engines share.

The given tables are clean, so problems (nulls, copies, outliers, numbers as text) are planted
by key arithmetic. Each view is one SQL text: Spark binds the table names in braces to
parquet scans, the oracle reads the same text with the plain names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def r6(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    out = F.round(c, 6)
    return out.alias(alias or name) if (alias or isinstance(name, str)) else out


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


# part with 10% nulls in each number, null brands and a planted price outlier
PART = """
select p_partkey,
       case when p_partkey % 7 = 0 then null else p_brand end as p_brand,
       p_type,
       p_name,
       case when p_partkey % 10 = 0 then null else cast(p_size as double) end as p_size,
       case when p_partkey % 10 = 3 then null
            when p_partkey % 100 = 1 then p_retailprice * 50
            else p_retailprice end as p_retailprice
from {part}"""

# the same with every 20th row copied under a new key
PART_COPIES = f"""
select * from ({PART}) a
union all
select p_partkey + 100000000, p_brand, p_type, p_name, p_size, p_retailprice
from ({PART}) b where p_partkey % 20 = 0"""

# part without its key: copies are full duplicates, every 97th row is empty
PART_ROWS = f"""
select case when p_partkey % 97 = 0 then null else p_brand end as p_brand,
       case when p_partkey % 97 = 0 then null else p_type end as p_type,
       case when p_partkey % 97 = 0 then null else p_size end as p_size,
       case when p_partkey % 97 = 0 then null else p_retailprice end as p_retailprice,
       cast(null as double) as p_empty,
       case when p_partkey % 97 = 0 then null else cast(1.0 as double) end as p_constant
from ({PART_COPIES}) c"""

# text that is 90% numbers, 70% numbers, 90% dates
TEXTS = """
select o_orderkey,
       case when o_orderkey % 10 = 0 then 'n/a' else cast(o_custkey as varchar(20)) end as mostly_number,
       case when o_orderkey % 10 < 3 then 'n/a' else cast(o_custkey as varchar(20)) end as partly_number,
       case when o_orderkey % 10 = 0 then 'unknown'
            else concat('2024-0', cast(1 + o_orderkey % 9 as varchar(2)), '-02') end as mostly_date,
       o_orderstatus
from {orders}"""

# the first eight coordinates of each embedding as columns, every 10th x1 and 8th x3 missing
POINTS_GAPS = """
select vec_id,
       case when vec_id % 10 = 0 then null else cast(embedding[{i0}] as double) end as x1,
       cast(embedding[{i1}] as double) as x2,
       case when vec_id % 8 = 0 then null else cast(embedding[{i2}] as double) end as x3,
       cast(embedding[{i3}] as double) as x4
from {embeddings}"""


def points_gaps_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark counts array items from 0, the oracle from 1
    sql = POINTS_GAPS
    for j in range(4):
        sql = sql.replace("{i%d}" % j, str(j))
    return view(spark, sf_dir, sql)


def points_gaps_oracle() -> str:
    sql = POINTS_GAPS
    for j in range(4):
        sql = sql.replace("{i%d}" % j, str(j + 1))
    return plain(sql)


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """embeddings as (vec_id, features array<double>, label)."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    if dims:
        vec = F.slice(vec, 1, dims)
    return e.select("vec_id", vec.alias("features"), "label")
