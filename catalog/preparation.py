"""Preprocessing operators and the adaptive pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import neighbors, prep
from loomstat.plans.preprocess import AdaptivePreprocessor, summary_row

from .base import (PART, PART_COPIES, PART_ROWS, plain, points_gaps_oracle, points_gaps_spark,
                   rounded, table, view)

NUM = ["p_size", "p_retailprice"]
PART_SQL, COPIES_SQL, ROWS_SQL = plain(PART), plain(PART_COPIES), plain(PART_ROWS)

# one column that is two thirds missing
SPARSE = f"""select p_partkey, p_brand, p_size,
       case when p_partkey % 3 <> 0 then null else p_retailprice end as p_sparse
from ({PART}) s"""

# thirteen numeric columns, some nearly flat, one constant
WIDE = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, cast(1.0 as double) as flat, l_discount * 2 as d2, l_tax * 3 as t3,
       l_quantity / 1000 as q_small, l_linenumber * 0.01 as n_small
from {lineitem}"""

EVENTS_GAPS = """
select event_id, user_id, ts, case when event_id % 3 <> 0 then null else value end as value
from {events}"""


def drop_high_missing(spark, d):
    return prep.drop_high_missing(view(spark, d, SPARSE))


def impute_median(spark, d):
    return rounded(prep.impute_median(view(spark, d, PART), NUM), *NUM)


def impute_knn(spark, d):
    gaps = points_gaps_spark(spark, d)
    cols = ["x1", "x2", "x3", "x4"]
    return rounded(neighbors.impute_knn(gaps, "vec_id", cols), *cols)


def impute_knn_new_rows(spark, d):
    """All rows as new ones, filled by the whole table as a fitted imputer would hold it, through several blocks."""
    gaps = points_gaps_spark(spark, d)
    cols = ["x1", "x2", "x3", "x4"]
    return rounded(neighbors.impute_knn(gaps, "vec_id", cols, donors=gaps, rows_per_block=200), *cols)


def impute_categorical(spark, d):
    return prep.impute_categorical(view(spark, d, PART), ["p_brand", "p_type"])


def impute_mode(spark, d):
    return prep.impute_mode(view(spark, d, PART), ["p_brand", "p_type"])


def forward_fill(spark, d):
    df = prep.forward_fill(view(spark, d, EVENTS_GAPS), "value", "ts", "event_id", "user_id")
    return df.select("event_id", "user_id", "value")


def drop_missing_rows(spark, d):
    return prep.drop_missing_rows(view(spark, d, PART))


def dedupe_rows(spark, d):
    return prep.dedupe_rows(view(spark, d, PART_COPIES), "p_partkey")


def quartiles(spark, d):
    df = prep.quartile_rows(table(spark, d, "lineitem"),
                            ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(df, "q1", "median", "q3", "iqr")


def iqr_cap(spark, d):
    return rounded(prep.iqr_cap(view(spark, d, PART), NUM), *NUM)


def outlier_counts(spark, d):
    return prep.outlier_counts(view(spark, d, PART), NUM)


def iqr_filter(spark, d):
    return prep.iqr_filter(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars"])


def variance_filter(spark, d):
    df = prep.variance_filter(view(spark, d, WIDE))
    return rounded(df, *[c for c in df.columns if c in ("d2", "t3", "q_small", "n_small")])


def _scale(fn):
    def run(spark, d):
        return rounded(fn(view(spark, d, PART).select("p_partkey", *NUM), NUM), *NUM)
    return run


def zscore_filter(spark, d):
    return prep.zscore_filter(table(spark, d, "events").select("event_id", "value"), ["value"])


def one_hot(spark, d):
    return prep.one_hot(view(spark, d, PART).select("p_partkey", "p_type"), ["p_type"])


def hash_encode(spark, d):
    return prep.hash_encode(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"])


def _fit(spark, d):
    return AdaptivePreprocessor("p_partkey", imputer="median").fit(view(spark, d, PART_COPIES))


def adaptive_pipeline(spark, d):
    return rounded(_fit(spark, d).fitted_table, *NUM)


def adaptive_pipeline_knn(spark, d):
    """All choices automatic, on four columns, where the imputer is that by nearest rows."""
    model = AdaptivePreprocessor("vec_id").fit(points_gaps_spark(spark, d))
    if model.imputer != "knn":
        raise ValueError(f"the rows were filled by {model.imputer}")
    return rounded(model.fitted_table, "x1", "x2", "x3", "x4")


def preprocessing_summary(spark, d):
    return summary_row(_fit(spark, d), spark)


QUERIES = {
    **{f.__name__: f for f in (
        drop_high_missing, impute_median, impute_knn, impute_knn_new_rows, impute_categorical, impute_mode, forward_fill,
        drop_missing_rows, dedupe_rows, quartiles, iqr_cap, outlier_counts, iqr_filter,
        variance_filter, zscore_filter, one_hot, hash_encode, adaptive_pipeline, adaptive_pipeline_knn,
        preprocessing_summary)},
    "scale_standard": _scale(prep.scale_standard),
    "scale_robust": _scale(prep.scale_robust),
    "scale_minmax": _scale(prep.scale_minmax),
}


def _per_column(sql, cols):
    return " union all ".join(sql.format(c=c) for c in cols)


def _scale_sql(centre, spread):
    parts = ", ".join(
        f"round(({c} - s.c_{c}) / coalesce(nullif(s.s_{c}, 0), 1), 6) as {c}" for c in NUM)
    stats = ", ".join(f"{centre.format(c=c)} as c_{c}, {spread.format(c=c)} as s_{c}" for c in NUM)
    return f"""with t as ({PART_SQL}), s as (select {stats} from t)
        select p_partkey, {parts} from t, s"""


_Q1, _Q3 = "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.75)"
_BRANDS = sorted([f"Brand#{i}" for i in range(1, 26)] + ["Missing"])
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_KNN_COLS = ["x1", "x2", "x3", "x4"]

# nan-Euclidean distance between rows a and b: squared gaps over shared columns, scaled to 4
_GAP = " + ".join(f"coalesce(power(a.{c} - b.{c}, 2), 0)" for c in _KNN_COLS)
_SHARED = " + ".join(
    f"case when a.{c} is null or b.{c} is null then 0 else 1 end" for c in _KNN_COLS)


def _knn_fill(c, donors="true"):
    return f"""select a.vec_id, avg(b.{c}) as v from (
          select a.vec_id, b.vec_id as donor, b.{c},
                 row_number() over (partition by a.vec_id
                   order by sqrt(4.0 * ({_GAP}) / ({_SHARED})), b.vec_id) as rn
          from t a, t b where a.{c} is null and b.{c} is not null and {donors}) a, t b
        where a.rn <= 5 and b.vec_id = a.donor group by a.vec_id"""


_FILLED = f"""filled as (
    select p_partkey, coalesce(p_brand, 'Missing') as p_brand, p_type, p_name,
           coalesce(p_size, (select quantile_cont(p_size, 0.5) from raw)) as p_size,
           coalesce(p_retailprice, (select quantile_cont(p_retailprice, 0.5) from raw)) as p_retailprice
    from raw),
  uniq as (select min(p_partkey) as p_partkey, p_brand, p_type, p_name, p_size, p_retailprice
           from filled group by all),
  b as (select quantile_cont(p_size, 0.25) as a1, quantile_cont(p_size, 0.75) as a3,
               quantile_cont(p_retailprice, 0.25) as r1, quantile_cont(p_retailprice, 0.75) as r3
        from uniq),
  capped as (select p_partkey, p_brand, p_type, p_name,
      greatest(a1 - 1.5 * (a3 - a1), least(a3 + 1.5 * (a3 - a1), p_size)) as p_size,
      greatest(r1 - 1.5 * (r3 - r1), least(r3 + 1.5 * (r3 - r1), p_retailprice)) as p_retailprice
      from uniq, b),
  m as (select count(*) as n,
      case when count(*) > 1000 then avg(p_size) else quantile_cont(p_size, 0.5) end as ac,
      case when count(*) > 1000 then stddev_pop(p_size)
           else quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) end as asd,
      case when count(*) > 1000 then avg(p_retailprice) else quantile_cont(p_retailprice, 0.5) end as rc,
      case when count(*) > 1000 then stddev_pop(p_retailprice)
           else quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) end as rs
      from capped)"""

ORACLE = {
    "drop_high_missing": f"select p_partkey, p_brand, p_size from ({plain(SPARSE)}) t",
    "impute_median": f"""with t as ({PART_SQL}) select p_partkey, p_brand, p_type, p_name,
        round(coalesce(p_size, (select quantile_cont(p_size, 0.5) from t)), 6) as p_size,
        round(coalesce(p_retailprice, (select quantile_cont(p_retailprice, 0.5) from t)), 6)
        as p_retailprice from t""",
    "impute_knn": f"""with t as ({points_gaps_oracle()}),
        f1 as ({_knn_fill('x1')}), f3 as ({_knn_fill('x3')})
        select t.vec_id, round(coalesce(x1, f1.v), 6) as x1, round(x2, 6) as x2,
               round(coalesce(x3, f3.v), 6) as x3, round(x4, 6) as x4
        from t left join f1 on f1.vec_id = t.vec_id left join f3 on f3.vec_id = t.vec_id""",
    "impute_categorical": f"""select p_partkey, coalesce(p_brand, 'Missing') as p_brand,
        coalesce(p_type, 'Missing') as p_type, p_name, p_size, p_retailprice from ({PART_SQL}) t""",
    "impute_mode": f"""with t as ({PART_SQL}), m as (select p_brand from t where p_brand is not null
        group by p_brand order by count(*) desc, p_brand limit 1)
        select p_partkey, coalesce(p_brand, (select p_brand from m)) as p_brand, p_type, p_name,
        p_size, p_retailprice from t""",
    "forward_fill": f"""select event_id, user_id, last_value(value ignore nulls) over (
        partition by user_id order by ts, event_id rows between unbounded preceding and current row)
        as value from ({plain(EVENTS_GAPS)}) t""",
    "drop_missing_rows": f"""select * from ({PART_SQL}) t where p_brand is not null
        and p_size is not null and p_retailprice is not null""",
    "dedupe_rows": f"""select min(p_partkey) as p_partkey, p_brand, p_type, p_name, p_size,
        p_retailprice from ({COPIES_SQL}) t group by p_brand, p_type, p_name, p_size, p_retailprice""",
    "quartiles": _per_column(
        """select '{c}' as "column", round(quantile_cont({c}, 0.25), 6) as q1,
        round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75), 6) as q3,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) as iqr from lineitem""",
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "iqr_cap": f"""with t as ({PART_SQL}), b as (select
        {_Q1.format(c='p_size')} as a1, {_Q3.format(c='p_size')} as a3,
        {_Q1.format(c='p_retailprice')} as r1, {_Q3.format(c='p_retailprice')} as r3 from t)
        select p_partkey, p_brand, p_type, p_name,
        case when p_size is not null then
          round(greatest(a1 - 1.5 * (a3 - a1), least(a3 + 1.5 * (a3 - a1), p_size)), 6) end as p_size,
        case when p_retailprice is not null then
          round(greatest(r1 - 1.5 * (r3 - r1), least(r3 + 1.5 * (r3 - r1), p_retailprice)), 6) end
          as p_retailprice from t, b""",
    "outlier_counts": f"with t as ({PART_SQL}) " + _per_column(
        """select '{c}' as "column", count(*) as outliers from t, (select
        quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from t) b
        where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)""", NUM),
    "iqr_filter": """select doc_id, n_chars from documents, (select quantile_cont(n_chars, 0.25) as q1,
        quantile_cont(n_chars, 0.75) as q3 from documents) b
        where n_chars between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""",
    "variance_filter": f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice from ({plain(WIDE)}) t""",
    "zscore_filter": """select event_id, value from events, (select avg(value) as m,
        stddev_pop(value) as s from events) b where abs(value - m) <= 3 * s""",
    "one_hot": "select p_partkey, " + ", ".join(
        f"p_type = '{v}' as \"p_type_{v}\"" for v in _TYPES[1:]) + " from part",
    "hash_encode": """select c_custkey, ('0x' || substr(md5(c_name), 1, 8))::bigint % 100
        as c_name_hash from customer""",
    "scale_standard": _scale_sql("avg({c})", "stddev_pop({c})"),
    "scale_robust": _scale_sql("quantile_cont({c}, 0.5)", f"({_Q3} - {_Q1})"),
    "scale_minmax": _scale_sql("min({c})", "(max({c}) - min({c}))"),
    "adaptive_pipeline": f"with raw as ({COPIES_SQL}), {_FILLED} select p_partkey, "
        "round((p_size - ac) / coalesce(nullif(asd, 0), 1), 6) as p_size, "
        "round((p_retailprice - rc) / coalesce(nullif(rs, 0), 1), 6) as p_retailprice, "
        + ", ".join(f"p_brand = '{v}' as \"p_brand_{v}\"" for v in _BRANDS[1:]) + ", "
        + ", ".join(f"p_type = '{v}' as \"p_type_{v}\"" for v in _TYPES[1:])
        + ", ('0x' || substr(md5(p_name), 1, 8))::bigint % 100 as p_name_hash from capped, m",
    "preprocessing_summary": f"""with raw as ({COPIES_SQL}), {_FILLED}
        select (select count(*) from uniq) as rows_processed, 33 as columns_processed,
        (select sum(case when p_brand is null then 1 else 0 end + case when p_size is null then 1
         else 0 end + case when p_retailprice is null then 1 else 0 end)::bigint from raw)
         as missing_values_handled,
        (select count(*) from raw) - (select count(*) from uniq) as duplicates_removed,
        2 as numeric_features, 8 as preprocessing_steps""",
}
ORACLE["impute_knn_new_rows"] = ORACLE["impute_knn"]

_POINTS = ["x1", "x2", "x3", "x4"]
_BOUND = "quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as l_{c}, " \
         "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as h_{c}"
# above 1,000 rows by mean and deviation, up to that by median and quartiles
_CENTRE = "case when count(*) > 1000 then avg({c}) else quantile_cont({c}, 0.5) end as m_{c}, case when count(*) > 1000 " \
          "then stddev_pop({c}) else quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) end as d_{c}"
ORACLE["adaptive_pipeline_knn"] = f"""with t as ({points_gaps_oracle()}), f1 as ({_knn_fill('x1')}), f3 as ({_knn_fill('x3')}),
    filled as (select t.vec_id, coalesce(x1, f1.v) as x1, x2, coalesce(x3, f3.v) as x3, x4
        from t left join f1 on f1.vec_id = t.vec_id left join f3 on f3.vec_id = t.vec_id),
    uniq as (select min(vec_id) as vec_id, x1, x2, x3, x4 from filled group by x1, x2, x3, x4),
    bound as (select {", ".join(_BOUND.format(c=c) for c in _POINTS)} from uniq),
    capped as (select vec_id, {", ".join(f"greatest(l_{c}, least(h_{c}, {c})) as {c}" for c in _POINTS)} from uniq, bound),
    centre as (select {", ".join(_CENTRE.format(c=c) for c in _POINTS)} from capped)
    select vec_id, {", ".join(f"round(({c} - m_{c}) / coalesce(nullif(d_{c}, 0), 1), 6) as {c}" for c in _POINTS)} from capped, centre"""
