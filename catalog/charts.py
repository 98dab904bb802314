"""Chart-data views over the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from loomstat.operators import views

from .base import PART, plain, rounded, table, view

PART_SQL = plain(PART)
CORR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax"]


def missing_matrix(spark, d):
    return views.missing_matrix(view(spark, d, PART), "p_partkey")


def missing_matrix_bucketed(spark, d):
    return rounded(views.missing_matrix(view(spark, d, PART), "p_partkey", buckets=20),
                   "missing_share")


def histogram(spark, d):
    return rounded(views.histogram(table(spark, d, "events"), "value"), "lo", "hi")


def box_stats(spark, d):
    df = views.box_stats(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


def correlation_matrix(spark, d):
    df = table(spark, d, "lineitem").select(*CORR, F.lit(1.0).alias("flat"))
    return rounded(views.correlation_matrix(df), "correlation")


def pair_histogram(spark, d):
    return views.pair_histogram(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


def pair_histograms(spark, d):
    return views.pair_histograms(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


QUERIES = {f.__name__: f for f in (
    missing_matrix, missing_matrix_bucketed, histogram, box_stats, correlation_matrix,
    pair_histogram, pair_histograms)}


def _bin(c, bins=10, lo="lo", hi="hi"):
    return f"cast(least(floor(({c} - {lo}) / (({hi} - {lo}) / {bins}::double)), {bins - 1}) as integer)"


def _pair(x, y, named=True):
    head = f"'{x}' as x, '{y}' as y, " if named else ""
    return f"""select {head}{_bin(x, 10, 'x0', 'x1')} as x_bin, {_bin(y, 10, 'y0', 'y1')} as y_bin,
        count(*) as count from lineitem, (select min({x}) as x0, max({x}) as x1, min({y}) as y0,
        max({y}) as y1 from lineitem) b group by all"""


_ALL = CORR + ["flat"]
_L = f"(select {', '.join(CORR)}, 1.0::double as flat from lineitem) l"


def _corr(a, b):
    if a == b:
        return (f"select '{a}' as x, '{a}' as y, case when stddev_pop({a}) > 0 then 1.0::double end "
                f"as correlation from {_L}")
    if "flat" in (a, b):
        return f"select '{a}' as x, '{b}' as y, cast(null as double) as correlation"
    return f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as correlation from {_L}"


_CELLS = ["p_brand", "p_type", "p_name", "p_size", "p_retailprice"]

ORACLE = {
    "missing_matrix": " union all ".join(
        f"""select p_partkey as row, '{c}' as "column", case when {c} is null then 1 else 0 end
        as missing from ({PART_SQL}) t""" for c in _CELLS),
    "missing_matrix_bucketed": " union all ".join(
        f"""select cast(floor((p_partkey - lo) / greatest(1.0::double, (hi - lo + 1) / 20::double))
        as integer) as bucket, '{c}' as "column",
        round(avg(case when {c} is null then 1.0::double else 0 end), 6) as missing_share
        from ({PART_SQL}) t, (select min(p_partkey) as lo, max(p_partkey) as hi from part) b
        group by 1""" for c in _CELLS),
    "histogram": f"""select bin, round(lo + bin * (hi - lo) / 50, 6) as lo,
        round(lo + (bin + 1) * (hi - lo) / 50, 6) as hi, count(*) as count
        from (select {_bin('value', 50)} as bin, lo, hi from events,
              (select min(value) as lo, max(value) as hi from events) b) t group by bin, lo, hi""",
    "box_stats": """with b as (select o_orderpriority, quantile_cont(o_totalprice, 0.25) as q1,
        quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.75) as q3
        from orders group by 1)
        select o_orderpriority, count(*) as count, round(q1, 6) as q1, round(median, 6) as median,
        round(q3, 6) as q3,
        round(min(case when o_totalprice >= q1 - 1.5 * (q3 - q1) then o_totalprice end), 6) as whisker_low,
        round(max(case when o_totalprice <= q3 + 1.5 * (q3 - q1) then o_totalprice end), 6) as whisker_high
        from orders join b using (o_orderpriority) group by o_orderpriority, q1, median, q3""",
    "correlation_matrix": " union all ".join(_corr(a, b) for a in _ALL for b in _ALL),
    "pair_histogram": _pair("l_quantity", "l_extendedprice", named=False),
    "pair_histograms": " union all ".join(
        _pair(x, y) for x, y in combinations(["l_quantity", "l_discount", "l_tax"], 2)),
}
