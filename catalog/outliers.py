"""Anomaly scores, flags, ranks and the views on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import anomaly, forest, views

from .base import rounded, table, vectors


def _scores(spark, d):
    """events.value as a score: the lowest tenth is anomalous."""
    raw = table(spark, d, "events").select("event_id", "value")
    return anomaly.flag(raw, "event_id", "value", 0.1)


def _features(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value")


def contamination_threshold(spark, d):
    return rounded(_scores(spark, d), "anomaly_score")


def percentile_of_score(spark, d):
    df = anomaly.percentile_of_score(_scores(spark, d)).select("event_id", "anomaly_percentile")
    return rounded(df, "anomaly_percentile")


def auto_contamination(spark, d):
    c = anomaly.auto_contamination(_features(spark, d), ["user_id", "value"])
    return spark.createDataFrame([(round(c, 6),)], "contamination double")


def anomaly_summary(spark, d):
    return rounded(anomaly.anomaly_summary(_scores(spark, d), 0.1), "anomaly_percentage")


def top_anomalies(spark, d):
    return rounded(anomaly.top_anomalies(_features(spark, d), _scores(spark, d), "event_id"),
                   "anomaly_score")


def anomaly_features(spark, d):
    return views.anomaly_features(_features(spark, d), _scores(spark, d), "event_id")


def anomaly_heatmap(spark, d):
    return views.anomaly_heatmap(_features(spark, d), _scores(spark, d), "event_id")


def score_histogram(spark, d):
    return rounded(views.score_histogram(_scores(spark, d)), "lo", "hi")


def score_by_index(spark, d):
    return rounded(views.score_by_index(_scores(spark, d), "event_id"), "anomaly_score")


def lof(spark, d):
    return rounded(anomaly.local_outlier_factor(vectors(spark, d), "vec_id", k=10), "lof")


def isolation_forest(spark, d):
    return rounded(anomaly.detect_anomalies(vectors(spark, d), "vec_id"),
                   "anomaly_score", "anomaly_percentile")


def isolation_scores(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array(F.sum("l_quantity"), F.sum("l_extendedprice"), F.max("l_discount"),
                F.max("l_tax")).alias("features"))
    return rounded(forest.fit_forest(df, "l_orderkey").score(df, "l_orderkey"), "raw_score")


QUERIES = {f.__name__: f for f in (
    contamination_threshold, percentile_of_score, auto_contamination, anomaly_summary, top_anomalies,
    anomaly_features, anomaly_heatmap, score_histogram, score_by_index, lof, isolation_forest,
    isolation_scores)}

SCORES = """scores as (select event_id, value - q as anomaly_score, value - q < 0 as is_anomaly
    from events, (select quantile_cont(value, 0.1) as q from events) t)"""
_EDGES = "(select min(anomaly_score) as lo, max(anomaly_score) as hi from scores) b"

ORACLE = {
    "contamination_threshold": f"""with {SCORES} select event_id,
        round(anomaly_score, 6) as anomaly_score, is_anomaly from scores""",
    "percentile_of_score": """select event_id, round((2 * (rank() over (order by value) - 1)
        + count(*) over (partition by value) + 1) * 50.0::double / count(*) over (), 6)
        as anomaly_percentile from events""",
    "auto_contamination": """with m as (select quantile_cont(user_id, 0.5) as mu,
          quantile_cont(value, 0.5) as mv from events),
        g as (select abs(user_id - mu) as gu, abs(value - mv) as gv from events, m),
        s as (select quantile_cont(gu, 0.5) as su, quantile_cont(gv, 0.5) as sv from g)
        select round(least(0.2::double, greatest(0.01::double,
          avg(case when gu > 3 * su or gv > 3 * sv then 1.0::double else 0 end))), 6)
          as contamination from g, s""",
    "anomaly_summary": f"""with {SCORES} select count(*) as total_samples,
        count(*) filter (is_anomaly) as anomalies_detected,
        round(count(*) filter (is_anomaly) * 100.0::double / count(*), 6) as anomaly_percentage,
        0.1::double as contamination_used from scores""",
    "top_anomalies": f"""with {SCORES} select event_id, user_id, value,
        round(anomaly_score, 6) as anomaly_score, is_anomaly from events join scores using (event_id)
        order by scores.anomaly_score, event_id limit 10""",
    "anomaly_features": f"""with {SCORES} select event_id, user_id, value from events
        where event_id in (select event_id from scores where is_anomaly)""",
    "anomaly_heatmap": f"""with {SCORES}, f as (select event_id, user_id::double as user_id, value
        from events where event_id in (select event_id from scores where is_anomaly))
        select event_id, 'user_id' as feature, user_id as value from f
        union all select event_id, 'value', value from f""",
    "score_histogram": f"""with {SCORES}, h as (select is_anomaly, lo, hi,
          cast(least(floor((anomaly_score - lo) / ((hi - lo) / 50)), 49) as integer) as bin
          from scores, {_EDGES})
        select bin, is_anomaly, round(lo + bin * (hi - lo) / 50, 6) as lo,
        round(lo + (bin + 1) * (hi - lo) / 50, 6) as hi, count(*) as count from h
        group by bin, is_anomaly, lo, hi""",
    "score_by_index": f"""with {SCORES} select event_id as sample,
        round(anomaly_score, 6) as anomaly_score, is_anomaly from scores""",
    "lof": """with p as (select vec_id, cast(embedding as double[]) as v from embeddings),
        g as (select a.vec_id as src, b.vec_id as dst, list_distance(a.v, b.v) as dist,
              row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rn
              from p a, p b where a.vec_id <> b.vec_id),
        k as (select * from g where rn <= 10),
        kd as (select src, max(dist) as kdist from k group by 1),
        r as (select k.src, k.dst, greatest(k.dist, kd.kdist) as reach from k join kd on kd.src = k.dst),
        l as (select src, 1.0::double / (avg(reach) + 1e-10) as lrd from r group by 1)
        select r.src as vec_id, round(avg(o.lrd) / any_value(s.lrd), 6) as lof
        from r join l o on o.src = r.dst join l s on s.src = r.src group by r.src""",
}
