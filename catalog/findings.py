"""Insight rules, the report and the log views."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import anomaly, evaluate, insights, profile

from .base import PART_ROWS, plain, table, view
from .clusters import LABELLED, NOISY, _labelled, _noisy, samples_sql, stats_sql
from .outliers import SCORES, _scores
from .preparation import ORACLE as PREP_ORACLE
from .preparation import preprocessing_summary
from .tables import ORACLE as TABLE_ORACLE

EVENT_VALUES = "select event_id, user_id, value, event_type from {events}"


def initial_insights(spark, d):
    return insights.initial_insights(view(spark, d, EVENT_VALUES))


def initial_insights_gaps(spark, d):
    return insights.initial_insights(view(spark, d, PART_ROWS).drop("p_retailprice", "p_constant"))


def quality_insights(spark, d):
    return insights.quality_insights(view(spark, d, PART_ROWS))


def preprocessing_insights(spark, d):
    return insights.preprocessing_insights(preprocessing_summary(spark, d))


def _clustering(spark, d, noisy):
    points = _noisy(spark, d) if noisy else _labelled(spark, d)
    # noise gets its own tenth: one planted giant cluster makes the sizes uneven
    score = evaluate.silhouette_score(evaluate.silhouette_samples(points, "vec_id", exclude_noise=True))
    return evaluate.clustering_summary(evaluate.cluster_stats(points), points, score, "given")


def _uneven(spark, d):
    points = _labelled(spark, d).withColumn(
        "cluster", F.when(F.col("vec_id") % 20 == 0, 1).otherwise(0))
    score = evaluate.silhouette_score(evaluate.silhouette_samples(points, "vec_id"))
    return evaluate.clustering_summary(evaluate.cluster_stats(points), points, score, "uneven")


def clustering_insights(spark, d):
    return insights.clustering_insights(_uneven(spark, d))


def anomaly_insights(spark, d):
    return insights.anomaly_insights(anomaly.anomaly_summary(_scores(spark, d), 0.1))


def comprehensive_report(spark, d):
    return insights.comprehensive_report(
        profile.data_summary(view(spark, d, PART_ROWS)),
        {"kmeans": _clustering(spark, d, False), "dbscan": _uneven(spark, d)},
        anomaly.anomaly_summary(_scores(spark, d), 0.1), has_pca=True)


def insights_top3_by_category(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return insights.top_by_category(e, "event_type", "event_id")


def log_tail(spark, d):
    return insights.tail(table(spark, d, "events").select("event_id", "event_type"), "event_id",
                         insights.TAIL_LOG)


def executive_summary(spark, d):
    return insights.executive_summary(
        profile.data_summary(view(spark, d, PART_ROWS)), 2,
        anomaly.anomaly_summary(_scores(spark, d), 0.1))


QUERIES = {f.__name__: f for f in (
    initial_insights, initial_insights_gaps, quality_insights, preprocessing_insights,
    clustering_insights, anomaly_insights, comprehensive_report, insights_top3_by_category, log_tail,
    executive_summary)}

_SUMMARY = TABLE_ORACLE["data_summary"]
_ROWS = plain(PART_ROWS)
_UNEVEN = """select vec_id, cast(embedding as double[]) as v,
    case when vec_id % 20 = 0 then 1 else 0 end as cluster from embeddings"""


def _skew(c, source):
    return f"""(select (sum(power(x - m, 3)) / count(*)) / power(sum(power(x - m, 2)) / count(*), 1.5)
        from (select {c} as x, avg({c}) over () as m from ({source}) y where {c} is not null) z)"""


def _skew_row(c, source):
    return f"""select 'distribution' as type, concat('Column ''{c}'' shows ',
        case when s > 0 then 'positive' else 'negative' end, ' skewness (value: ', printf('%.2f', s), ')')
        as message, 'info' as severity from (select {_skew(c, source)} as s) t where abs(s) > 1"""


def _initial(source, columns, numeric, categorical, missing, skew_cols):
    cells = f"(count(*) * {columns})"
    base = f"""select 'dataset_overview' as type, concat('Dataset contains ', count(*),
          ' samples and {columns} features') as message, 'info' as severity from ({source}) a
        union all select 'data_types', 'Numeric features: {numeric}, Categorical features: {categorical}', 'info'
        union all select 'missing_values', concat('Missing values detected: ', m, ' (',
          printf('%.1f', m * 100.0::double / c), '% of data)'),
          case when m * 100.0 / c > 10 then 'warning' else 'info' end
          from (select sum({missing})::bigint as m, {cells} as c from ({source}) a) b where m > 0"""
    return " union all ".join([base] + [_skew_row(c, source) for c in skew_cols])


def _nulls(cols):
    return " + ".join(f"case when {c} is null then 1 else 0 end" for c in cols)


def _cluster_cte(source, valid, tag):
    # sizes and mean silhouette of one labelling, names suffixed so two can stand together
    text = f"{samples_sql(valid)}, {stats_sql(source)}"
    for name in ("sil", "long", "dims", "sizes", "stats"):
        text = text.replace(f"{name} as (", f"{name}_{tag} as (").replace(
            f"from {name} ", f"from {name}_{tag} ").replace(f"join {name} ", f"join {name}_{tag} ")
    return text


_BIG = "{:,}"
ORACLE = {
    "initial_insights": _initial(plain(EVENT_VALUES), 4, 3, 1,
                                 _nulls(["event_id", "user_id", "value", "event_type"]),
                                 ["event_id", "user_id", "value"]),
    "initial_insights_gaps": _initial(
        f"select p_brand, p_type, p_size, p_empty from ({_ROWS}) q", 4, 2, 2,
        _nulls(["p_brand", "p_type", "p_size", "p_empty"]), ["p_size"]),
    "quality_insights": f"""select 'data_quality' as type, concat('High missing values detected (',
          printf('%.1f', missing_percentage), '%). Consider data imputation.') as message,
          'warning' as severity from ({_SUMMARY}) s where missing_percentage > 50
        union all select 'data_quality', 'Column ''p_constant'' has constant values. Consider removing.',
          'info' from ({_ROWS}) t having count(distinct p_constant) = 1""",
    "preprocessing_insights": f"""with s as ({PREP_ORACLE['preprocessing_summary']})
        select 'preprocessing_summary' as type, concat('Processed ', rows_processed, ' rows with ',
          columns_processed, ' features') as message, 'success' as severity from s
        union all select 'preprocessing_detail', concat('Handled ', missing_values_handled,
          ' missing values'), 'info' from s where missing_values_handled > 0
        union all select 'preprocessing_detail', concat('Removed ', duplicates_removed,
          ' duplicate entries'), 'info' from s where duplicates_removed > 0""",
    "clustering_insights": f"""with {samples_sql(_UNEVEN)}, {stats_sql(_UNEVEN)}
        select 'clustering_result' as type, concat('Identified ', (select count(*) from stats),
          ' distinct clusters with silhouette score ', printf('%.3f', avg(silhouette))) as message,
          'success' as severity from sil
        union all select 'clustering_balance',
          'Cluster sizes are imbalanced. Consider adjusting clustering parameters.', 'warning'
          from stats having min(size) / max(size) < 0.2""",
    "anomaly_insights": f"""with {SCORES}, a as (select count(*) filter (is_anomaly) as n,
          count(*) filter (is_anomaly) * 100.0::double / count(*) as p from scores)
        select 'anomaly_result' as type, concat('Detected ', n, ' anomalies (', printf('%.1f', p),
          '% of data)') as message, case when p > 10 then 'warning' else 'info' end as severity
          from a where n > 0
        union all select 'anomaly_high', 'High anomaly rate detected. Consider reviewing data quality or adjusting detection sensitivity.',
          'warning' from a where p > 20
        union all select 'anomaly_result', 'No anomalies detected in the dataset', 'info' from a where n = 0""",
    "comprehensive_report": f"""with d as ({_SUMMARY}), {SCORES},
        {_cluster_cte(LABELLED, LABELLED, 'k')}, {_cluster_cte(_UNEVEN, _UNEVEN, 'u')},
        a as (select count(*) filter (is_anomaly) as n from scores)
        select 1 as seq, 'Data Quality' as category, 'Dataset Overview' as title,
          concat('The dataset contains ', format('{_BIG}', rows), ' samples and ', columns,
          ' features. ', numeric_columns, ' numeric features and ', categorical_columns,
          ' categorical features identified.') as content from d
        union all select 2, 'Data Quality', 'Missing Values', concat('Found ',
          format('{_BIG}', missing_values), ' missing values (', printf('%.1f', missing_percentage),
          '% of total). These have been handled through adaptive imputation strategies.') from d
          where missing_values > 0
        union all select 10, 'Clustering Analysis', 'KMEANS Clustering Results', concat('Identified ', n,
          ' distinct clusters with a silhouette score of ', printf('%.3f', s), '. The clustering suggests ',
          n, ' natural groupings in your data.')
          from (select (select count(*) from stats_k) as n, (select avg(silhouette) from sil_k) as s) x
        union all select 11, 'Clustering Analysis', 'Cluster Balance',
          concat('Clusters show significant size variation (largest: ', format('{_BIG}', max(size)),
          ', smallest: ', format('{_BIG}', min(size)),
          '). Consider reviewing clustering parameters or exploring hierarchical relationships.')
          from stats_k having min(size) / max(size) < 0.3
        union all select 12, 'Clustering Analysis', 'DBSCAN Clustering Results', concat('Identified ', n,
          ' distinct clusters with a silhouette score of ', printf('%.3f', s), '. The clustering suggests ',
          n, ' natural groupings in your data.')
          from (select (select count(*) from stats_u) as n, (select avg(silhouette) from sil_u) as s) x
        union all select 13, 'Clustering Analysis', 'Cluster Balance',
          concat('Clusters show significant size variation (largest: ', format('{_BIG}', max(size)),
          ', smallest: ', format('{_BIG}', min(size)),
          '). Consider reviewing clustering parameters or exploring hierarchical relationships.')
          from stats_u having min(size) / max(size) < 0.3
        union all select 100, 'Anomaly Detection', 'Anomaly Overview', concat('Detected ', format('{_BIG}', n),
          ' anomalous samples using Isolation Forest. These samples exhibit characteristics significantly different from the majority.')
          from a where n > 0
        union all select 110, 'Dimensionality Reduction', 'PCA Analysis', 'Principal Component Analysis has been applied to reduce feature dimensionality while preserving maximum variance for clustering and visualization.'
        union all select 120, 'Recommendations', 'Next Steps', concat(' • ',
          case when missing_values > 1000 then concat('Consider reviewing the source of missing values for data collection improvements.', chr(10), ' • ') else '' end,
          'Explore different clustering algorithms to compare results and validate cluster stability.',
          case when n > 0 then concat(chr(10), ' • ', 'Investigate anomalous samples for potential data quality issues or interesting edge cases.') else '' end)
          from d, a""",
    "insights_top3_by_category": """select event_id, event_type, value, rank from (select event_id, event_type,
        value, row_number() over (partition by event_type order by event_id)::integer as rank from events) t
        where rank <= 3""",
    "log_tail": "select event_id, event_type from events order by event_id desc limit 50",
    "executive_summary": f"""with d as ({_SUMMARY}), {SCORES}
        select 1 as seq, concat('The analysis processed ', format('{_BIG}', rows), ' samples with ', columns,
          ' features.') as line from d
        union all select 2, 'Clustering analysis identified 2 pattern(s) in the data.'
        union all select 3, concat('Anomaly detection identified ', format('{_BIG}', count(*)),
          ' potentially anomalous samples.') from scores where is_anomaly""",
}
