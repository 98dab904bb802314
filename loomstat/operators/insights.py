"""Rule-based insights: metric tables in, text rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import side_by_side
from ..functions.text import text
from . import profile
from .evaluate import IMBALANCE_REPORT, IMBALANCE_WARNING

# Thresholds and message texts of the insight rules.
MISSING_WARNING = 10
MISSING_HIGH = 50
ANOMALY_WARNING = 10
ANOMALY_HIGH = 20
MISSING_RECOMMENDATION = 1000
REPORT_PER_CATEGORY = 3
TAIL_INSIGHTS = 5
TAIL_LOG = 50
OVERVIEW = "Dataset contains %d samples and %d features"
TYPES = "Numeric features: %d, Categorical features: %d"
MISSING = "Missing values detected: %d (%.1f%% of data)"
SKEW = "Column '%s' shows %s skewness (value: %.2f)"
HIGH_MISSING = "High missing values detected (%.1f%%). Consider data imputation."
NO_NUMERIC = "No numeric columns found. Clustering may require numeric features."
CONSTANT = "Column '%s' has constant values. Consider removing."
PROCESSED = "Processed %d rows with %d features"
HANDLED = "Handled %d missing values"
DUPLICATES = "Removed %d duplicate entries"
CLUSTERS = "Identified %d distinct clusters with silhouette score %.3f"
IMBALANCED = "Cluster sizes are imbalanced. Consider adjusting clustering parameters."
ONE_CLUSTER = "Only one cluster identified. Data may be homogeneous or need different parameters."
ANOMALIES = "Detected %d anomalies (%.1f%% of data)"
MANY_ANOMALIES = ("High anomaly rate detected. Consider reviewing data quality or adjusting "
                  "detection sensitivity.")
NO_ANOMALIES = "No anomalies detected in the dataset"
REPORT_OVERVIEW = ("The dataset contains %,d samples and %,d features. "
                   "%d numeric features and %d categorical features identified.")
REPORT_MISSING = ("Found %,d missing values (%.1f%% of total). "
                  "These have been handled through adaptive imputation strategies.")
REPORT_CLUSTERS = ("Identified %d distinct clusters with a silhouette score of %.3f. "
                   "The clustering suggests %d natural groupings in your data.")
REPORT_BALANCE = ("Clusters show significant size variation (largest: %,d, smallest: %,d). "
                  "Consider reviewing clustering parameters or exploring hierarchical relationships.")
REPORT_ANOMALIES = ("Detected %,d anomalous samples using Isolation Forest. "
                    "These samples exhibit characteristics significantly different from the majority.")
REPORT_PCA = ("Principal Component Analysis has been applied to reduce feature dimensionality "
              "while preserving maximum variance for clustering and visualization.")
ADVICE_MISSING = "Consider reviewing the source of missing values for data collection improvements."
ADVICE_CLUSTERS = ("Explore different clustering algorithms to compare results and validate cluster "
                   "stability.")
ADVICE_ANOMALIES = ("Investigate anomalous samples for potential data quality issues or interesting "
                    "edge cases.")
SUMMARY_ROWS = "The analysis processed %,d samples with %,d features."
SUMMARY_CLUSTERS = "Clustering analysis identified %d pattern(s) in the data."
SUMMARY_ANOMALIES = "Anomaly detection identified %,d potentially anomalous samples."


def _rule(holds: Column, kind: str, message: Column, severity: Column | str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(holds.alias("holds"), F.lit(kind).alias("type"), message.alias("message"),
                    level.alias("severity"))


def _apply(metrics: DataFrame, *rules: Column) -> DataFrame:
    return metrics.select(F.array(*rules).alias("rules")).select(F.inline("rules")) \
        .filter("holds").select("type", "message", "severity")


def _warning_above(value: Column, limit: float) -> Column:
    return F.when(value > limit, F.lit("warning")).otherwise(F.lit("info"))


def initial_insights(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """From a table; its data summary row is taken over when it is already known."""
    m = summary if summary is not None else profile.data_summary(df)
    base = _apply(
        m,
        _rule(F.lit(True), "dataset_overview", text(OVERVIEW, "rows", "columns"), "info"),
        _rule(F.lit(True), "data_types",
              text(TYPES, "numeric_columns", "categorical_columns"), "info"),
        _rule(F.col("missing_values") > 0, "missing_values",
              text(MISSING, "missing_values", "missing_percentage"),
              _warning_above(F.col("missing_percentage"), MISSING_WARNING)))
    if not profile.numeric_columns(df):
        return base
    skew = profile.profile_skewness(df).filter("is_skewed")
    side = F.when(F.col("skewness") > 0, F.lit("positive")).otherwise(F.lit("negative"))
    return base.unionByName(_apply(skew, _rule(
        F.lit(True), "distribution", text(SKEW, "column", side, "skewness"), "info")))


def quality_insights(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    m = summary if summary is not None else profile.profile_missing(df)
    numeric = profile.numeric_columns(df)
    out = _apply(
        m,
        _rule(F.col("missing_percentage") > MISSING_HIGH, "data_quality",
              text(HIGH_MISSING, "missing_percentage"), "warning"),
        _rule(F.lit(not numeric), "data_quality", F.lit(NO_NUMERIC), "warning"))
    if not numeric:
        return out
    flat = profile.constant_columns(df)
    return out.unionByName(_apply(flat, _rule(
        F.lit(True), "data_quality", text(CONSTANT, "column"), "info")))


def preprocessing_insights(summary: DataFrame) -> DataFrame:
    return _apply(
        summary,
        _rule(F.lit(True), "preprocessing_summary",
              text(PROCESSED, "rows_processed", "columns_processed"), "success"),
        _rule(F.col("missing_values_handled") > 0, "preprocessing_detail",
              text(HANDLED, "missing_values_handled"), "info"),
        _rule(F.col("duplicates_removed") > 0, "preprocessing_detail",
              text(DUPLICATES, "duplicates_removed"), "info"))


def clustering_insights(summary: DataFrame) -> DataFrame:
    """From a clustering summary row."""
    many = F.col("n_clusters") > 1
    balance = F.try_divide(F.array_min("cluster_sizes"), F.array_max("cluster_sizes"))
    return _apply(
        summary,
        _rule(many, "clustering_result",
              text(CLUSTERS, "n_clusters", "silhouette_score"), "success"),
        _rule(many & (balance < IMBALANCE_WARNING), "clustering_balance", F.lit(IMBALANCED), "warning"),
        _rule(~many, "clustering_result", F.lit(ONE_CLUSTER), "warning"))


def anomaly_insights(summary: DataFrame) -> DataFrame:
    some = F.col("anomalies_detected") > 0
    return _apply(
        summary,
        _rule(some, "anomaly_result",
              text(ANOMALIES, "anomalies_detected", "anomaly_percentage"),
              _warning_above(F.col("anomaly_percentage"), ANOMALY_WARNING)),
        _rule(some & (F.col("anomaly_percentage") > ANOMALY_HIGH), "anomaly_high",
              F.lit(MANY_ANOMALIES), "warning"),
        _rule(~some, "anomaly_result", F.lit(NO_ANOMALIES), "info"))


def _section(seq: int, holds: Column, category: str, title: Column | str, content: Column) -> Column:
    name = F.lit(title) if isinstance(title, str) else title
    return F.struct(holds.alias("holds"), F.lit(seq).alias("seq"), F.lit(category).alias("category"),
                    name.alias("title"), content.alias("content"))


def _sections(metrics: DataFrame, *rules: Column) -> DataFrame:
    return metrics.select(F.array(*rules).alias("rules")).select(F.inline("rules")) \
        .filter("holds").drop("holds")


def comprehensive_report(data: DataFrame | None = None, clusterings: dict[str, DataFrame] | None = None,
                         anomalies: DataFrame | None = None, has_pca: bool = False) -> DataFrame:
    """(seq, category, title, content) from a data summary row, clustering summary rows by
    method, and an anomaly summary row; whatever is missing gives no rows."""
    parts: list[DataFrame] = []
    advice: list[DataFrame] = []
    clusterings = clusterings or {}
    tables = [t for t in [data, anomalies, *clusterings.values()] if t is not None]
    if not tables:
        raise ValueError("nothing to report")
    spark = tables[0].sparkSession
    one = spark.range(1)

    def recommend(seq: int, table: DataFrame, holds: Column, line: str) -> None:
        advice.append(table.filter(holds).select(F.lit(seq).alias("seq"), F.lit(line).alias("text")))

    if data is not None:
        parts.append(_sections(
            data,
            _section(1, F.lit(True), "Data Quality", "Dataset Overview", text(
                REPORT_OVERVIEW, "rows", "columns", "numeric_columns", "categorical_columns")),
            _section(2, F.col("missing_values") > 0, "Data Quality", "Missing Values",
                     text(REPORT_MISSING, "missing_values", "missing_percentage"))))
        recommend(1, data, F.col("missing_values") > MISSING_RECOMMENDATION, ADVICE_MISSING)
    for i, (method, summary) in enumerate(clusterings.items()):
        many = F.col("n_clusters") > 1
        largest, smallest = F.array_max("cluster_sizes"), F.array_min("cluster_sizes")
        parts.append(_sections(
            summary,
            _section(10 + 2 * i, many, "Clustering Analysis", f"{method.upper()} Clustering Results",
                     text(REPORT_CLUSTERS, "n_clusters", "silhouette_score", "n_clusters")),
            _section(11 + 2 * i, many & (F.try_divide(smallest, largest) < IMBALANCE_REPORT),
                     "Clustering Analysis", "Cluster Balance",
                     text(REPORT_BALANCE, largest, smallest))))
    if clusterings:
        recommend(2, one, F.lit(True), ADVICE_CLUSTERS)
    if anomalies is not None:
        some = F.col("anomalies_detected") > 0
        parts.append(_sections(anomalies, _section(
            100, some, "Anomaly Detection", "Anomaly Overview",
            text(REPORT_ANOMALIES, "anomalies_detected"))))
        recommend(3, anomalies, some, ADVICE_ANOMALIES)
    if has_pca:
        parts.append(_sections(one, _section(
            110, F.lit(True), "Dimensionality Reduction", "PCA Analysis", F.lit(REPORT_PCA))))
    if advice:
        lines = advice[0]
        for more in advice[1:]:
            lines = lines.unionByName(more)
        joined = lines.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]),
            "\n • ").alias("content"), F.count("*").alias("n"))
        parts.append(joined.filter(F.col("n") > 0).select(
            F.lit(120).alias("seq"), F.lit("Recommendations").alias("category"),
            F.lit("Next Steps").alias("title"), F.concat(F.lit(" • "), "content").alias("content")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def top_by_category(rows: DataFrame, category: str, seq: str, n: int = REPORT_PER_CATEGORY) -> DataFrame:
    """The first n rows of each category; tasks cut to n per category before the shuffle."""
    order = Window.partitionBy(category).orderBy(seq)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def tail(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """The last n rows."""
    return rows.orderBy(F.col(seq).desc()).limit(n)


def executive_summary(data: DataFrame, clusterings: int, anomalies: DataFrame | None = None) -> DataFrame:
    """(seq, line)."""
    table = side_by_side(data, anomalies) if anomalies is not None else data
    lines = [F.struct(F.lit(1).alias("seq"), text(SUMMARY_ROWS, "rows", "columns").alias("line"))]
    if clusterings:
        lines.append(F.struct(F.lit(2).alias("seq"),
                              text(SUMMARY_CLUSTERS, F.lit(clusterings)).alias("line")))
    if anomalies is not None:
        lines.append(F.struct(F.lit(3).alias("seq"), text(
            SUMMARY_ANOMALIES, "anomalies_detected").alias("line")))
    return table.select(F.inline(F.array(*lines)))
