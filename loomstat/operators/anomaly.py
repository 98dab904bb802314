"""Anomaly tables: decision scores, flags, percentile ranks, local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, q
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import attach_by_value, value_counts_ranked
from ..session import cut_lineage
from .forest import contamination_threshold, fit_forest
from .neighbors import knn_graph

# Fixed values of the automatic contamination and the report.
SMALL_TABLE = 100
DEFAULT_CONTAMINATION = 0.1
MAD_FACTOR = 3.0
CONTAMINATION_RANGE = (0.01, 0.2)
TOP = 10

BROADCAST_TOP = 10_000


def auto_contamination(df: DataFrame, cols: Sequence[str]) -> float:
    """Share of rows with any value beyond 3 median absolute deviations, kept in [0.01, 0.2]."""
    if df.count() < SMALL_TABLE:
        return DEFAULT_CONTAMINATION
    centre = {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items() if v}
    gaps = df.select(*[F.abs(as_double(c) - F.lit(centre[c])).alias(c) for c in centre])
    spread = {c: v[0] for c, v in exact_quantiles(gaps, list(centre), [0.5]).items() if v}
    beyond = F.lit(False)
    for c in spread:
        beyond = beyond | F.coalesce(q(c) > F.lit(MAD_FACTOR * spread[c]), F.lit(False))
    share = gaps.agg(F.avg(beyond.cast("double"))).first()[0]
    lo, hi = CONTAMINATION_RANGE
    return min(hi, max(lo, share))


def flag(scores: DataFrame, key: str, score: str, contamination: float) -> DataFrame:
    """(key, anomaly_score, is_anomaly): scores shifted so that anomalies are below 0."""
    offset = contamination_threshold(scores, score, contamination)
    shifted = (q(score) - F.lit(offset)).alias("anomaly_score")
    return scores.select(q(key), shifted).withColumn("is_anomaly", F.col("anomaly_score") < 0)


def percentile_of_score(scores: DataFrame, score: str = "anomaly_score",
                        out: str = "anomaly_percentile",
                        rows_per_range: int = 200_000) -> DataFrame:
    """Append the percentile rank of each row among all rows: the mean of the shares of rows
    below it and at or below it, counting ties by their mean rank."""
    ranked, total = value_counts_ranked(scores, score, rows_per_range)
    left, right = F.col("below"), F.col("below") + F.col("cnt")
    ranked = ranked.withColumn(out, (left + right + 1) * 50.0 / F.lit(total))
    return attach_by_value(scores, ranked, score, total, rows_per_range) \
        .select(*[q(c) for c in scores.columns], out)


def detect_anomalies(df: DataFrame, key: str, features: str = "features",
                     contamination: float = DEFAULT_CONTAMINATION,
                     seed: int = 42) -> DataFrame:
    """(key, anomaly_score, is_anomaly, anomaly_percentile) by isolation forest; low scores are
    anomalous."""
    forest = fit_forest(df, key, features, seed=seed)
    # read by the threshold, the ranks and the join; scoring again would cost a forest pass each
    raw = cut_lineage(forest.score(df, key, features))
    return percentile_of_score(flag(raw, key, "raw_score", contamination))


def anomaly_summary(scores: DataFrame, contamination: float) -> DataFrame:
    return scores.agg(F.count("*").alias("total_samples"),
                      F.count_if("is_anomaly").alias("anomalies_detected")).select(
        "total_samples", "anomalies_detected",
        F.coalesce(F.try_divide(F.col("anomalies_detected") * 100.0, F.col("total_samples")),
                   F.lit(0.0)).alias("anomaly_percentage"),
        F.lit(float(contamination)).alias("contamination_used"))


def top_anomalies(features: DataFrame, scores: DataFrame, key: str, n: int = TOP) -> DataFrame:
    """The n most anomalous rows, lowest score first, with their features.

    The n scores are picked before the join, so only n rows look for their features.
    """
    top = scores.orderBy("anomaly_score", key).limit(n)
    if n <= BROADCAST_TOP:
        top = F.broadcast(top)
    return features.join(top, key).orderBy("anomaly_score", key)


def local_outlier_factor(df: DataFrame, key: str, features: str = "features", k: int = 20,
                         rows_per_block: int = 2_000) -> DataFrame:
    """(key, lof) from the k nearest neighbours (Breunig 2000); about 1 inside a cluster."""
    graph = cut_lineage(knn_graph(df, key, features, k, rows_per_block))
    reach_of = graph.groupBy(F.col("src").alias("dst")).agg(F.max("dist").alias("kdist"))
    popular = graph.groupBy("dst").agg(F.count("*").alias("cnt"))
    total = df.count() * k
    # a row that is the neighbour of very many rows is looked up by broadcast
    reach = attach_by_value(graph, reach_of.join(popular, "dst"), "dst", total) \
        .select("src", "dst", F.greatest("dist", "kdist").alias("reach"))
    density = cut_lineage(reach.groupBy("src").agg(
        (F.lit(1.0) / (F.avg("reach") + F.lit(1e-10))).alias("lrd")))
    other = density.select(F.col("src").alias("dst"), F.col("lrd").alias("other")).join(popular, "dst")
    ratio = attach_by_value(reach, other, "dst", total).groupBy("src").agg(
        F.avg("other").alias("mean_other"))
    return ratio.join(density, "src").select(
        F.col("src").alias(key), (F.col("mean_other") / F.col("lrd")).alias("lof"))
