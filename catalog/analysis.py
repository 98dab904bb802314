"""Whole runs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.plans.analysis import Analysis

from .base import PART_COPIES, rounded, table, view


def _orders(spark, d):
    """Per customer: order statistics next to the account columns."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price"),
        F.max("o_totalprice").alias("max_price"))
    return table(spark, d, "customer").join(o, "c_custkey", "left") \
        .select("c_custkey", "c_acctbal", "c_mktsegment", "orders", "mean_price", "max_price")


def run_report(spark, d):
    """Load, preprocess, cluster and score; the report rows of the run."""
    run = Analysis(spark, key="p_partkey")
    run.use(view(spark, d, PART_COPIES), "part")
    run.preprocess()
    run.reduce("PCA", 2)
    run.cluster("kmeans", 4)
    run.anomalies(0.1)
    return run.report()


def run_top_anomalies(spark, d):
    """The ten oddest customers; missing order statistics are filled from neighbours."""
    run = Analysis(spark, key="c_custkey")
    run.use(_orders(spark, d), "customer")
    run.preprocess()
    run.anomalies("auto")
    top = run.top_anomalies()
    return rounded(top, *[c for c, t in top.dtypes if t == "double"])


QUERIES = {f.__name__: f for f in (run_report, run_top_anomalies)}
ORACLE = {}
