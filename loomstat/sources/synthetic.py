"""The clustered expression table, generated on the executors from a hash of (key, gene)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the sample table.
CLUSTERS = 4
SAMPLES = 500
GENES = 2_000
MARKERS = 100
BATCHES = ("Batch_A", "Batch_B", "Batch_C")
HEALTHY_SHARE = 0.7
EVENT_SHARE = 0.2
MEAN_SURVIVAL = 730.0


def _uniform(*parts) -> Column:
    """In (0, 1), the same for the same parts on every run."""
    bits = F.pmod(F.xxhash64(*parts), F.lit(1 << 52))
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def _normal(*parts) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(*parts, F.lit("r"))))
    return radius * F.cos(F.lit(2.0 * np.pi) * _uniform(*parts, F.lit("a")))


def expression_table(samples: DataFrame, key: str, cluster: Column, genes: int = GENES,
                     markers: int = MARKERS, seed: int = 42) -> DataFrame:
    """One expression profile per row of ``samples``; ``cluster`` gives 0..3.

    Cluster i has mean 3i and sd 1 + 0.2i, and its marker genes are shifted by N(5, 1).
    Genes stay one array column: thousands of columns would cost more to plan than to compute.
    """
    rng = np.random.default_rng(seed)
    chosen = [sorted(rng.choice(genes, min(markers, genes), replace=False).tolist())
              for _ in range(CLUSTERS)]
    marked = F.array(*[F.array(*[F.lit(g) for g in c]) for c in chosen])
    base = samples.select(F.col(key).alias("key"), cluster.cast("int").alias("c"))

    def gene(g: Column) -> Column:
        i = F.col("c")
        value = i * 3.0 + (1.0 + i * 0.2) * _normal(F.col("key"), g, F.lit(seed))
        shift = 5.0 + _normal(F.col("key"), g, F.lit(seed + 1))
        return value + F.when(F.array_contains(marked[i], g), shift).otherwise(0.0)

    pick = _uniform("key", F.lit(seed), F.lit("batch"))
    return base.select(
        F.format_string("Sample_%04d", "key").alias("Sample_ID"),
        F.transform(F.sequence(F.lit(0), F.lit(genes - 1)), gene).alias("genes"),
        F.concat(F.lit("Cluster_"), F.col("c").cast("string")).alias("Cluster"),
        F.element_at(F.array(*[F.lit(b) for b in BATCHES]),
                     (F.floor(pick * len(BATCHES)) + 1).cast("int")).alias("Batch"),
        F.when(_uniform("key", F.lit(seed), F.lit("condition")) < HEALTHY_SHARE, "Healthy")
        .otherwise("Disease").alias("Condition"),
        (-MEAN_SURVIVAL * F.log(_uniform("key", F.lit(seed), F.lit("time")))).alias("Survival_Time"),
        (_uniform("key", F.lit(seed), F.lit("event")) < EVENT_SHARE).cast("int").alias("Event"))


def sample_expression(spark: SparkSession, samples: int = SAMPLES, genes: int = GENES,
                      seed: int = 42) -> DataFrame:
    """The stand-alone sample table, equal shares per cluster."""
    ids = spark.range(samples)
    return expression_table(ids, "id", F.floor(F.col("id") * CLUSTERS / samples), genes,
                            MARKERS, seed)


def widen(df: DataFrame, genes: int) -> DataFrame:
    """Genes as columns Gene_00000, Gene_00001, ... for small gene counts."""
    rest = [c for c in df.columns if c != "genes"]
    return df.select(rest[0], *[F.col("genes")[i].alias(f"Gene_{i:05d}") for i in range(genes)],
                     *rest[1:])
