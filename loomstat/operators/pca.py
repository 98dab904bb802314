"""Principal components: distributed covariance, centred projection, fixed signs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

# Fixed values of the automatic choice.
WANTED_SHARE = 0.95
MAX_COMPONENTS = 50


@dataclass
class PCAModel:
    mean: np.ndarray
    components: np.ndarray          # k x d, the largest loading of each row is positive
    ratios: np.ndarray              # share of the total variance per component
    reached: bool                   # automatic choice: did it reach the wanted share
    model: object

    @property
    def k(self) -> int:
        return len(self.components)

    def transform(self, df: DataFrame, key: str, features: str = "features") -> DataFrame:
        """(key, PC1..PCk): a projection inside the JVM, no shuffle."""
        scored = self.model.transform(df.select(key, array_to_vector(F.col(features)).alias("__vec")))
        parts = vector_to_array("__pc")
        raw = self.model.pc.toArray().T
        cols = []
        for i in range(self.k):
            sign = 1.0 if np.allclose(raw[i], self.components[i]) else -1.0
            offset = float(self.mean @ self.components[i])
            cols.append((parts[i] * F.lit(sign) - F.lit(offset)).alias(f"PC{i + 1}"))
        return scored.select(key, *cols)


def choose_k(ratios, wanted: float = WANTED_SHARE) -> tuple[int, bool]:
    """Smallest number of components reaching the wanted share, at least 2; all if none does."""
    total = np.cumsum(ratios)
    hit = np.flatnonzero(total >= wanted - 1e-12)
    if len(hit):
        return max(2, min(int(hit[0]) + 1, len(ratios))), True
    return len(ratios), False


def fit_pca(df: DataFrame, features: str = "features", k: int | str = 2) -> PCAModel:
    """Fit on an array<double> column; only the d x d covariance reaches the driver."""
    vec = df.select(array_to_vector(features).alias("__vec"))
    mean = vec.agg(Summarizer.mean(F.col("__vec")).alias("m")).first()
    if mean is None or mean.m is None or mean.m.size < 2:
        raise ValueError("PCA needs rows with at least 2 features")
    d = mean.m.size
    want = min(MAX_COMPONENTS, d) if k == "auto" else int(k)
    if not 1 <= want <= d:
        raise ValueError(f"cannot take {want} components of {d} features")
    model = PCA(k=want, inputCol="__vec", outputCol="__pc").fit(vec)
    reached = True
    if k == "auto":
        chosen, reached = choose_k(model.explainedVariance.toArray())
        if chosen != want:
            model = PCA(k=chosen, inputCol="__vec", outputCol="__pc").fit(vec)
    comps = model.pc.toArray().T
    signs = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(axis=1)])
    signs[signs == 0] = 1.0
    return PCAModel(mean.m.toArray(), comps * signs[:, None], model.explainedVariance.toArray(),
                    reached, model)


def explained_variance(model: PCAModel, spark) -> DataFrame:
    """(component, ratio, cumulative)."""
    total = np.cumsum(model.ratios)
    return spark.createDataFrame(
        [(f"PC{i + 1}", float(r), float(total[i])) for i, r in enumerate(model.ratios)],
        "component string, ratio double, cumulative double")


def auto_k(ratio_table: DataFrame, wanted: float = WANTED_SHARE) -> DataFrame:
    """(k, reached) from a table (component number, ratio) of at most 50 rows."""
    running = ratio_table.withColumn("cumulative", F.sum("ratio").over(
        Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("cumulative") >= wanted - 1e-12, F.col("component")))
    return running.agg(
        F.greatest(F.lit(2), F.coalesce(first, F.count("*"))).cast("int").alias("k"),
        first.isNotNull().alias("reached"))


def top_features(model: PCAModel, names: list[str], spark, n: int = 10) -> DataFrame:
    """(component, feature, loading, rank): the n strongest loadings of each component."""
    rows = [(f"PC{i + 1}", names[j], float(c[j])) for i, c in enumerate(model.components)
            for j in range(len(names))]
    order = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return (spark.createDataFrame(rows, "component string, feature string, loading double")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))


def reduction_summary(spark, method: str, components: int, rows: int, total: float | None,
                      seconds: float) -> DataFrame:
    return spark.createDataFrame(
        [(method, components, rows, total, seconds)],
        "method string, n_components int, rows long, total_variance_explained double, "
        "execution_time double")
