"""One run from file to report: load, preprocess, reduce, cluster, find anomalies, export.

Thin glue over the operators: it keeps the tables of a run by name, logs every step and adds
the insights the rules give. A failing step is logged and raised.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import feature_matrix, nan_to_null, q
from ..operators import anomaly, clean, dbscan, evaluate, insights, kmeans, pca, profile, umap, ward
from ..session import cut_lineage, made_tables
from ..sources import readers, writers
from ..sources.synthetic import GENES, SAMPLES, sample_expression, widen
from .preprocess import AdaptivePreprocessor, PreprocessModel, summary_row
from .workspace import Workspace

# Fixed values of the run.
PLOT_COMPONENTS = 3
METHODS = ("kmeans", "dbscan", "hierarchical")

WIDE = 100


class Analysis:
    """The steps of one run; ``key`` names the row identity (``row_id`` is made if absent); a
    ``log_folder`` keeps the log of all runs."""

    def __init__(self, spark: SparkSession, key: str = "row_id", log_folder: str | None = None):
        self.spark, self.key = spark, key
        self.workspace = Workspace(spark, log_folder)
        self.model: PreprocessModel | None = None
        self.summaries: dict[str, DataFrame] = {}
        self.clusterings: dict[str, DataFrame] = {}
        self.attempts: list[str] = []

    # ---- steps ------------------------------------------------------------------------

    def _step(self, name: str, work: Callable[[], str]) -> None:
        ws, start = self.workspace, time.time()
        ws.log_step(name, "started", f"Starting {name}")
        try:
            with made_tables(ws.made):
                message = work()
        except Exception as e:
            ws.log_step(name, "failed", f"{name} failed: {e}")
            ws.add_insight("error", f"{name} error: {e}", "error")
            raise
        ws.log_step(name, "completed", message, time.time() - start)

    def _table(self, name: str) -> DataFrame:
        if name not in self.workspace.tables:
            raise ValueError(f"no {name} yet")
        return self.workspace.tables[name]

    def use(self, df: DataFrame, name: str = "table", file_type: str = "table", files: DataFrame | None = None) -> DataFrame:
        """Clean, key and profile a table that is already a DataFrame; ``files`` is the table as it was
        read, if it comes from files."""
        def work() -> str:
            cleaned, notes = clean.clean(nan_to_null(df))
            self.workspace.add_insights(notes)
            keyed = cleaned if self.key in cleaned.columns else clean.assign_row_id(cleaned, self.key)
            if len(keyed.columns) > WIDE:
                # thousands of cleaned columns are planned once, not again in every later step
                keyed = cut_lineage(keyed)
            data = keyed.select(*[q(c) for c in keyed.columns if c != self.key])
            self.workspace.put("raw_data", keyed)
            # the profile is one row; materialised once, as every rule reads it
            summary = cut_lineage(profile.data_summary(data, self.attempts, files).select(
                F.lit(name).alias("filename"), F.lit(file_type).alias("file_type"), "*"))
            self.summaries["data"] = summary
            self.workspace.add_insights(insights.initial_insights(data, summary))
            self.workspace.add_insights(insights.quality_insights(data, summary))
            row = summary.first()
            return f"Loaded {row['rows']} rows, {row['columns']} columns"
        self._step("data_loading", work)
        return self.workspace.tables["raw_data"]

    def load(self, path: str, fmt: str | None = None) -> DataFrame:
        got = readers.load_table(self.spark, path, fmt)
        self.attempts = got.attempts
        for attempt in got.attempts:
            self.workspace.log_step("load_attempt", "info", attempt)
        if got.quarantine is not None:
            self.workspace.put("quarantine", got.quarantine)
        files = self.spark.read.format("binaryFile").load(path)
        return self.use(got.df, path.rstrip("/").rsplit("/", 1)[-1], got.file_type, files)

    def load_sample(self, samples: int = SAMPLES, genes: int = GENES) -> DataFrame:
        # written before it is widened: a column of a computed array would compute it all again
        profiles = cut_lineage(sample_expression(self.spark, samples, genes))
        # rows are named by their sample, so that draws by hash do not depend on the order of files
        number = F.regexp_extract("Sample_ID", r"(\d+)$", 1).cast("long")
        return self.use(widen(profiles, genes).withColumn(self.key, number), "sample", "sample")

    def preprocess(self, **options) -> DataFrame:
        def work() -> str:
            self.model = AdaptivePreprocessor(self.key, **options).fit(self._table("raw_data"))
            self.workspace.put("processed_data", cut_lineage(self.model.fitted_table))
            self.workspace.add_insights(self.model.insights)
            self.summaries["preprocessing"] = summary_row(self.model, self.spark)
            self.workspace.add_insights(
                insights.preprocessing_insights(self.summaries["preprocessing"]))
            return f"Preprocessing completed with {len(self.model.steps)} steps"
        self._step("preprocessing", work)
        return self._table("processed_data")

    def features(self, include_encoded: bool = False) -> DataFrame:
        """(key, features): the scaled numeric columns of the processed table."""
        processed = self._table("processed_data")
        return feature_matrix(processed, self.key, self.model.features(include_encoded))

    def reduce(self, method: str = "PCA", components: int | str = PLOT_COMPONENTS,
               include_encoded: bool = False) -> DataFrame:
        def work() -> str:
            start = time.time()
            points = self.features(include_encoded)
            total = None
            if method == "PCA":
                width = len(points.first()["features"])
                k = components if components == "auto" else min(int(components), width)
                fitted = pca.fit_pca(points, k=k)
                out, size, total = fitted.transform(points, self.key), fitted.k, float(fitted.ratios.sum())
                self.workspace.put("explained_variance", pca.explained_variance(fitted, self.spark))
                text = f"PCA captured {total:.1%} variance with {size} components"
            elif method == "UMAP":
                out = umap.umap_embed(points, self.key, dims=2 if components == "auto" else int(components))
                size = len(out.columns) - 1
                text = f"UMAP reduction to {size} dimensions"
            else:
                raise ValueError(f"unsupported reduction: {method}")
            table = cut_lineage(out)
            self.workspace.put(f"{method}_embeddings", table)
            self.workspace.add_insight("dimensionality_reduction", text)
            self.summaries[method] = pca.reduction_summary(
                self.spark, method, size, table.count(), total, time.time() - start)
            return f"{method} completed with {size} components"
        self._step("dimensionality_reduction", work)
        return self._table(f"{method}_embeddings")

    def cluster(self, method: str = "kmeans", clusters: int | None = None, eps: float | None = None,
                embedding: str = "PCA") -> DataFrame:
        """(key, cluster); without ``clusters`` or ``eps`` they are chosen from the data."""
        if method not in METHODS:
            raise ValueError(f"unsupported clustering method: {method}")
        if f"{embedding}_embeddings" not in self.workspace.tables:
            self.reduce(embedding, 2)
        emb, key = self._table(f"{embedding}_embeddings"), self.key

        def work() -> str:
            points = cut_lineage(emb.select(key, F.array(*[c for c in emb.columns if c != key])
                                            .alias("features")))
            if method == "dbscan":
                radius = eps if eps is not None else dbscan.knee_eps(points, key)
                labels = dbscan.dbscan(points, key, radius).select(key, "cluster")
            else:
                k = clusters
                if k is None:
                    chosen = kmeans.optimal_k(points, key).first()
                    k = chosen.optimal_k
                    self.workspace.add_insight(
                        "clustering", f"Optimal cluster count determined: {k} "
                        f"(Elbow: {chosen.elbow_k}, Silhouette: {chosen.silhouette_k})")
                k = kmeans.clamp_k(k, points.count())
                labels = kmeans.fit_kmeans(points, k).labels(points, key) if method == "kmeans" \
                    else ward.fit_ward(points, key).labels(points, key, clusters=k)
            labels = cut_lineage(labels)
            labelled = points.join(labels, key)
            stats = cut_lineage(evaluate.cluster_stats(labelled))
            found = stats.count()
            if not found:
                raise ValueError("no clusters found; adjust the parameters")
            score = cut_lineage(evaluate.silhouette_score(evaluate.silhouette_samples(
                labelled, key, exclude_noise=method == "dbscan")))
            summary = cut_lineage(evaluate.clustering_summary(stats, labels, score, method))
            name = {"kmeans": "K-means clustering completed with", "dbscan": "DBSCAN clustering found",
                    "hierarchical": "Hierarchical clustering completed with"}[method]
            radius_text = f" (eps={radius:.2f})" if method == "dbscan" else ""
            self.workspace.add_insight(
                "clustering", f"{name} {found} clusters{radius_text}",
                "success" if method != "dbscan" or found > 1 else "warning")
            self.workspace.add_insights(insights.clustering_insights(summary))
            self.clusterings[method] = summary
            self.workspace.put(f"{method}_stats", stats)
            self.workspace.put(f"{method}_labels", labels)
            self.workspace.put("clustering_results", evaluate.label_table(
                {m: self._table(f"{m}_labels") for m in self.clusterings}, key))
            return f"{method.capitalize()} clustering completed with {found} clusters"
        self._step("clustering", work)
        return self._table(f"{method}_labels")

    def anomalies(self, contamination: float | str = anomaly.DEFAULT_CONTAMINATION,
                  include_encoded: bool = False) -> DataFrame:
        def work() -> str:
            share = contamination
            if share == "auto":
                share = anomaly.auto_contamination(
                    self._table("processed_data"), self.model.features(include_encoded))
            scores = cut_lineage(anomaly.detect_anomalies(
                self.features(include_encoded), self.key, contamination=share))
            self.workspace.put("anomaly_scores", scores)
            summary = cut_lineage(anomaly.anomaly_summary(scores, share))
            self.summaries["anomalies"] = summary
            self.workspace.add_insights(insights.anomaly_insights(summary))
            return f"Detected {summary.first().anomalies_detected} anomalies"
        self._step("anomaly_detection", work)
        return self._table("anomaly_scores")

    # ---- results ----------------------------------------------------------------------

    def top_anomalies(self, n: int = anomaly.TOP) -> DataFrame:
        return anomaly.top_anomalies(self._table("processed_data"), self._table("anomaly_scores"),
                                     self.key, n)

    def report(self) -> DataFrame:
        return insights.comprehensive_report(
            self.summaries.get("data"), self.clusterings, self.summaries.get("anomalies"),
            "PCA_embeddings" in self.workspace.tables)

    def executive_summary(self) -> DataFrame:
        return insights.executive_summary(self.summaries["data"], len(self.clusterings),
                                          self.summaries.get("anomalies"))

    def export(self, out: str, fmt: str = "csv", **tables: bool) -> dict[str, str]:
        return writers.export_tables(self.workspace.select(**tables), out, fmt)

    def export_log(self, out: str) -> str:
        return writers.export_log(self.workspace.log(), out, self.workspace.session_id)

    def clear(self) -> None:
        self.workspace.clear()
        self.model = None
        self.summaries.clear()
        self.clusterings.clear()
        self.attempts.clear()
