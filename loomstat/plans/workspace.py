"""Per-run workspace: run log, insights and named result tables. No globals.

With a folder for it the log is a table that all sessions append to, one partition per session.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..session import discard

LOG_SCHEMA = "timestamp string, step string, status string, message string, execution_time double"
HISTORY_SCHEMA = f"{LOG_SCHEMA}, seq long, session_id string"
INSIGHT_SCHEMA = "type string, message string, severity string, timestamp string"


class Workspace:
    """Results of one run. Log and insight rows are a handful of driver-made records.

    ``log_folder``, on shared storage, keeps the log after the process ends: ``history`` reads the
    records of all its sessions. ``made`` has the tables written on the way; ``clear`` deletes them.
    """

    def __init__(self, spark: SparkSession, log_folder: str | None = None, session_id: str | None = None):
        self.spark = spark
        self.session_id = session_id or datetime.now().strftime("%Y%m%d_%H%M%S")
        self.log_folder = log_folder
        self.tables: dict[str, DataFrame] = {}
        self.made: list[DataFrame] = []
        self._log: list[tuple] = []
        self._insights: list[tuple] = []

    def log_step(self, step: str, status: str, message: str,
                 execution_time: float | None = None) -> None:
        row = (datetime.now().isoformat(), step, status, message, execution_time)
        self._log.append(row)
        if self.log_folder:
            self.spark.createDataFrame([(*row, len(self._log), self.session_id)], HISTORY_SCHEMA).coalesce(1) \
                .write.partitionBy("session_id").mode("append").json(self.log_folder)

    def history(self) -> DataFrame:
        """The records of all sessions of the log folder, with session_id and their number in it."""
        if not self.log_folder:
            raise ValueError("this workspace keeps no log folder")
        return self.spark.read.schema(HISTORY_SCHEMA).json(self.log_folder)

    def add_insight(self, kind: str, message: str, severity: str = "info") -> None:
        if severity not in ("info", "warning", "error", "success"):
            raise ValueError(f"unknown severity {severity!r}")
        self._insights.append((kind, message, severity, datetime.now().isoformat()))

    def add_insights(self, rows: DataFrame | Iterable[tuple[str, str, str]]) -> None:
        """Rule outputs hold a handful of rows (at most a few per column)."""
        if isinstance(rows, DataFrame):
            rows = rows.select("type", "message", "severity").collect()
        for row in rows:
            self.add_insight(*row)

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self._log, LOG_SCHEMA)

    def log_tail(self, n: int = 50) -> DataFrame:
        return self.spark.createDataFrame(self._log[-n:], LOG_SCHEMA)

    def insights(self) -> DataFrame:
        return self.spark.createDataFrame(self._insights, INSIGHT_SCHEMA)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = df
        return df

    def status(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(self.session_id, "raw_data" in self.tables, len(self._log))],
            "session_id string, data_loaded boolean, steps_logged int")

    def select(self, data: bool = True, clusters: bool = True, anomalies: bool = True,
               embeddings: bool = False) -> dict[str, DataFrame]:
        """Tables to export; insights always come along."""
        wanted = {}
        for name, df in self.tables.items():
            if (data and name == "processed_data") or (clusters and name == "clustering_results") \
                    or (anomalies and name == "anomaly_scores") \
                    or (embeddings and name.endswith("_embeddings")):
                wanted[name] = df
        wanted["analysis_insights"] = self.insights()
        return wanted

    def clear(self) -> None:
        """Drops results, records of this run and the tables behind them; a log folder stays."""
        for df in self.tables.values():
            if df.storageLevel.useMemory or df.storageLevel.useDisk:
                df.unpersist()
        self.tables.clear()
        discard(*self.made)
        self.made.clear()
        self._log.clear()
        self._insights.clear()
