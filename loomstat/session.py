"""Session helpers: the shared folder and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_made: ContextVar[list | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; only a local session may get a temporary one."""
    global _local_folder
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="loomstat-")
    return _local_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back from there.

    Unlike ``checkpoint()``, which runs the last stage once for the job and again for the
    files, this runs everything once, and later plans know the size of the table. The files
    outlive any executor, so iterative jobs survive executor loss.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    if (made := _made.get()) is not None:
        made.append(table)
    return table


@contextmanager
def made_tables(into: list[DataFrame]) -> Iterator[list[DataFrame]]:
    """Collects the tables that ``cut_lineage`` writes inside, to be discarded by whoever owns the list."""
    token = _made.set(into)
    try:
        yield into
    finally:
        _made.reset(token)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``cut_lineage`` wrote, once their readers are done."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that nobody holds any more. It does so when the driver
    collects its garbage, which a driver with little to do may not do before the disk is full. What holds a
    plan goes in a first collection, its shuffles in a second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
