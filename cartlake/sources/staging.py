"""Intermediate tables in the folder that driver and executors share.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; a folder of our own is taken only where that is
unset and driver and executors are one process, as in local tests. Staged tables go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, set on its context too so that ``checkpoint()`` uses it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cartlake-")
    if current is None:
        context.setCheckpointDir(named)
    return named or current


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends there.

    A lost executor costs no recomputation of what lies before, and readers prune its columns.
    """
    path = stored_folder(df.sparkSession, label)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for a staged table or model."""
    return f"{shared_folder(spark).rstrip('/')}/cartlake/{label}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder that is there for deletion at the end of the application."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)


def freed(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for table in tables:
        jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends; for steps of which each is staged or collected."""
    with _option(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Inside, rows travel to Python in batches of about ``size`` bytes, however many rows those are."""
    with _option(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size)):
        yield


@contextmanager
def _option(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint; for the small tables of iterative steps."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
