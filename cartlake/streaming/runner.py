"""Runs a streaming mart over tables' change rows to its end and reads back what it emitted."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cartlake.operators.cdc import latest_per_key
from cartlake.sources.staging import gone_at_exit, shared_folder
from cartlake.streaming.gold import ROCKSDB
from cartlake.streaming.kept import Mart, merging


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the one that driver and executors share; it goes when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/streams/{label}-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    return folder


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Inside, queries that start hold their state in RocksDB, as keyed state needs."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ran(df: DataFrame, folder: str, *, name: str, mode: str = "update", each: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Runs a stream until its input is used up; each batch's rows, or what ``each`` makes of them, are stored as ``out/batch=n``, over what an attempt before left."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        (each(batch, batch_id) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").queryName(name).trigger(availableNow=True).start().awaitTermination()


def stored_feed(spark: SparkSession, changes: dict[str, DataFrame], folder: str, files: int) -> dict[str, DataFrame]:
    """Change rows stored in several files each, as many for each core of the cluster, and streams that read about half of them at a time."""
    files *= -(-spark.sparkContext.defaultParallelism // files)
    for name, rows in changes.items():
        rows.repartition(files).write.mode("append").parquet(f"{folder}/in/{name}")
    return {name: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(f"{folder}/in/{name}") for name, rows in changes.items()}


def streamed(spark: SparkSession, changes: dict[str, DataFrame], mart: Callable[..., DataFrame], label: str, *, mode: str = "update", files: int = 4, then: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """All rows that ``mart`` emits, with their ``batch``, when ``changes`` by argument name are stored and streamed in several micro-batches.

    With ``then``, the mart's rows are a stored stream that ``then`` makes the answer of. A second call with the same ``folder``
    appends to the feed and resumes from the checkpoints.
    """
    folder = folder or work_folder(spark, label)
    with keyed_state(spark):
        first = mart(**stored_feed(spark, changes, folder, files))
        if then is None:
            ran(first, folder, name=f"{label}_{uuid.uuid4().hex[:8]}", mode=mode)
            return spark.read.parquet(f"{folder}/out")
        first.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/partials").option("checkpointLocation", f"{folder}/first").queryName(f"{label}_{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start().awaitTermination()
        partials = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/partials")
        ran(then(partials), folder, name=f"{label}_{uuid.uuid4().hex[:8]}")
        return spark.read.parquet(f"{folder}/out")


def final_state(spark: SparkSession, changes: dict[str, DataFrame], mart: Callable[..., DataFrame], key: str, label: str, *, files: int = 4, then: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """The newest row of each key after all micro-batches; keys whose newest row is a deletion go."""
    return newest_told(streamed(spark, changes, mart, label, files=files, then=then, folder=folder), key)


def kept_state(spark: SparkSession, changes: dict[str, DataFrame], mart: Mart, label: str, *, files: int = 4, folder: str | None = None) -> DataFrame:
    """``final_state`` of a mart over kept rows; with the same ``folder`` it resumes."""
    folder = folder or work_folder(spark, label)
    ran(mart.rows(**stored_feed(spark, changes, folder, files)), folder, name=f"{label}_{uuid.uuid4().hex[:8]}", each=merging(mart, folder))
    return newest_told(spark.read.parquet(f"{folder}/out"), mart.key)


def newest_told(rows: DataFrame, key: str) -> DataFrame:
    """Of all rows that a mart told, the newest of each key that is not a deletion."""
    newest = latest_per_key(rows, [key], ["batch"])
    if "_op" in newest.columns:
        newest = newest.where("_op <> 'd'")
    return newest.drop("batch")
