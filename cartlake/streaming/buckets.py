"""Current state in key-bucketed Parquet: a batch of changes rewrites the buckets that its keys fall into, and no others.

A batch's new buckets are first written whole beside the state (``pending``), then put in the place of the old ones, then
the batch is marked. A run that stops in between starts again from the finished ``pending`` folder, so no bucket is lost
and a batch counts once. Deleted keys stay as tombstones, so a bucket that once had rows has rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.operators import cdc
from cartlake.sources.tables import exists, replace_partitions


@dataclass(frozen=True)
class BucketedState:
    """State of ``keys`` at ``path`` in ``buckets`` folders; the number must not change once there is state."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/state")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/state")

    def read(self) -> DataFrame:
        """All rows, tombstones included (``_deleted``)."""
        return self._stored().drop("_bucket")

    def _mark(self, source: str, batch_id: int) -> str:
        return f"{self.path}/marks/{source}/{batch_id}"

    def applied(self, source: str, batch_id: int) -> bool:
        return exists(self.spark, self._mark(source, batch_id))

    def apply(self, changes: DataFrame, *, source: str, batch_id: int) -> bool:
        """Applies a batch once; whether it was new. What a batch touches is at most one number a bucket."""
        if self.applied(source, batch_id):
            return False
        pending = f"{self.path}/pending/{source}-{batch_id}"
        if not exists(self.spark, f"{pending}/_SUCCESS"):
            keyed = changes.withColumn("_bucket", self._bucket())
            touched = [r[0] for r in keyed.select("_bucket").distinct().collect()]
            old = self._stored().where(F.col("_bucket").isin(touched)).drop("_bucket") if self.exists() else None
            new = cdc.bootstrap_current_state(changes, list(self.keys)) if old is None else cdc.apply_changes(old, changes, list(self.keys))
            new = new.withColumn("_bucket", self._bucket())
            new.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(pending)
        if exists(self.spark, f"{pending}/_SUCCESS"):
            made = self.spark.read.parquet(pending)
            if "_bucket" in made.columns:
                replace_partitions(made.repartition("_bucket"), f"{self.path}/state", "_bucket")
        self._set_mark(source, batch_id)
        return True

    def _set_mark(self, source: str, batch_id: int) -> None:
        """Marks the batch; marks and pending folders of batches before go."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        mark = jvm.org.apache.hadoop.fs.Path(self._mark(source, batch_id))
        files = mark.getFileSystem(conf)
        files.create(mark, True).close()
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/pending/{source}-{batch_id}"), True)
        for status in files.listStatus(mark.getParent()):
            if status.getPath().getName().isdigit() and int(status.getPath().getName()) < batch_id:
                files.delete(status.getPath(), False)
