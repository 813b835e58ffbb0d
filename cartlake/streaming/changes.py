"""Change streams: sources, sinks, bronze rows and continuous application to bucketed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cartlake.operators import cdc
from cartlake.streaming.buckets import BucketedState


def read_cdc_stream(spark: SparkSession, *, path: str | None = None, servers: str | None = None, topic: str | None = None, files_per_trigger: int = 1000, bytes_per_trigger: int | None = None, offsets_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> DataFrame:
    """A stream of envelopes as ``value``: a topic from its earliest offset, or text files as they arrive.

    A topic that no longer has what the checkpoint asks for stops the query, unless ``fail_on_data_loss`` is false.
    """
    if path is not None:
        admitted = {"maxBytesPerTrigger": bytes_per_trigger} if bytes_per_trigger else {"maxFilesPerTrigger": files_per_trigger}
        return spark.readStream.options(**admitted).text(path)
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", str(fail_on_data_loss).lower())
    if offsets_per_trigger:
        stream = stream.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return stream.load().selectExpr("cast(value as string) as value")


FILE_BYTES, OPEN_TIME = 128 << 20, "15 minutes"  # fixed values: when a file of changes is closed


def write_cdc_stream(df: DataFrame, path: str, checkpoint: str, *, name: str, every: str | None = None, file_bytes: int = FILE_BYTES) -> StreamingQuery:
    """Change rows as Parquet in a folder a batch (``batch=n``), with no file over ``file_bytes``.

    A batch is what arrived since the last one, so no file stays open longer than ``every`` (``OPEN_TIME`` on a cluster);
    without ``every`` the query ends when the input is used up. Rows a file follow the width measured on the rows before:
    a batch is written, the bytes of a row are taken from its files, and where a file is too large the batch is written again
    with as many rows as fit. A batch that is repeated after a stop replaces its own folder, so each row appears once.
    """
    width: dict[str, float] = {}

    def roll(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id}"
        batch.persist()
        try:
            n = batch.count()
            if not n:
                return
            while True:
                rows = max(1, int(file_bytes / width["row"])) if width else n
                batch.repartition(-(-n // rows)).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(target)
                sizes = file_sizes(batch.sparkSession, target)
                width["row"] = max(width.get("row", 0), sum(sizes) / n)
                if max(sizes) <= file_bytes or rows == 1:
                    return
                width["row"] = max(width["row"], max(sizes) / rows, 1.5 * file_bytes / rows)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(roll).queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def file_sizes(spark: SparkSession, folder: str) -> list[int]:
    """Bytes of the data files of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)
    return [f.getLen() for f in found if f.isFile() and f.getPath().getName().endswith(".parquet")]


def stream_rows(raw: DataFrame, entity: str, schema: dict[str, str]) -> DataFrame:
    """Envelopes as typed change rows; the same expressions as for a batch."""
    return cdc.bronze_rows(raw, entity, schema)


def stream_apply(changes: DataFrame, state: BucketedState, checkpoint: str, *, name: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch applied to the state once; it rewrites the buckets of the keys that changed."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                state.apply(batch, source=name, batch_id=batch_id)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(apply).queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
