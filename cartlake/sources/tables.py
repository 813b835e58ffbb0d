"""Readers, writers and checks of tables. Tables are plain Parquet: what is replaced is replaced by partition."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jdbc_table(spark: SparkSession, url: str, table: str, *, driver: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 8, **options: str) -> DataFrame:
    """A table's snapshot, read in parallel ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def publish_jdbc(df: DataFrame, url: str, table: str, *, driver: str, batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, driver=driver, batchsize=batch, truncate="true", **options).mode("overwrite").save()


def land_bronze(df: DataFrame, path: str) -> None:
    """A raw snapshot with its ingestion time."""
    df.withColumn("_ingestion_timestamp", F.current_timestamp()).write.mode("overwrite").parquet(path)


def read_bucketed_parquet(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """All finished files below a folder, whatever its layout; files in progress have other names."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """The files that are there now: later reads of the frame see no others."""
    files = read_bucketed_parquet(spark, path).inputFiles()
    if not files:
        raise FileNotFoundError(f"no finished file below {path}")
    return spark.read.parquet(*files)


def conform(df: DataFrame, schema: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The schema's columns in its order and types; those that are absent as defaults or nulls."""
    defaults = defaults or {}
    return df.select(*((F.col(n) if n in df.columns else F.lit(defaults.get(n))).cast(k).alias(n) for n, k in schema.items()))


def require_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")
    return spark.table(name)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing")
    return df


def require_non_empty(df: DataFrame, name: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


def export_single_file(df: DataFrame, path: str, *, rows: int | None = None, most: int = 100_000) -> None:
    """A small result as one file: of ``rows`` rows if given, and of ``most`` at most if not."""
    if rows is None and not df.limit(most + 1).count() <= most:
        raise ValueError(f"more than {most} rows for a single file")
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{found} rows where {rows} were expected")
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def export_features(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes plain Parquet by partition; of what is there, only the partitions that ``df`` has rows for give way."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def record_run(history: DataFrame, path: str, run: str = "run_id") -> DataFrame:
    """A run's rows in a history: a repeated run replaces its own rows and no others. The whole history."""
    replace_partitions(history, path, run)
    kinds = dict(history.dtypes)
    return history.sparkSession.read.option("basePath", path).parquet(path).withColumn(run, F.col(run).cast(kinds[run])).select(*history.columns)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def copy_verified(spark: SparkSession, source: str, target: str, *, required: bool = True) -> int | None:
    """Rows copied to a Parquet folder; a missing optional source is skipped, a differing count is an error."""
    try:
        frozen = read_frozen(spark, source)
    except AnalysisException as missing:
        if required or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    wanted = frozen.count()
    frozen.write.mode("overwrite").parquet(target)
    if (found := spark.read.parquet(target).count()) != wanted:
        raise ValueError(f"{found} of {wanted} rows arrived")
    return wanted


def migrate_all(spark: SparkSession, jobs: dict[str, tuple[str, str]]) -> dict[str, int]:
    """Copies each dataset; errors are collected and raised together at the end."""
    done, failed = {}, {}
    for name, (source, target) in jobs.items():
        try:
            done[name] = copy_verified(spark, source, target)
        except Exception as error:
            failed[name] = str(error).splitlines()[0]
    if failed:
        raise RuntimeError(f"not copied: {failed}")
    return done


def high_water(spark: SparkSession, path: str, name: str) -> int:
    """The mark of a table among those kept at ``path``, 0 if there is none."""
    if not exists(spark, path):
        return 0
    return spark.read.parquet(path).where(F.col("table_name") == name).agg(F.coalesce(F.max("high_water"), F.lit(0))).first()[0]


def set_high_water(spark: SparkSession, path: str, name: str, value: int) -> None:
    """Marks are a partition a table and never move back."""
    replace_partitions(spark.createDataFrame([(name, max(value, high_water(spark, path, name)))], "table_name string, high_water long"), path, "table_name")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql(f"show tables in {database}" if database else "show tables")
