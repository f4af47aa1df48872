"""Reading and writing the keyed record logs, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.operators.tables import latest_per_key
from turnstile.schemas import DDL, conform
from turnstile.session import remove

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def schema_of(spark: SparkSession, record: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[record])


def read_log(
    spark: SparkSession,
    record: str,
    location: str | None = None,
    fmt: str = "parquet",
    stream: bool = False,
    **options: str,
) -> DataFrame:
    """A log of ``record`` rows with its declared schema, from the earliest position.

    Files (parquet, json, orc) hold the record's own columns.  ``kafka`` needs
    the connector on the class path and expects JSON values; ``seq`` is then the
    offset, which orders the records of a key.
    """
    reader = spark.readStream if stream else spark.read
    schema = schema_of(spark, record)
    if fmt == "kafka":
        reader = reader.format("kafka").options(startingOffsets="earliest", **options)
        raw = reader.load().select(F.col("value").cast("string").alias("value"), "offset", "timestamp")
        return decode(raw, record).drop("seq", "ts").withColumns(
            {"seq": F.col("offset"), "ts": F.col("timestamp")}
        ).select(*schema.names)
    return reader.format(fmt).schema(schema).options(**options).load(location)


def encode(df: DataFrame, record: str, key: str) -> DataFrame:
    """Keyed JSON records: columns ``key`` and ``value``."""
    typed = conform(df, record)
    return typed.select(
        F.col(key).alias("key"), F.to_json(F.struct(*typed.columns), _JSON).alias("value")
    )


def decode(df: DataFrame, record: str) -> DataFrame:
    """Typed columns from JSON values; a value that is no record gives null columns."""
    schema = schema_of(df.sparkSession, record)
    parsed = df.withColumn("_record", F.from_json("value", schema, _JSON))
    rest = [c for c in df.columns if c not in ("key", "value")]
    return parsed.select("_record.*", *rest)


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's path and file system of a location, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of a log, once.

    The rows are written beside the log and their folder then takes its place by
    a rename, so that a reader, a stream too, sees the whole batch or nothing.
    A batch that is there already stays as it is: one that is replayed after a
    failure adds no file, and what follows does not read it a second time.
    """
    target, files = hadoop_path(df.sparkSession, f"{path}/batch={batch_id}")
    if files.exists(target):
        return
    staged = f"{path}/_staged-{batch_id}-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if not files.rename(hadoop_path(df.sparkSession, staged)[0], target):
        raise OSError(f"batch {batch_id} could not be moved to {path}")


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are there, in order."""
    location, files = hadoop_path(spark, path)
    if not files.exists(location):
        return []
    names = (status.getPath().getName() for status in files.listStatus(location))
    return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))


def drop_batches(spark: SparkSession, path: str, ids: list[int]) -> None:
    """Remove batches that no reader needs any more."""
    for batch_id in ids:
        remove(spark, f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows written by :func:`write_batch`, with their ``batch``."""
    return spark.read.option("basePath", path).parquet(path)


def read_table(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """The log under ``path`` as a table: the last row of each key."""
    return latest_per_key(read_batches(spark, path), key, ["batch", *order]).drop("batch")
