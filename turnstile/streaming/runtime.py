"""Starting streaming jobs and cutting logs into the files they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile.session import stateful_settings
from turnstile.sources.logs import hadoop_path

# Everything that is there, then stop; a long-running job passes processingTime.
AVAILABLE_NOW = {"availableNow": True}

ROWS_PER_FILE = 1_000_000
# Bytes of a row group: tasks share a file by these.
ROW_GROUP = 4 << 20


def start(
    stream: DataFrame,
    write,
    checkpoint: str,
    trigger: dict = AVAILABLE_NOW,
    mode: str = "append",
    partitions: int | None = None,
) -> StreamingQuery:
    """Start a job that hands every micro-batch to ``write(batch, batch_id)``.

    Progress and state live under ``checkpoint``, which must be on shared
    storage.  A batch may be handed over again after a failure, with the same
    id, so ``write`` has to replace what it wrote before.
    """
    with stateful_settings(stream.sparkSession, partitions):
        return (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .outputMode(mode)
            .trigger(**trigger)
            .start()
        )


def run_to_end(*args, **kwargs) -> None:
    start(*args, **kwargs).awaitTermination()


def stream_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def bounds(log: DataFrame) -> tuple:
    """First and last ``seq`` of a log, and its number of rows."""
    return tuple(log.agg(F.min("seq"), F.max("seq"), F.count("*")).first())


def write_pieces(
    log: DataFrame,
    path: str,
    pieces: int,
    key: str,
    only: range | None = None,
    shuffled: bool = False,
    within: tuple | None = None,
) -> int:
    """Cut a log by ``seq`` into pieces, written in log order.

    The file source takes files in order of age, so a later piece is never in an
    earlier batch.  A large piece has several files, split by ``key`` so that
    each key stays in order.  ``shuffled`` mixes the rows inside each file.
    ``within`` are the log's :func:`bounds`, where they are known.

    Returns the number of files of a piece, the same for all: a batch of that
    many files is a piece.  A stream that goes by event time needs that, as files
    of one piece cover the same times and the second of two batches would be late.
    """
    low, high, rows = within or bounds(log)
    width = (high - low) // pieces + 1
    files = 1 + rows // (pieces * ROWS_PER_FILE)
    numbered = log.withColumn("_piece", F.floor((F.col("seq") - low) / width))
    for piece in only or range(pieces):
        part = numbered.where(F.col("_piece") == piece).drop("_piece").repartition(files, key)
        order = F.xxhash64("seq") if shuffled else F.col("seq")
        part.sortWithinPartitions(order).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{piece:04d}")
        # A split without rows has no file.
        for n in range(_files(log.sparkSession, f"{path}/{piece:04d}"), files):
            part.limit(0).coalesce(1).write.parquet(f"{path}/{piece:04d}/empty-{n}")
    return files


def _files(spark: SparkSession, path: str) -> int:
    location, store = hadoop_path(spark, path)
    return sum(status.getPath().getName().endswith(".parquet") for status in store.listStatus(location))
