"""Logs as committed batches, for jobs that run apart.

A batch is a set of parquet files and one small record that names them.  Tasks write files under names of their own; the
driver then writes the record, and only what a record names is in the log.  Nothing is renamed, so that a store which
cannot rename, or lists late, serves as well: a job that fails before the record leaves files that no reader sees, and one
that fails after it finds the record when it runs the batch again and adds nothing.  A record carries its checksum; one
that is only half there counts as not there and is written again.

One job writes a log, its batches numbered from 0 without gaps.  Any number of jobs follow it, each at its own pace:
an offset is the number of batches read.  Paths are what ``pyarrow.fs`` opens on the driver and the executors alike.
Empty batches have a record without files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FORMAT = "turnstile_log"


@dataclass(frozen=True)
class Commits:
    """The records of one log."""

    path: str

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def files(self, batch_id: int) -> list[str] | None:
        """The files of a batch; None if it is not committed."""
        store, base = self._store()
        try:
            with store.open_input_stream(f"{base}/commits/{batch_id:012d}") as stream:
                check, _, body = stream.read().partition(b" ")
        except FileNotFoundError:
            return None
        return json.loads(body) if check == b"%08x" % zlib.crc32(body) else None

    def add(self, batch_id: int, files: list[str]) -> None:
        """Commit a batch, unless it is committed: then ``files`` are removed."""
        if self.files(batch_id) is not None:
            self.remove(files)
            return
        store, base = self._store()
        body = json.dumps(files).encode()
        store.create_dir(f"{base}/commits", recursive=True)
        with store.open_output_stream(f"{base}/commits/{batch_id:012d}") as stream:
            stream.write(b"%08x %b" % (zlib.crc32(body), body))

    def end(self, start: int = 0) -> int:
        """The number of committed batches, of which ``start`` are known."""
        while self.files(start) is not None:
            start += 1
        return start

    def write(self, batches: Iterator[pa.RecordBatch]) -> list[str]:
        """One file of all batches, if they have rows."""
        store, base = self._store()
        name, writer = f"data/{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if batch.num_rows:
                if writer is None:
                    store.create_dir(f"{base}/data", recursive=True)
                    writer = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
        if writer is None:
            return []
        writer.close()
        return [name]

    def read(self, name: str) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        with store.open_input_file(f"{base}/{name}") as source:
            yield from pq.ParquetFile(source).iter_batches()

    def remove(self, files: list[str]) -> None:
        store, base = self._store()
        for name in files:
            store.delete_file(f"{base}/{name}")


@dataclass
class _File(InputPartition):
    name: str | None


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _files_of(messages: list) -> list[str]:
    return [name for message in messages if message is not None for name in message.files]


class _Reading:
    """What reading a log in batch and as a stream have in common."""

    def __init__(self, path: str):
        self.log = Commits(path)

    def between(self, start: int, end: int) -> list[_File]:
        files = [_File(name) for batch_id in range(start, end) for name in self.log.files(batch_id)]
        return files or [_File(None)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.name is None else self.log.read(partition.name)


class _TableReader(_Reading, DataSourceReader):
    def partitions(self) -> list[_File]:
        return self.between(0, self.log.end())


class _Follower(_Reading, DataSourceStreamReader):
    def __init__(self, path: str):
        super().__init__(path)
        self.known = 0

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        self.known = self.log.end(self.known)
        return {"batches": self.known}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return self.between(start["batches"], end["batches"])


class _BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch_id: int):
        self.log, self.batch_id = Commits(path), batch_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _Written(self.log.write(iterator))

    def commit(self, messages: list) -> None:
        self.log.add(self.batch_id, _files_of(messages))

    def abort(self, messages: list) -> None:
        self.log.remove(_files_of(messages))


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.log = Commits(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _Written(self.log.write(iterator))

    def commit(self, messages: list, batchId: int) -> None:
        self.log.add(batchId, _files_of(messages))

    def abort(self, messages: list, batchId: int) -> None:
        self.log.remove(_files_of(messages))


class CommitLog(DataSource):
    """Spark's way to a log; ``path`` is where it is, ``batch`` the number of a batch that is written by itself."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Follower(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.options["path"], int(self.options["batch"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"])


def commit_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of a log, once; a sink for the jobs that take one."""
    if Commits(path).files(batch_id) is None:
        df.sparkSession.dataSource.register(CommitLog)
        df.write.format(FORMAT).mode("append").option("batch", str(batch_id)).save(path)


def commit_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Start a job whose micro-batches are the batches of a log."""
    stream.sparkSession.dataSource.register(CommitLog)
    to = stream.writeStream.format(FORMAT).option("checkpointLocation", checkpoint).outputMode("append")
    return to.trigger(**trigger).start(path)


def committed(spark: SparkSession, path: str, schema: StructType | str, stream: bool = False) -> DataFrame:
    """All committed rows of a log, or the log as a stream from its first batch."""
    spark.dataSource.register(CommitLog)
    return (spark.readStream if stream else spark.read).format(FORMAT).schema(schema).load(path)
