"""Results pushed to a consumer, a whole batch or none of it.

``write.format("fleetgauge_push")`` and ``writeStream.format("fleetgauge_push")`` deliver
rows as Parquet files to a mailbox, a folder that the consumer watches, in two phases:

1. Every task writes its rows to a file of its own under ``staged/`` and reports the name
   and the number of rows in its commit message. Nothing there is delivered.
2. When all tasks have succeeded, the driver publishes one note in ``delivered/`` that
   names these files. A consumer reads the files that notes name, so it never sees a
   part of a batch, nor what a repeated or lost task has left behind.

A note is named after its batch. A batch of a stream that is sent again after its note
is delivered already, so its new files are removed; so are those of an aborted write.
A write that ends without commit or abort leaves files that no note names;
``undelivered`` lists those.

Options: ``path``, the mailbox, reached by every executor (a URI that Arrow can open);
``batch``, for a batch write, the number its note has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

NAME = "fleetgauge_push"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged; a task without rows stages nothing."""

    files: list[dict] = field(default_factory=list)


class _Mailbox:
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("the mailbox needs a path")
        self.path = options["path"].rstrip("/")

    def _open(self):
        from pyarrow import fs

        if "://" not in self.path:
            return fs.LocalFileSystem(), self.path.removeprefix("file:")
        return fs.FileSystem.from_uri(self.path)

    def stage(self, batches: Iterator) -> Staged:
        import pyarrow.parquet as pq

        files, root = self._open()
        at, rows, out, writer = f"{uuid.uuid4().hex}.parquet", 0, None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    files.create_dir(f"{root}/staged", recursive=True)
                    out = files.open_output_stream(f"{root}/staged/{at}")
                    writer = pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer is not None:
                writer.close()
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{root}/staged/{at}")
            raise
        if out is None:
            return Staged()
        out.close()
        return Staged([{"file": at, "rows": rows}])

    def _drop(self, messages: list[Staged | None]) -> None:
        files, root = self._open()
        for message in messages:
            for staged in message.files if message else []:
                files.delete_file(f"{root}/staged/{staged['file']}")

    def deliver(self, messages: list[Staged | None], batch: str) -> None:
        from pyarrow import fs

        files, root = self._open()
        note = f"{root}/delivered/{batch}.json"
        if files.get_file_info(note).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        files.create_dir(f"{root}/delivered", recursive=True)
        draft = f"{root}/delivered/.{batch}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            for message in messages:
                for staged in message.files if message else []:
                    out.write((json.dumps(staged | {"batch": batch}) + "\n").encode())
        files.move(draft, note)

    abort_staged = _drop


class _Stream(DataSourceStreamArrowWriter, _Mailbox):
    def __init__(self, options: dict) -> None:
        _Mailbox.__init__(self, options)

    def write(self, iterator: Iterator) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.deliver(messages, f"{batchId:020d}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.abort_staged(messages)


class _Batch(DataSourceArrowWriter, _Mailbox):
    def __init__(self, options: dict) -> None:
        _Mailbox.__init__(self, options)
        self.batch = options.get("batch") or uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.deliver(messages, self.batch)

    def abort(self, messages: list[Staged | None]) -> None:
        self.abort_staged(messages)


class PushSource(DataSource):
    """Spark's name for the mailbox writers."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        raise NotImplementedError("a mailbox is read with `delivered`")

    def writer(self, schema: StructType, overwrite: bool) -> _Batch:
        return _Batch(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PushSource)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """``batch``, ``file`` and ``rows`` of everything delivered."""
    return spark.read.schema("batch string, file string, rows bigint").json(
        f"{path.rstrip('/')}/delivered"
    )


def _staged(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/staged")
    return rows.select("*", F.col("_metadata.file_name").alias("_file"))


def delivered(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All delivered rows with their ``batch``; staged files that no note names are left out."""
    named = notes(spark, path).select("batch", F.col("file").alias("_file"))
    return _staged(spark, path, schema).join(named, "_file").drop("_file")


def undelivered(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the staged files that no note names; while nothing is written they are lost."""
    files = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/staged").select("path")
    named = notes(spark, path).select("file")
    return files.join(named, F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_anti")
