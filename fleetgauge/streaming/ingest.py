"""Landed files as streams, and how often they are polled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from fleetgauge.constants import POLL_INTERVALS
from fleetgauge.session import new_folder
from fleetgauge.sources.tables import table


def stream_files(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files landing in a folder; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables as a stream."""
    schema = table(spark, folder, name).schema
    return stream_files(spark, folder, schema, glob=f"{name}.parquet")


def poll_interval(source: str, seconds: float | None = None) -> float:
    """Seconds between polls of a source: its default, or a value within its bounds."""
    default, low, high = POLL_INTERVALS[source]
    return default if seconds is None else min(max(seconds, low), high)


def trigger(source: str, seconds: float | None = None) -> dict[str, str]:
    """Arguments for ``DataStreamWriter.trigger``."""
    return {"processingTime": f"{poll_interval(source, seconds)} seconds"}


def run_available(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Process all files that have landed so far, then stop."""
    query = (
        writer.option("checkpointLocation", new_folder(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
