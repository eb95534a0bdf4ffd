"""Snapshots of polls whose pages arrive over several micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.operators import snapshots
from fleetgauge.streaming.history import batch_sink, read_batches
from fleetgauge.streaming.merged import MergedFolder


def snapshot_sink(folder: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Write the sums of each micro-batch's pages; a poll may be spread over any of them.

    There is no state and no watermark: pages may come late, in any order, and with
    different times. A repeated micro-batch replaces itself.
    """
    write = batch_sink(folder)

    def add(batch: DataFrame, batch_id: int) -> None:
        write(snapshots.spark_parts(batch, keys), batch_id)

    return add


def merged_snapshots(spark: SparkSession, folder: str, keys: Sequence[str]) -> MergedFolder:
    """A folder of sums per poll that stays small; it takes ``snapshots.spark_parts``."""
    return MergedFolder(spark, folder, lambda rows: snapshots.merge_parts(rows, keys))


def merged_rows(spark: SparkSession, folder: str, keys: Sequence[str]) -> MergedFolder:
    """A folder that keeps of each key the row of its latest batch; see ``marked``."""

    def newest(rows: DataFrame) -> DataFrame:
        columns = [name for name in rows.columns if name not in keys]
        latest = F.max_by(F.struct(*columns), "batch_id").alias("_row")
        return rows.groupBy(*keys).agg(latest).select(*keys, "_row.*")

    return MergedFolder(spark, folder, newest)


def marked(batch: DataFrame, batch_id: int) -> DataFrame:
    """Rows with the batch they come from."""
    return batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def read_snapshots(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The polls that are complete by now, from the sums of all batches."""
    parts = read_batches(spark, folder).drop("batch_id")
    return snapshots.complete_polls(snapshots.merge_parts(parts, keys), keys)


def newest_rows(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the row that the latest batch wrote."""
    columns = [name for name in batches.columns if name not in (*keys, "batch_id")]
    return (
        batches.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), "batch_id").alias("_row"))
        .select(*keys, "_row.*")
    )
