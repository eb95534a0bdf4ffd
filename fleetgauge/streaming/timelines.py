"""Timeline points and metadata kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.operators.timelines import (
    fold_points,
    merge_meta,
    timeline_meta,
    timeline_points,
)
from fleetgauge.streaming.history import batch_sink, read_batches
from fleetgauge.streaming.merged import MergedFolder


def points_sink(
    folder: str, series: Sequence[str], poll: str = "poll_id"
) -> Callable[[DataFrame, int], None]:
    """Fold each micro-batch of documents to one point per series and timestamp.

    Documents are sent again with every poll and may land in any order. Nothing is
    forgotten or dropped: ``read_points`` folds the batches once more.
    """
    write = batch_sink(folder)

    def fold(batch: DataFrame, batch_id: int) -> None:
        write(batch_points(batch, series, poll), batch_id)

    return fold


def merged_points(spark: SparkSession, folder: str, series: Sequence[str]) -> MergedFolder:
    """A folder of folded points that stays small; it takes ``batch_points``."""
    return MergedFolder(spark, folder, lambda rows: fold_points(rows, series))


def batch_points(batch: DataFrame, series: Sequence[str], poll: str = "poll_id") -> DataFrame:
    """One point per series and timestamp of a micro-batch of documents."""
    return fold_points(timeline_points(batch, [*series, poll]), series, poll)


def read_points(spark: SparkSession, folder: str, series: Sequence[str]) -> DataFrame:
    """The first value seen of every series and timestamp, over all batches."""
    return fold_points(read_batches(spark, folder).drop("batch_id"), series).drop("seen")


def latest_meta(polls: DataFrame, series: Sequence[str], poll: str = "poll_id") -> DataFrame:
    """Latest known metadata per series, for update output: changed series only."""
    return merge_meta(timeline_meta(polls, [*series, poll]), series, poll)
