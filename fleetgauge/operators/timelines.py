"""Job timelines landed as JSON documents with blocks of unknown names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.constants import MAX_POINTS
from fleetgauge.functions import payloads, rows, units
from fleetgauge.operators.chunks import with_carry_in
from fleetgauge.operators.history import last_n

Names = Sequence[str]


def _parsed(polls: DataFrame, keep: Names) -> DataFrame:
    """Columns ``keep`` with the document's top level and its data blocks."""
    return polls.select(*keep, payloads.members(F.col("payload")).alias("_top")).select(
        *keep, "_top", payloads.blocks(F.col("_top")).alias("_blocks")
    )


def _picked(polls: DataFrame, keep: Names) -> DataFrame:
    return _parsed(polls, keep).withColumn("_block", payloads.densest(F.col("_blocks")))


def timeline_blocks(polls: DataFrame, keep: Names) -> DataFrame:
    """One row per data block: its place in the document, key, values and meta."""
    found = rows.positions(_parsed(polls, keep), keep, F.col("_blocks"), "block", "_block")
    return found.select(*keep, "block", "_block.key", "_block.values", "_block.meta")


def densest_block(polls: DataFrame, keep: Names) -> DataFrame:
    """The block with most known values of each document that has timestamps.

    A document with timestamps but without blocks has no key and no values; a
    document without timestamps is dropped.
    """
    picked = F.struct(
        F.col("_block.key").alias("key"),
        payloads.items(F.col("_top")["timestamps"]).alias("timestamps"),
        F.coalesce("_block.values", F.array().cast("array<string>")).alias("values"),
        F.coalesce("_block.meta", F.lit("{}")).alias("meta"),
    )
    one = F.when(F.col("_blocks").isNotNull(), F.array(picked))
    return rows.structs(_picked(polls, keep), keep, one, always="timestamps")


def timeline_points(polls: DataFrame, keep: Names) -> DataFrame:
    """One row per point whose timestamp and value are both numbers."""
    numbers = F.transform(
        F.arrays_zip("timestamps", "values"),
        lambda pair, position: F.struct(
            position.alias("position"),
            units.to_number(pair["timestamps"]).alias("ts"),
            units.to_number(pair["values"]).alias("value"),
        ),
    )
    points = F.filter(numbers, lambda p: p["ts"].isNotNull() & p["value"].isNotNull())
    return rows.structs(densest_block(polls, keep), keep, points, always="position")


def timeline_meta(polls: DataFrame, keep: Names) -> DataFrame:
    """Unit of each document; mean, nodes and key of its densest block."""
    meta = F.from_json("_block.meta", payloads.BLOCK_META)
    return _picked(polls, keep).withColumn("_meta", meta).select(
        *keep,
        F.col("_top")["unit"].alias("unit"),
        units.to_number(F.col("_meta.mean")).alias("mean"),
        "_meta.best_node",
        "_meta.lowest_node",
        F.col("_block.key").alias("data_key"),
    )


#: Stands for a missing poll number.
NO_POLL = -(2**63)


def merge_points(
    points: DataFrame, series: Names, poll: str = "poll_id", keep: int | None = MAX_POINTS
) -> DataFrame:
    """First value seen for each timestamp, of the newest ``keep`` timestamps.

    Repeated points are folded before the shuffle, on (series, timestamp), so a
    series that is sent again and again is spread by its timestamps.
    """
    merged = fold_points(points, series, poll).drop("seen")
    return merged if keep is None else last_n(merged, series, ["ts"], keep)


def fold_points(points: DataFrame, series: Names, poll: str = "poll_id") -> DataFrame:
    """First value seen for each timestamp, with when it was ``seen``.

    The place of a point is one number, poll before position, so that the fold is a
    hash aggregate and sorts nothing. A point without a poll is earlier than all others.
    Folds of parts can be folded again.
    """
    if "seen" not in points.columns:
        number = F.coalesce(F.col(poll).cast("decimal(20,0)"), F.lit(NO_POLL).cast("decimal(20,0)"))
        place = number * 10_000_000_000 + F.col("position")
        points = points.withColumn("seen", place.cast("decimal(38,0)"))
    return points.groupBy(*series, "ts").agg(
        F.min_by("value", "seen").alias("value"), F.min("seen").alias("seen")
    )


META = ("unit", "mean", "best_node", "lowest_node", "data_key")


def merge_meta(metas: DataFrame, series: Names, poll: str = "poll_id") -> DataFrame:
    """Latest known value of each metadata field by itself."""
    return metas.groupBy(*series).agg(
        *[
            F.max_by(name, F.when(F.col(name).isNotNull(), F.col(poll))).alias(name)
            for name in META
        ]
    )


def document_outcomes(polls: DataFrame, keep: Names) -> DataFrame:
    """Whether each poll brought a document, and what to tell where it did not.

    A page that arrived but is no JSON object is a failed poll too.
    """
    read = F.coalesce(F.col("ok") & payloads.members(F.col("payload")).isNotNull(), F.lit(False))
    message = F.when(~read, F.coalesce(F.col("message"), F.lit("unreadable document")))
    return polls.select(*keep, read.alias("ok"), message.alias("message"))


def first_errors(
    polls: DataFrame, series: Names, chunk: str, order: str = "poll_id"
) -> DataFrame:
    """Failed polls that follow a success or open their series, message shortened.

    Only the poll before matters, so long series are cut along ``chunk``.
    """
    pieces = with_carry_in(polls, series, chunk, [order], rows=1)
    before = F.lag("ok").over(Window.partitionBy(*series, chunk).orderBy(order))
    return (
        pieces.withColumn("_before", F.coalesce(before, F.lit(True)))
        .filter(~F.col("carried") & ~F.col("ok") & F.col("_before"))
        .select(*series, order, units.clip_message(F.col("message")).alias("message"))
    )
