"""From snapshots to what a monitor shows: recent values and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from fleetgauge.constants import FLINK_LABELS, HISTORY_SIZE, SPARK_ENABLED, SPARK_LABELS
from fleetgauge.operators import history, selection
from fleetgauge.operators.catalog import enabled_metrics

Names = Sequence[str]


def recent_metrics(
    wide: DataFrame,
    keys: Names,
    order: Names,
    fields: Names,
    enabled: Names,
    n: int = HISTORY_SIZE,
) -> DataFrame:
    """The enabled metrics of the newest ``n`` snapshots of every entity.

    Whole snapshots are cut to the newest first and turned into one row per metric
    afterwards, so only the rows that are shown get multiplied.
    """
    recent = history.last_n(wide, keys, order, n)
    return enabled_metrics(recent, [*keys, *order, "age"], fields, enabled)


def monitor_stats(
    wide: DataFrame,
    keys: Names,
    order: Names,
    fields: Names,
    enabled: Names,
    n: int = HISTORY_SIZE,
) -> DataFrame:
    """Mean, maximum and minimum of each enabled metric's zero-padded history."""
    recent = recent_metrics(wide, keys, order, fields, enabled, n)
    return history.padded_stats(recent, [*keys, "metric"], n=n)


def spark_monitor(polls: DataFrame, chunk: Column, n: int = HISTORY_SIZE) -> DataFrame:
    """Statistics of cluster snapshots, filed under the application each poll reports on.

    The application found first is kept until a poll fails. ``polls`` comes from
    ``spark_polls``; ``chunk`` cuts the polls of a cluster (see ``sticky_entity``).
    """
    filed = selection.sticky_entity(polls, ["cluster_id"], "poll_id", chunk)
    keys = ["cluster_id", "entity_id"]
    return monitor_stats(filed, keys, ["poll_id"], [*SPARK_LABELS], SPARK_ENABLED, n)


def flink_monitor(polls: DataFrame, chunk: Column, n: int = HISTORY_SIZE) -> DataFrame:
    """Statistics of cluster snapshots, filed under the job each poll reports on.

    The first running job is kept until a poll fails; polls without one go to the
    cluster itself. ``polls`` comes from ``flink_polls``; it is read more than once,
    so store it first where it is large. ``chunk`` cuts the polls of a cluster (see
    ``sticky_entity``).
    """
    filed = selection.sticky_entity(
        polls, ["cluster_id"], "poll_id", chunk, fallback=selection.CLUSTER
    )
    fields = [*FLINK_LABELS]
    return monitor_stats(filed, ["cluster_id", "entity_id"], ["poll_id"], fields, fields, n)
