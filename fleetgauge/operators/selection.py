"""Which application or job a poll reports on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLUSTER = "cluster"


def current_app(apps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First application still running, else the last one listed, per poll.

    ``apps`` has ``app_id``, its ``position`` in the listing and ``attempts``. A
    missing flag or attempt counts as completed. An empty listing is a row without
    an application and yields none.
    """
    completed = F.coalesce(
        F.get(F.col("attempts"), F.lit(0))["completed"], F.lit(True)
    )
    first_running = F.min_by("app_id", F.when(~completed, F.col("position")))
    last_listed = F.max_by("app_id", "position")
    return apps.groupBy(*keys).agg(
        F.coalesce(first_running, last_listed).alias("app_id")
    )


def current_flink_job(
    jobs: DataFrame, keys: Sequence[str], fallback: str | None = CLUSTER
) -> DataFrame:
    """First running job, else ``fallback``, per poll."""
    running = F.when(F.col("status") == "RUNNING", F.col("position"))
    return jobs.groupBy(*keys).agg(
        F.coalesce(F.min_by("job_id", running), F.lit(fallback)).alias("job_id")
    )


def sticky_entity(
    polls: DataFrame,
    keys: Sequence[str],
    order: str,
    chunk: Column,
    candidate: str = "candidate",
    ok: str = "ok",
    fallback: str | None = None,
) -> DataFrame:
    """The entity each successful poll reports on.

    The first candidate offered is kept until a poll fails; the next poll chooses
    anew. Failed polls, and those whose outcome is unknown, report nothing. A poll without an entity goes to
    ``fallback``, or reports nothing where there is none.

    ``chunk`` cuts the polls of a cluster in consecutive pieces; null leaves it
    whole. Each piece is
    worked on by itself, then the choice standing at its end is handed on through
    one summary row per piece, so no task needs all polls of a cluster. Polls
    without a place in the order are left out; those without a cluster are one.
    """
    offered, succeeded = F.col(candidate), F.coalesce(F.col(ok), F.lit(False))
    by_chunk = [*keys, "_chunk"]
    along = Window.partitionBy(*by_chunk).orderBy(order)
    failed = (~succeeded).cast("bigint")
    earlier_fails = F.sum(failed).over(along.rowsBetween(Window.unboundedPreceding, -1))
    since_fail = Window.partitionBy(*by_chunk, "_fails").orderBy(order)
    pieces = (
        polls.withColumn("_chunk", F.coalesce(chunk, F.lit(-1)))
        .filter(F.col(order).isNotNull())
        .withColumn("_fails", F.coalesce(earlier_fails, F.lit(0)))
        .withColumn(
            "_choice",
            F.first(offered, ignorenulls=True).over(
                since_fail.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )

    # Of each piece: the failures in it, and the first candidate after the last one.
    latest_offer = F.min(
        F.when(
            offered.isNotNull(),
            F.struct((-F.col("_fails")).alias("fails"), F.col(order), offered.alias("choice")),
        )
    )
    history = Window.partitionBy(*keys).orderBy("_chunk")
    summary = (
        pieces.groupBy(*by_chunk)
        .agg(F.sum(failed).alias("_failed"), latest_offer.alias("_offer"))
        .withColumn(
            "_left",
            F.when(F.col("_offer.fails") == -F.col("_failed"), F.col("_offer.choice")),
        )
        .withColumn(
            "_era",
            F.sum((F.col("_failed") > 0).cast("bigint")).over(
                history.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn(
            "_standing",
            F.first("_left", ignorenulls=True).over(
                Window.partitionBy(*keys, "_era")
                .orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select(
            *[F.col(name).alias(f"{name}_") for name in by_chunk],
            F.lag("_standing").over(history).alias("_carried"),
        )
    )
    same_piece = F.lit(True)
    for name in by_chunk:
        same_piece = same_piece & F.col(name).eqNullSafe(F.col(f"{name}_"))
    inherited = F.when(F.col("_fails") == 0, F.col("_carried"))
    chosen = F.coalesce(inherited, "_choice", F.lit(fallback).cast("string"))
    return (
        pieces.join(summary, same_piece)
        .filter(succeeded)
        .withColumn("entity_id", chosen)
        .filter(F.col("entity_id").isNotNull())
        .select(*polls.columns, "entity_id")
    )
