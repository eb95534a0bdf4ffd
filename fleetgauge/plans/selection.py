"""Queries on which entity a poll reports on, and on poll errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import chunks, timelines
from fleetgauge.operators import selection as ops
from fleetgauge.plans.registry import query
from fleetgauge.sources import fixtures, landing

POLL = ["cluster_id", "poll_id"]

# Chunks that all polls together are cut into; null for the session's partitions.
PIECES: int | None = None


def cut_polls(polls):
    """Polls with the chunk of each."""
    return chunks.with_chunks(polls, ["cluster_id"], ["poll_id"], PIECES)


@query("current_app", """
    WITH apps AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id, o_orderkey,
               o_custkey % 40 = 0 AS running
        FROM orders
    )
    SELECT cluster_id, poll_id,
           'app-' || coalesce(min(o_orderkey) FILTER (WHERE running), max(o_orderkey)) AS app_id
    FROM apps WHERE poll_id % 11 <> 6 GROUP BY ALL
""")
def current_app(spark, sf_dir):
    raw = fixtures.cluster_polls(spark, sf_dir)
    listed = landing.spark_records(raw, "applications", POLL)
    return ops.current_app(listed.withColumnRenamed("id", "app_id"), POLL)


@query("current_flink_job", """
    SELECT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id,
           coalesce('job-' || min(o_orderkey) FILTER (WHERE o_orderkey % 7 = 0), 'cluster') AS job_id
    FROM orders GROUP BY ALL
""")
def current_flink_job(spark, sf_dir):
    return ops.current_flink_job(fixtures.flink_jobs(spark, sf_dir), POLL)


def sticky_sql(entity: str) -> str:
    return f"""
    WITH polls AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey AS poll_id, o_orderstatus <> 'P' AS ok,
               CASE WHEN o_custkey % 3 <> 0 THEN 'app-' || o_custkey END AS candidate
        FROM orders
    ), eras AS (
        SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (
            PARTITION BY cluster_id ORDER BY poll_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era
        FROM polls
    ), chosen AS (
        SELECT *, first_value(candidate IGNORE NULLS) OVER (
            PARTITION BY cluster_id, era ORDER BY poll_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS choice
        FROM eras
    ), named AS (
        SELECT cluster_id, poll_id, {entity} AS entity_id FROM chosen WHERE ok
    )
    SELECT * FROM named WHERE entity_id IS NOT NULL
    """


def _sticky(spark, sf_dir, fallback):
    polls = cut_polls(fixtures.poll_outcomes(spark, sf_dir))
    return ops.sticky_entity(
        polls, ["cluster_id"], "poll_id", F.col("chunk"), fallback=fallback
    ).select(*POLL, "entity_id")


@query("sticky_entity", sticky_sql("choice"))
def sticky_entity(spark, sf_dir):
    return _sticky(spark, sf_dir, None)


@query("sticky_entity_flink", sticky_sql("coalesce(choice, 'cluster')"))
def sticky_entity_flink(spark, sf_dir):
    return _sticky(spark, sf_dir, ops.CLUSTER)


@query("metric_errors_first", """
    WITH polls AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey AS poll_id, o_orderstatus <> 'P' AS ok,
               o_orderpriority || ': HTTPError: ' || repeat('x', CAST(o_custkey % 200 AS INT)) AS message
        FROM orders
    ), seen AS (
        SELECT *, coalesce(lag(ok) OVER (PARTITION BY cluster_id ORDER BY poll_id), true) AS before
        FROM polls
    )
    SELECT cluster_id, poll_id,
           CASE WHEN length(message) > 120 THEN left(message, 117) || '...' ELSE message END AS message
    FROM seen WHERE NOT ok AND before
""")
def metric_errors_first(spark, sf_dir):
    polls = cut_polls(fixtures.poll_outcomes(spark, sf_dir))
    return timelines.first_errors(polls, ["cluster_id"], "chunk")
