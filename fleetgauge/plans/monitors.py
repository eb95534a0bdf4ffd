"""Whole monitors: from landed records to the statistics shown per metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import (
    FLINK_LABELS,
    PROCESS_LABELS,
    SPARK_ENABLED,
    SPARK_LABELS,
)
from fleetgauge.operators import monitors as ops
from fleetgauge.operators import processes, selection, snapshots
from fleetgauge.plans.processes import MATCH_SQL
from fleetgauge.plans.registry import query
from fleetgauge.plans.selection import cut_polls
from fleetgauge.plans.snapshots import FLINK_OK, FLINK_SNAPSHOT_SQL, SPARK_SNAPSHOT_SQL
from fleetgauge.session import stored
from fleetgauge.sources import fixtures, landing


def stats_sql(source: str, keys: str, order: str, metrics: list[str]) -> str:
    """Zero-padded statistics of the newest 40 rows of a wide table, per metric."""
    values = ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in metrics)
    return f""",
    recent AS (
        SELECT * FROM {source}
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) <= 40
    ), long AS (
        SELECT {keys}, unnest([{values}], recursive := true) FROM recent
    )
    SELECT {keys}, metric, CAST(count(*) AS BIGINT) AS samples, sum(value) / 40 AS mean,
           CASE WHEN count(*) < 40 THEN greatest(max(value), 0.0) ELSE max(value) END AS max,
           CASE WHEN count(*) < 40 THEN least(min(value), 0.0) ELSE min(value) END AS min
    FROM long GROUP BY {keys}, metric
    """


@query("spark_monitor", SPARK_SNAPSHOT_SQL + stats_sql("snapshot", "entity_id", "poll_id", SPARK_ENABLED))
def spark_monitor(spark, sf_dir):
    wide = snapshots.spark_snapshot(fixtures.spark_raw_polls(spark, sf_dir), ["entity_id", "poll_id"])
    return ops.monitor_stats(wide, ["entity_id"], ["poll_id"], [*SPARK_LABELS], SPARK_ENABLED)


CLUSTER_POLLS_SQL = """
    polls AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id,
               'app-' || coalesce(min(o_orderkey) FILTER (WHERE o_custkey % 40 = 0), max(o_orderkey)) AS candidate,
               sum(o_custkey * 1024) AS memory, sum(o_orderkey * 512) AS shuffle,
               sum(o_orderkey % 100) AS gc, sum(o_custkey) AS duration
        FROM orders GROUP BY ALL
    )
"""


@query("spark_monitor_sticky", f"""
    WITH {CLUSTER_POLLS_SQL}, eras AS (
        SELECT * REPLACE (CASE WHEN poll_id % 11 <> 6 THEN candidate END AS candidate),
               poll_id % 8 <> 3 AND poll_id % 11 <> 6 AS ok,
               coalesce(sum(CASE WHEN poll_id % 8 <> 3 AND poll_id % 11 <> 6 THEN 0 ELSE 1 END) OVER (
                   PARTITION BY cluster_id ORDER BY poll_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era
        FROM polls
    ), chosen AS (
        SELECT *, first_value(candidate IGNORE NULLS) OVER (
            PARTITION BY cluster_id, era ORDER BY poll_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entity_id
        FROM eras
    ), filed AS (
        SELECT cluster_id, entity_id, poll_id, memory / 1048576 AS total_memory_mb,
               0.0 AS total_disk_usage_mb, shuffle / 1048576 AS total_shuffle_read_mb,
               0.0 AS total_shuffle_write_mb, gc AS total_gc_time_ms, duration AS total_duration_ms,
               0.0 AS jvm_heap_used_mb
        FROM chosen WHERE ok AND entity_id IS NOT NULL
    )
""" + stats_sql("filed", "cluster_id, entity_id", "poll_id", SPARK_ENABLED))
def spark_monitor_sticky(spark, sf_dir):
    raw, keys = fixtures.cluster_polls(spark, sf_dir), ["cluster_id", "poll_id"]
    apps = landing.spark_records(raw, "applications", keys).withColumnRenamed("id", "app_id")
    polls = snapshots.spark_polls(raw, selection.current_app(apps, keys), keys)
    return ops.spark_monitor(cut_polls(polls), F.col("chunk"))


@query("flink_monitor", FLINK_SNAPSHOT_SQL + """,
    eras AS (
        SELECT cluster_id, poll_id, CASE WHEN running_jobs > 0 THEN 'job-' || first_running END AS candidate,
               """ + FLINK_OK + """ AS ok,
               coalesce(sum(CASE WHEN """ + FLINK_OK + """ THEN 0 ELSE 1 END) OVER (
                   PARTITION BY cluster_id ORDER BY poll_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era
        FROM polls
    ), chosen AS (
        SELECT *, first_value(candidate IGNORE NULLS) OVER (
            PARTITION BY cluster_id, era ORDER BY poll_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS choice
        FROM eras
    ), filed AS (
        SELECT coalesce(choice, 'cluster') AS entity_id, snapshot.*
        FROM snapshot JOIN chosen USING (cluster_id, poll_id)
    )
""" + stats_sql("filed", "cluster_id, entity_id", "poll_id", [*FLINK_LABELS]))
def flink_monitor(spark, sf_dir):
    raw = fixtures.flink_raw_polls(spark, sf_dir)
    polls = stored(snapshots.flink_polls(raw, ["cluster_id", "poll_id"]), "polls")
    return ops.flink_monitor(cut_polls(polls), F.col("chunk"))


@query("process_monitor", MATCH_SQL + """,
    wide AS (
        SELECT cluster_id, title, poll_id, pid, p_size * 0.25 AS cpu, p_size AS mem_pct, CAST(pid * 123456 AS DOUBLE) / 1048576 AS mem_rss,
               CAST(pid * 234567 AS DOUBLE) / 1048576 AS mem_vms, p_size AS threads,
               CAST(pid * 1000 AS DOUBLE) / 1048576 AS io_read, CAST(pid * 3000 AS DOUBLE) / 1048576 AS io_write
        FROM matched
    )
""" + stats_sql("wide", "cluster_id, title", "(poll_id, pid)", [*PROCESS_LABELS]))
def process_monitor(spark, sf_dir):
    matched = processes.match_processes(
        fixtures.processes(spark, sf_dir), F.col("owner"), fixtures.PATTERNS
    )
    keys, order = ["cluster_id", "title"], ["poll_id", "pid"]
    wide = processes.process_snapshot(matched, [*keys, *order])
    return ops.monitor_stats(wide, keys, order, [*PROCESS_LABELS], [*PROCESS_LABELS])
