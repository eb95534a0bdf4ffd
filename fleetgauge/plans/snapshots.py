"""Application and cluster snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import SPARK_ENABLED, SPARK_LABELS
from fleetgauge.functions import units
from fleetgauge.operators import catalog
from fleetgauge.operators import snapshots as ops
from fleetgauge.plans.registry import query
from fleetgauge.session import new_folder
from fleetgauge.sources import fixtures, landing
from fleetgauge.sources.tables import table

APP = ["entity_id", "poll_id"]
CLUSTER = ["cluster_id", "poll_id"]

JOBS_SQL = """
    jobs AS (
        SELECT 'app-' || (o_orderkey % 20) AS entity_id, o_orderkey // 200 AS poll_id,
               CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED'
                    ELSE 'FAILED' END AS status,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS active,
               o_orderkey % 11 AS completed,
               CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 3 END AS failed
        FROM orders
    )
"""

STAGES_SQL = """
    stages AS (
        SELECT 'app-' || (l_orderkey % 20) AS entity_id, l_orderkey // 200 AS poll_id,
               CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' WHEN l_returnflag = 'R' THEN 'FAILED'
                    ELSE 'COMPLETE' END AS status
        FROM lineitem
    )
"""

EXECUTORS_SQL = """
    executors AS (
        SELECT 'app-' || (l_orderkey % 20) AS entity_id, l_orderkey // 200 AS poll_id, l_linenumber,
               CAST(l_linenumber AS BIGINT) AS cores,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS memory,
               CASE WHEN l_linenumber <> 4 THEN l_suppkey * 1024 ELSE 0 END AS disk,
               l_partkey * 4096 AS input, l_orderkey * 512 AS shuffle_read,
               CAST(l_quantity AS BIGINT) * 65536 AS shuffle_write,
               l_partkey % 1000 AS gc, l_orderkey % 10000 AS duration,
               CASE l_linenumber WHEN 1 THEN l_partkey * 8192 WHEN 3 THEN l_suppkey * 2048
                    WHEN 5 THEN l_suppkey * 2048 ELSE 0 END AS heap
        FROM lineitem
    )
"""

JOB_COUNTS_SQL = """
    CAST(count(*) FILTER (WHERE status = 'RUNNING') AS BIGINT) AS active_jobs,
    CAST(count(*) FILTER (WHERE status = 'SUCCEEDED') AS BIGINT) AS completed_jobs,
    CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed_jobs
"""

STAGE_COUNTS_SQL = """
    CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS active_stages,
    CAST(count(*) FILTER (WHERE status = 'COMPLETE') AS BIGINT) AS completed_stages,
    CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed_stages
"""

TASK_TOTALS_SQL = """
    CAST(coalesce(sum(active), 0) AS BIGINT) AS active_tasks,
    CAST(coalesce(sum(completed), 0) AS BIGINT) AS completed_tasks,
    CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed_tasks
"""

EXECUTOR_TOTALS_SQL = """
    CAST(count(*) AS BIGINT) AS executor_count,
    CAST(sum(cores) AS BIGINT) AS total_cores,
    CAST(sum(memory) AS DOUBLE) / 1048576 AS total_memory_mb,
    CAST(sum(disk) AS DOUBLE) / 1048576 AS total_disk_usage_mb,
    CAST(sum(input) AS DOUBLE) / 1048576 AS total_input_mb,
    CAST(sum(shuffle_read) AS DOUBLE) / 1048576 AS total_shuffle_read_mb,
    CAST(sum(shuffle_write) AS DOUBLE) / 1048576 AS total_shuffle_write_mb,
    CAST(sum(gc) AS BIGINT) AS total_gc_time_ms,
    CAST(sum(duration) AS BIGINT) AS total_duration_ms,
    CAST(sum(heap) AS DOUBLE) / 1048576 AS jvm_heap_used_mb
"""


@query("rest_spark_executors", f"""
    WITH {EXECUTORS_SQL}, listed AS (
        SELECT *, poll_id + CAST(substring(entity_id, 5) AS BIGINT) AS no FROM executors
    )
    SELECT entity_id, poll_id, cores, memory, disk, gc FROM listed
    WHERE no % 13 <> 4 AND no % 23 <> 11
""")
def rest_spark_executors(spark, sf_dir):
    raw = fixtures.spark_raw_polls(spark, sf_dir)
    return landing.spark_records(raw, "executors", APP).select(
        *APP, F.col("totalCores").alias("cores"), F.col("memoryUsed").alias("memory"),
        units.or_zero(F.col("diskUsed")).alias("disk"), F.col("totalGCTime").alias("gc"),
    )


@query("spark_job_counts", f"""
    WITH {JOBS_SQL} SELECT entity_id, poll_id, {JOB_COUNTS_SQL} FROM jobs GROUP BY entity_id, poll_id
""")
def spark_job_counts(spark, sf_dir):
    jobs = fixtures.spark_jobs(spark, sf_dir)
    return jobs.groupBy(*APP).agg(*ops.job_count_aggs(F.col("status")))


@query("spark_stage_counts", f"""
    WITH {STAGES_SQL} SELECT entity_id, poll_id, {STAGE_COUNTS_SQL} FROM stages GROUP BY entity_id, poll_id
""")
def spark_stage_counts(spark, sf_dir):
    stages = fixtures.spark_stages(spark, sf_dir)
    return stages.groupBy(*APP).agg(*ops.stage_count_aggs(F.col("status")))


@query("spark_task_totals", f"""
    WITH {JOBS_SQL} SELECT entity_id, poll_id, {TASK_TOTALS_SQL} FROM jobs GROUP BY entity_id, poll_id
""")
def spark_task_totals(spark, sf_dir):
    jobs = fixtures.spark_jobs(spark, sf_dir)
    record = F.struct("numActiveTasks", "numCompletedTasks", "numFailedTasks")
    return jobs.groupBy(*APP).agg(*ops.task_total_aggs(record))


@query("spark_executor_totals", f"""
    WITH {EXECUTORS_SQL}
    SELECT entity_id, poll_id, {EXECUTOR_TOTALS_SQL} FROM executors GROUP BY entity_id, poll_id
""")
def spark_executor_totals(spark, sf_dir):
    executors = fixtures.spark_executors(spark, sf_dir)
    return ops.executor_totals(executors, APP, F.struct(*fixtures.EXECUTOR_FIELDS))


SPARK_SNAPSHOT_SQL = f"""
    WITH {JOBS_SQL}, {STAGES_SQL}, {EXECUTORS_SQL},
    j AS (SELECT entity_id, poll_id, {JOB_COUNTS_SQL}, {TASK_TOTALS_SQL} FROM jobs GROUP BY ALL),
    s AS (SELECT entity_id, poll_id, {STAGE_COUNTS_SQL} FROM stages GROUP BY ALL),
    e AS (SELECT entity_id, poll_id, {EXECUTOR_TOTALS_SQL} FROM executors GROUP BY ALL),
    polls AS (
        SELECT *, poll_id + CAST(substring(entity_id, 5) AS BIGINT) AS no
        FROM j JOIN s USING (entity_id, poll_id) JOIN e USING (entity_id, poll_id)
    ),
    snapshot AS (
        SELECT * REPLACE (
            CASE WHEN no % 13 = 4 THEN 0 ELSE executor_count END AS executor_count,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_cores END AS total_cores,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_memory_mb END AS total_memory_mb,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_disk_usage_mb END AS total_disk_usage_mb,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_input_mb END AS total_input_mb,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_shuffle_read_mb END AS total_shuffle_read_mb,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_shuffle_write_mb END AS total_shuffle_write_mb,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_gc_time_ms END AS total_gc_time_ms,
            CASE WHEN no % 13 = 4 THEN 0 ELSE total_duration_ms END AS total_duration_ms,
            CASE WHEN no % 13 = 4 THEN 0 ELSE jvm_heap_used_mb END AS jvm_heap_used_mb
        ),
        strftime(make_timestamp((1704067200 + 5 * poll_id) * 1000000), '%H:%M:%S') AS timestamp
        FROM polls WHERE no % 9 <> 0 AND no % 17 <> 5 AND no % 19 <> 7
          AND (no % 23 <> 11 OR no % 13 = 4)
    )
"""


@query("spark_snapshot", SPARK_SNAPSHOT_SQL + "SELECT * EXCLUDE (no) FROM snapshot")
def spark_snapshot(spark, sf_dir):
    return ops.spark_snapshot(fixtures.spark_raw_polls(spark, sf_dir), APP)


@query("enabled_metrics", SPARK_SNAPSHOT_SQL + """,
    named(metric, position) AS (VALUES
        ('total_memory_mb', 0), ('total_disk_usage_mb', 1), ('total_shuffle_read_mb', 2),
        ('total_shuffle_write_mb', 3), ('total_gc_time_ms', 4), ('total_duration_ms', 5),
        ('jvm_heap_used_mb', 6)
    )
    SELECT entity_id, poll_id, metric, CAST(position AS BIGINT) AS position,
           CAST(CASE metric WHEN 'total_memory_mb' THEN total_memory_mb
                WHEN 'total_disk_usage_mb' THEN total_disk_usage_mb
                WHEN 'total_shuffle_read_mb' THEN total_shuffle_read_mb
                WHEN 'total_shuffle_write_mb' THEN total_shuffle_write_mb
                WHEN 'total_gc_time_ms' THEN total_gc_time_ms
                WHEN 'total_duration_ms' THEN total_duration_ms
                ELSE jvm_heap_used_mb END AS DOUBLE) AS value
    FROM snapshot, named
""")
def enabled_metrics(spark, sf_dir):
    snapshot = ops.spark_snapshot(fixtures.spark_raw_polls(spark, sf_dir), APP)
    long = catalog.enabled_metrics(snapshot, APP, [*SPARK_LABELS], SPARK_ENABLED)
    return long.withColumn("position", F.col("position").cast("bigint"))


# Polls of which no page failed or is broken.
FLINK_OK = "poll_id % 8 <> 3 AND poll_id % 11 <> 6 AND poll_id % 13 <> 2 AND poll_id % 17 <> 9"

FLINK_JOBS_SQL = """
    jobs AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id, o_orderkey,
               o_orderstatus, 'job-' || o_orderkey AS job_id,
               CASE o_orderkey % 7 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'FINISHED'
                    WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'CANCELED' WHEN 5 THEN 'CREATED' END AS status
        FROM orders
    )
"""


@query("rest_flink_jobs", f"""
    WITH {FLINK_JOBS_SQL}
    SELECT cluster_id, poll_id, job_id, status FROM jobs WHERE poll_id % 13 <> 2
""")
def rest_flink_jobs(spark, sf_dir):
    raw = fixtures.flink_raw_polls(spark, sf_dir)
    return landing.flink_jobs(raw, CLUSTER).drop("position")


@query("flink_status_histogram", f"""
    WITH {FLINK_JOBS_SQL}
    SELECT cluster_id, poll_id, coalesce(status, 'UNKNOWN') AS status, CAST(count(*) AS BIGINT) AS jobs
    FROM jobs GROUP BY ALL
""")
def flink_status_histogram(spark, sf_dir):
    return ops.status_histogram(fixtures.flink_jobs(spark, sf_dir), CLUSTER)


FLINK_SNAPSHOT_SQL = f"""
    WITH {FLINK_JOBS_SQL}, polls AS (
        SELECT cluster_id, poll_id, min(o_orderkey) AS k, count(*) AS total_jobs,
               count(*) FILTER (WHERE status = 'RUNNING') AS running_jobs,
               count(*) FILTER (WHERE status = 'FAILED') AS failed_jobs,
               count(*) FILTER (WHERE status = 'FINISHED') AS finished_jobs,
               count(*) FILTER (WHERE status IN ('CANCELLED', 'CANCELED')) AS cancelled_jobs,
               count(*) FILTER (WHERE o_orderstatus = 'F') AS task_managers,
               min(o_orderkey) FILTER (WHERE status = 'RUNNING') AS first_running
        FROM jobs GROUP BY ALL
    ), snapshot AS (
        SELECT cluster_id, poll_id, total_jobs, running_jobs, failed_jobs, finished_jobs,
               cancelled_jobs,
               CASE WHEN k % 5 <> 0 THEN k % 100 ELSE 0 END AS total_tasks,
               CASE WHEN k % 5 <> 0 THEN k % 10 ELSE 0 END AS running_tasks,
               CASE WHEN k % 5 <> 0 THEN k % 3 ELSE 0 END AS failed_tasks,
               CASE WHEN k % 5 <> 0 THEN k % 7 ELSE 0 END AS finished_tasks,
               CASE WHEN k % 5 <> 0 THEN k % 2 ELSE 0 END AS cancelled_tasks,
               k % 50 + 10 AS total_slots, k % 10 AS used_slots, k % 50 + 10 - k % 10 AS free_slots,
               task_managers, CAST(k AS DOUBLE) AS total_memory_mb,
               CAST(k * 4096 AS DOUBLE) / 1048576 AS total_network_memory_mb,
               CAST(k * 1000 AS DOUBLE) / 1048576 AS total_jvm_memory_mb,
               strftime(make_timestamp((1704067200 + 5 * poll_id) * 1000000), '%H:%M:%S') AS timestamp
        FROM polls WHERE {FLINK_OK}
    )
"""


@query("flink_snapshot", FLINK_SNAPSHOT_SQL + "SELECT * FROM snapshot")
def flink_snapshot(spark, sf_dir):
    return ops.flink_snapshot(fixtures.flink_raw_polls(spark, sf_dir), CLUSTER)


@query("bytes_to_mib", f"""
    WITH {EXECUTORS_SQL}
    SELECT entity_id, poll_id, CAST(memory AS DOUBLE) / 1048576 AS memory_mb,
           CAST(input AS DOUBLE) / 1048576 AS input_mb FROM executors
""")
def bytes_to_mib(spark, sf_dir):
    return fixtures.spark_executors(spark, sf_dir).select(
        *APP,
        units.bytes_to_mib(F.col("memoryUsed")).alias("memory_mb"),
        units.bytes_to_mib(F.col("totalInputBytes")).alias("input_mb"),
    )


@query("default_missing", f"""
    WITH {FLINK_JOBS_SQL}
    SELECT o_orderkey, coalesce(status, 'UNKNOWN') AS status,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 ELSE 0 END AS active_tasks
    FROM jobs
""")
def default_missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        units.or_unknown(F.expr(fixtures.FLINK_STATUS)).alias("status"),
        units.or_zero(F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END")).alias("active_tasks"),
    )


@query("heap_fallback", f"""
    WITH {EXECUTORS_SQL}
    SELECT entity_id, poll_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, heap AS heap_bytes FROM executors
""")
def heap_fallback(spark, sf_dir):
    return fixtures.spark_executors(spark, sf_dir).select(
        *APP, F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        units.heap_bytes(F.col("peakMemoryMetrics"), F.col("memoryMetrics")).alias("heap_bytes"),
    )


@query("free_slots", """
    WITH polls AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id, min(o_orderkey) AS k
        FROM orders GROUP BY ALL
    )
    SELECT cluster_id, poll_id, k % 50 + 10 - k % 10 AS free_slots FROM polls
    WHERE poll_id % 8 <> 3 AND poll_id % 11 <> 6
""")
def free_slots(spark, sf_dir):
    raw = fixtures.flink_raw_polls(spark, sf_dir)
    overview = landing.flink_objects(raw, "overview", CLUSTER)
    return overview.select(
        *CLUSTER, units.free_slots(F.col("`slots-total`"), F.col("`slots-used`")).alias("free_slots")
    )


@query("raw_polls_landed", """
    SELECT DISTINCT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id,
           (o_orderkey // 200) % 8 <> 3 AS ok
    FROM orders
""")
def raw_polls_landed(spark, sf_dir):
    folder = new_folder(spark, "raw-polls")
    landing.write_raw_polls(fixtures.flink_raw_polls(spark, sf_dir), folder)
    landed = landing.read_raw_polls(spark, folder).filter("endpoint = 'overview'")
    return landed.select("cluster_id", "poll_id", "ok")


@query("unreadable_pages", """
    WITH o AS (SELECT o_orderpriority AS cluster_id, o_orderkey // 200 AS poll_id, o_orderkey AS page FROM orders)
    SELECT DISTINCT cluster_id, poll_id, 'overview' AS endpoint, CAST(0 AS BIGINT) AS page FROM o
    WHERE poll_id % 11 = 6 AND poll_id % 8 <> 3
    UNION ALL SELECT cluster_id, poll_id, 'jobs', page FROM o WHERE poll_id % 13 = 2
    UNION ALL SELECT cluster_id, poll_id, 'taskmanagers', page FROM o WHERE poll_id % 17 = 9
""")
def unreadable_pages(spark, sf_dir):
    return landing.unreadable_pages(fixtures.flink_raw_polls(spark, sf_dir), CLUSTER, lists=False)


@query("unreadable_listings", """
    WITH j AS (
        SELECT 'app-' || (o_orderkey % 20) AS entity_id, o_orderkey // 200 AS poll_id, o_orderkey AS page,
               o_orderkey // 200 + o_orderkey % 20 AS no FROM orders
    ), l AS (
        SELECT 'app-' || (l_orderkey % 20) AS entity_id, l_orderkey // 200 AS poll_id,
               l_orderkey * 10 + l_linenumber AS page, l_orderkey // 200 + l_orderkey % 20 AS no FROM lineitem
    )
    SELECT entity_id, poll_id, 'jobs' AS endpoint, page FROM j WHERE no % 17 = 5
    UNION ALL SELECT entity_id, poll_id, 'stages', page FROM l WHERE no % 19 = 7 AND no % 9 <> 0
    UNION ALL SELECT entity_id, poll_id, 'executors', page FROM l WHERE no % 23 = 11 AND no % 13 <> 4
""")
def unreadable_listings(spark, sf_dir):
    return landing.unreadable_pages(fixtures.spark_raw_polls(spark, sf_dir), APP, lists=True)
