"""Schemas of the landed metric records."""

from __future__ import annotations

from collections.abc import Sequence

RAW_POLLS = """
    source STRING, cluster_id STRING, entity_id STRING, endpoint STRING,
    poll_id BIGINT, poll_ts TIMESTAMP, page BIGINT, ok BOOLEAN, payload STRING
"""

# Application REST listings. Every endpoint returns an array of records.
APPLICATION = "STRUCT<id: STRING, attempts: ARRAY<STRUCT<completed: BOOLEAN>>>"
JOB = (
    "STRUCT<status: STRING, numActiveTasks: BIGINT, numCompletedTasks: BIGINT,"
    " numFailedTasks: BIGINT>"
)
STAGE = "STRUCT<status: STRING>"
# Both memory objects are maps, because an empty object and an object without
# the wanted key lead to different heap figures.
EXECUTOR = (
    "STRUCT<totalCores: BIGINT, memoryUsed: BIGINT, diskUsed: BIGINT,"
    " totalInputBytes: BIGINT, totalShuffleRead: BIGINT, totalShuffleWrite: BIGINT,"
    " totalGCTime: BIGINT, totalDuration: BIGINT,"
    " peakMemoryMetrics: MAP<STRING, BIGINT>, memoryMetrics: MAP<STRING, BIGINT>>"
)
SPARK_ENDPOINTS = {
    "applications": APPLICATION,
    "jobs": JOB,
    "stages": STAGE,
    "executors": EXECUTOR,
}
# One record type that covers jobs, stages and executors, so that a snapshot
# parses all three listings in a single pass.
SPARK_RECORD = (
    "STRUCT<" + JOB[len("STRUCT<"):-1] + ", " + EXECUTOR[len("STRUCT<"):-1] + ">"
)

# Cluster REST objects.
OVERVIEW = (
    "tasks: STRUCT<total: BIGINT, running: BIGINT, failed: BIGINT,"
    " finished: BIGINT, canceled: BIGINT>,"
    " `slots-total`: BIGINT, `slots-used`: BIGINT, `total-memory`: BIGINT,"
    " `total-network-memory`: BIGINT, `total-jvm-memory`: BIGINT"
)
FLINK_JOBS = "jobs: ARRAY<STRUCT<id: STRING, status: STRING>>"
TASK_MANAGERS = "taskmanagers: ARRAY<STRUCT<id: STRING>>"
FLINK_ENDPOINTS = {
    "overview": f"STRUCT<{OVERVIEW}>",
    "jobs": f"STRUCT<{FLINK_JOBS}>",
    "taskmanagers": f"STRUCT<{TASK_MANAGERS}>",
}
FLINK_OBJECT = f"STRUCT<{OVERVIEW}, {FLINK_JOBS}, {TASK_MANAGERS}>"

WORKER_LISTING = (
    f"STRUCT<workers: ARRAY<STRUCT<state: STRING, host: STRING>>, {TASK_MANAGERS}>"
)

PROCESS = (
    "STRUCT<pid: BIGINT, name: STRING, username: STRING, status: STRING,"
    " cmdline: ARRAY<STRING>, cpu_percent: DOUBLE, memory_percent: DOUBLE,"
    " rss: BIGINT, vms: BIGINT, num_threads: BIGINT,"
    " read_bytes: BIGINT, write_bytes: BIGINT>"
)

# Scheduler records. A number may be an integer or an ISO time, and nodes may be
# a list, an object or a text, so both stay strings until they are needed.
TRIPLE = "STRUCT<`set`: BOOLEAN, `infinite`: BOOLEAN, `number`: STRING>"
SLURM_FIELDS = {
    "job_id": "STRING",
    "name": "STRING",
    "partition": "STRING",
    "user_name": "STRING",
    "node_count": TRIPLE,
    "cpus_per_task": TRIPLE,
    "tasks": TRIPLE,
    "memory_per_cpu": TRIPLE,
    "memory_per_node": TRIPLE,
    "start_time": TRIPLE,
    "job_resources": "STRUCT<nodes: STRING>",
    "nodes": "STRING",
}


def slurm_jobs(fields: Sequence[str] | None = None) -> str:
    """Schema of a job or queue document, of all fields or the given ones only."""
    chosen = ", ".join(f"`{name}`: {SLURM_FIELDS[name]}" for name in fields or SLURM_FIELDS)
    return f"jobs ARRAY<STRUCT<{chosen}>>"


TRIPS = "`Date/Time` STRING, Lat DOUBLE, Lon DOUBLE, Base STRING"
