"""Application and cluster snapshots."""

import json

import pytest

from fleetgauge.operators import snapshots as ops
from fleetgauge.operators.catalog import enabled_metrics
from fleetgauge.constants import SPARK_ENABLED, SPARK_LABELS
from fleetgauge.operators.selection import current_flink_job
from fleetgauge.sources import landing

MIB = 1024 ** 2
RAW = "entity_id string, poll_id long, endpoint string, poll_ts timestamp, page long, ok boolean, payload string"
KEYS = ["entity_id", "poll_id"]


def raw(spark, pages, poll=1):
    from datetime import datetime

    at = datetime(2024, 1, 1, 12, 0, poll)
    rows = [
        ("app-1", poll, endpoint, at, page, ok, doc if isinstance(doc, str) or doc is None else json.dumps(doc))
        for page, (endpoint, ok, doc) in enumerate(pages)
    ]
    return spark.createDataFrame(rows, RAW)


JOBS = [
    {"numFailedTasks": 5, "status": "FAILED", "numCompletedTasks": 11},
    {"status": "RUNNING", "numActiveTasks": 17, "numCompletedTasks": None, "numFailedTasks": 2},
    {"status": "RUNNING", "numActiveTasks": 13, "numCompletedTasks": 29},
    {"status": "UNKNOWN", "numFailedTasks": None},
]
STAGES = [
    {"status": "FAILED"}, {"status": "SKIPPED"}, {"status": "ACTIVE"}, {"status": "FAILED"},
    {"status": "ACTIVE"}, {"status": "ACTIVE"}, {"status": "COMPLETE"},
]
EXECUTORS = [
    {"memoryMetrics": {"usedOnHeapStorageMemory": 23 * MIB}, "totalCores": 3, "totalDuration": 907,
     "totalShuffleWrite": 19 * MIB},
    {"totalCores": 14, "memoryUsed": 37 * MIB, "diskUsed": 41 * MIB, "totalInputBytes": MIB // 4,
     "totalShuffleRead": 43 * MIB, "totalShuffleWrite": 53 * MIB, "totalGCTime": 31,
     "peakMemoryMetrics": {"JVMHeapMemory": 59 * MIB}},
    {"totalInputBytes": MIB // 2, "memoryUsed": 61 * MIB, "totalDuration": 1},
]


def test_application_snapshot(spark):
    df = raw(spark, [("jobs", True, JOBS), ("stages", True, STAGES), ("executors", True, EXECUTORS)])
    assert ops.spark_snapshot(df, KEYS).first().asDict() == {
        "entity_id": "app-1", "poll_id": 1,
        "active_jobs": 2, "completed_jobs": 0, "failed_jobs": 1,
        "active_stages": 3, "completed_stages": 1, "failed_stages": 2,
        "active_tasks": 30, "completed_tasks": 40, "failed_tasks": 7,
        "executor_count": 3, "total_cores": 17, "total_memory_mb": 98.0,
        "total_disk_usage_mb": 41.0, "total_input_mb": 0.75, "total_shuffle_read_mb": 43.0,
        "total_shuffle_write_mb": 72.0, "total_gc_time_ms": 31, "total_duration_ms": 908,
        "jvm_heap_used_mb": 82.0,
        "timestamp": "12:00:01",
    }


def test_pages_of_a_poll_are_added(spark):
    whole = raw(spark, [("jobs", True, JOBS), ("stages", True, STAGES), ("executors", True, EXECUTORS)])
    pages = raw(spark, [("jobs", True, [j]) for j in JOBS] + [("stages", True, [s]) for s in STAGES]
                + [("executors", True, [e]) for e in EXECUTORS])
    assert ops.spark_snapshot(pages, KEYS).collect() == ops.spark_snapshot(whole, KEYS).collect()


@pytest.mark.parametrize("executor, heap", [
    ({"memoryMetrics": {"usedOnHeapStorageMemory": 8 * MIB}}, 8.0),
    ({"peakMemoryMetrics": {}, "memoryMetrics": {"usedOnHeapStorageMemory": 8 * MIB}}, 8.0),
    ({"peakMemoryMetrics": {"Other": 1}, "memoryMetrics": {"usedOnHeapStorageMemory": 8 * MIB}}, 0.0),
    ({"memoryMetrics": {"other": 1}}, 0.0),
    ({}, 0.0),
])
def test_heap_fallback(spark, executor, heap):
    df = raw(spark, [("jobs", True, []), ("stages", True, []), ("executors", True, [executor])])
    assert ops.spark_snapshot(df, KEYS).first()["jvm_heap_used_mb"] == heap


def test_empty_endpoints_are_zeros(spark):
    df = raw(spark, [("jobs", True, []), ("stages", True, []), ("executors", True, [])])
    row = ops.spark_snapshot(df, KEYS).first().asDict()
    assert {v for k, v in row.items() if k not in ("entity_id", "poll_id", "timestamp")} == {0}


@pytest.mark.parametrize("pages", [
    [("jobs", True, JOBS), ("stages", False, None), ("executors", True, EXECUTORS)],
    [("jobs", True, JOBS), ("stages", True, "<html>"), ("executors", True, EXECUTORS)],
    [("jobs", True, JOBS), ("stages", True, {"error": "x"}), ("executors", True, EXECUTORS)],
    [("jobs", True, json.dumps(JOBS)[:-3]), ("stages", True, STAGES), ("executors", True, EXECUTORS)],
    [("jobs", True, JOBS), ("executors", True, EXECUTORS)],
])
def test_failed_endpoint_drops_the_poll(spark, pages):
    assert ops.spark_snapshot(raw(spark, pages), KEYS).count() == 0


OVERVIEW = {
    "slots-used": 21, "slots-total": 64, "total-network-memory": 3 * MIB // 2,
    "tasks": {"canceled": 12, "finished": 71, "failed": 6, "running": 33, "total": 122},
    "total-jvm-memory": 700 * MIB, "total-memory": 900 * MIB,
}


def test_cluster_snapshot(spark):
    statuses = ["CANCELED", None, "RUNNING", "FINISHED", "CANCELLED", "FINISHED", "CANCELED", "FAILED"]
    jobs = {"jobs": [{"id": str(i), "status": s} for i, s in enumerate(statuses)]}
    df = raw(spark, [
        ("overview", True, OVERVIEW), ("jobs", True, jobs),
        ("taskmanagers", True, {"taskmanagers": [{"id": c} for c in "vwxyz"]}),
    ])
    assert ops.flink_snapshot(df, KEYS).first().asDict() == {
        "entity_id": "app-1", "poll_id": 1, "total_jobs": 8, "running_jobs": 1, "failed_jobs": 1,
        "finished_jobs": 2, "cancelled_jobs": 3, "total_tasks": 122, "running_tasks": 33,
        "failed_tasks": 6, "finished_tasks": 71, "cancelled_tasks": 12, "total_slots": 64,
        "used_slots": 21, "free_slots": 43, "task_managers": 5, "total_memory_mb": 900.0,
        "total_network_memory_mb": 1.5, "total_jvm_memory_mb": 700.0, "timestamp": "12:00:01",
    }
    listed = landing.flink_jobs(df, KEYS)
    counts = {r["status"]: r["jobs"] for r in ops.status_histogram(listed, KEYS).collect()}
    assert counts["UNKNOWN"] == 1 and counts["RUNNING"] == 1


def test_cluster_snapshot_of_empty_objects(spark):
    df = raw(spark, [("overview", True, {}), ("jobs", True, {}), ("taskmanagers", True, {})])
    row = ops.flink_snapshot(df, KEYS).first().asDict()
    assert {v for k, v in row.items() if k not in ("entity_id", "poll_id", "timestamp")} == {0}


@pytest.mark.parametrize("ok, overview", [
    (False, None), (True, "<html>502</html>"), (True, '{"slots-total":4'), (True, []), (True, '"x"'),
])
def test_cluster_snapshot_without_overview(spark, ok, overview):
    df = raw(spark, [("overview", ok, overview), ("jobs", True, {}), ("taskmanagers", True, {})])
    assert ops.flink_snapshot(df, KEYS).count() == 0


def test_enabled_metrics_keep_field_order(spark):
    df = raw(spark, [("jobs", True, JOBS), ("stages", True, STAGES), ("executors", True, EXECUTORS)])
    snapshot = ops.spark_snapshot(df, KEYS)
    chosen = ["failed_jobs", "active_jobs", "timestamp", "unknown"]
    long = enabled_metrics(snapshot, KEYS, [*SPARK_LABELS, "timestamp"], chosen)
    assert [(r["metric"], r["value"]) for r in long.orderBy("position").collect()] == [
        ("active_jobs", 2.0), ("failed_jobs", 1.0),
    ]
    assert enabled_metrics(snapshot, KEYS, [*SPARK_LABELS], SPARK_ENABLED).count() == 7
    assert enabled_metrics(snapshot, KEYS, [*SPARK_LABELS], []).count() == 0


def test_first_running_job_over_several_pages(spark):
    pages = [("jobs", True, {"jobs": [{"id": f"j{i}", "status": s} for i, s in page]}) for page in (
        [(0, "FAILED"), (1, "FAILED")], [(2, "FAILED"), (3, "RUNNING")], [(4, "RUNNING")],
    )]
    jobs = landing.flink_jobs(raw(spark, pages).orderBy("page", ascending=False), KEYS)
    assert current_flink_job(jobs, KEYS).first()["job_id"] == "j3"


def test_records_keep_their_place(spark):
    df = raw(spark, [("stages", True, [{"status": "b"}, {"status": "c"}]), ("stages", True, [{"status": "a"}])])
    found = landing.spark_records(df, "stages", KEYS).orderBy("position").collect()
    assert [r["status"] for r in found] == ["b", "c", "a"]
