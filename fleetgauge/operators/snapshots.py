"""Per-poll snapshots of applications and clusters from landed REST listings.

``raw`` frames have ``endpoint``, ``poll_ts``, ``ok`` and ``payload`` next to the
key columns. A poll may land one endpoint in several pages, so large listings need
no large documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.functions import payloads, units

Names = Sequence[str]


def _total(value: Column) -> Column:
    return units.or_zero(F.sum(value))


def job_count_aggs(status: Column) -> list[Column]:
    return [
        F.count_if(status == "RUNNING").alias("active_jobs"),
        F.count_if(status == "SUCCEEDED").alias("completed_jobs"),
        F.count_if(status == "FAILED").alias("failed_jobs"),
    ]


def stage_count_aggs(status: Column) -> list[Column]:
    return [
        F.count_if(status == "ACTIVE").alias("active_stages"),
        F.count_if(status == "COMPLETE").alias("completed_stages"),
        F.count_if(status == "FAILED").alias("failed_stages"),
    ]


def task_total_aggs(job: Column) -> list[Column]:
    return [
        _total(job["numActiveTasks"]).alias("active_tasks"),
        _total(job["numCompletedTasks"]).alias("completed_tasks"),
        _total(job["numFailedTasks"]).alias("failed_tasks"),
    ]


def executor_sums(executor: Column) -> list[Column]:
    """Sums that can be added up further; sizes are still bytes."""
    heap = F.when(
        executor.isNotNull(),
        units.heap_bytes(executor["peakMemoryMetrics"], executor["memoryMetrics"]),
    )
    values = {
        "total_cores": executor["totalCores"],
        "total_memory_mb": executor["memoryUsed"],
        "total_disk_usage_mb": executor["diskUsed"],
        "total_input_mb": executor["totalInputBytes"],
        "total_shuffle_read_mb": executor["totalShuffleRead"],
        "total_shuffle_write_mb": executor["totalShuffleWrite"],
        "total_gc_time_ms": executor["totalGCTime"],
        "total_duration_ms": executor["totalDuration"],
        "jvm_heap_used_mb": heap,
    }
    return [
        F.count(executor).alias("executor_count"),
        *[_total(value).alias(name) for name, value in values.items()],
    ]


def in_units(sums: DataFrame) -> list[Column]:
    """All columns; those of sizes in MiB. Whole bytes are divided once, which is exact."""
    return [
        units.bytes_to_mib(F.col(name)).alias(name) if name.endswith("_mb") else F.col(name)
        for name in sums.columns
    ]


def executor_totals(executors: DataFrame, keys: Names, executor: Column) -> DataFrame:
    sums = executors.groupBy(*keys).agg(*executor_sums(executor))
    return sums.select(*in_units(sums))


def _polls(pages: DataFrame, keys: Names, endpoints: Names, aggs: list[Column]) -> DataFrame:
    """Aggregate ``pages`` per poll; ``ok`` is false where any endpoint failed."""
    arrived = [F.coalesce(F.bool_or(F.col("endpoint") == name), F.lit(False)) for name in endpoints]
    complete = F.bool_and("page_ok")
    for seen in arrived:
        complete = complete & seen
    return pages.groupBy(*keys).agg(
        *aggs,
        F.date_format(F.max("poll_ts"), "HH:mm:ss").alias("timestamp"),
        complete.alias("ok"),
    )


SPARK_PAGES = ("jobs", "stages", "executors")
_STATE = {"_ts": F.max, "_ok": F.bool_and, **{f"_has_{name}": F.bool_or for name in SPARK_PAGES}}


def spark_parts(raw: DataFrame, keys: Names) -> DataFrame:
    """Sums over the pages at hand, one row per application and poll.

    The three listings are parsed with one record type and aggregated together: one
    pass and one shuffle. Parts of a poll add up (``merge_parts``), whatever pages
    each was made of.
    """
    parsed = payloads.record_list(F.col("payload"), schemas.SPARK_RECORD)
    pages = (
        raw.filter(F.col("endpoint").isin(*SPARK_PAGES))
        .select(*keys, "endpoint", "poll_ts", "ok", parsed.alias("_records"))
        .select(
            *keys, "endpoint", "poll_ts",
            F.coalesce(F.col("ok") & F.col("_records").isNotNull(), F.lit(False)).alias("page_ok"),
            F.explode_outer("_records").alias("_record"),
        )
    )

    def of(endpoint: str) -> Column:
        return F.when(F.col("endpoint") == endpoint, F.col("_record"))

    return pages.groupBy(*keys).agg(
        *job_count_aggs(of("jobs")["status"]),
        *stage_count_aggs(of("stages")["status"]),
        *task_total_aggs(of("jobs")),
        *executor_sums(of("executors")),
        F.max("poll_ts").alias("_ts"),
        F.bool_and("page_ok").alias("_ok"),
        *[F.bool_or(F.col("endpoint") == name).alias(f"_has_{name}") for name in SPARK_PAGES],
    )


def merge_parts(parts: DataFrame, keys: Names) -> DataFrame:
    """Parts of the same polls added up."""
    names = [name for name in parts.columns if name not in keys]
    return parts.groupBy(*keys).agg(
        *[_STATE.get(name, F.sum)(F.col(name)).alias(name) for name in names]
    )


def complete_polls(parts: DataFrame, keys: Names) -> DataFrame:
    """Figures of the polls of which all endpoints arrived and could be read."""
    whole = F.col("_ok")
    for name in SPARK_PAGES:
        whole = whole & F.col(f"_has_{name}")
    sums = parts.drop(*_STATE)
    return parts.filter(whole).select(
        *in_units(sums), F.date_format("_ts", "HH:mm:ss").alias("timestamp")
    )


def spark_polls(raw: DataFrame, current: DataFrame, keys: Names) -> DataFrame:
    """Figures of all polls of clusters, failed ones too, with a candidate application.

    ``raw`` holds the application listing too, ``current`` an ``app_id`` per poll (see
    ``selection.current_app``). ``ok`` tells whether a poll is complete, its listing
    included; only then its figures mean something.
    """
    listing = payloads.record_list(F.col("payload"), schemas.APPLICATION)
    listed = (
        raw.filter(F.col("endpoint") == "applications")
        .withColumn("_read", F.coalesce(F.col("ok") & listing.isNotNull(), F.lit(False)))
        .groupBy(*keys).agg(F.bool_and("_read").alias("_listed"))
    )
    whole = F.col("_ok") & F.coalesce("_listed", F.lit(False))
    for name in SPARK_PAGES:
        whole = whole & F.col(f"_has_{name}")
    parts = spark_parts(raw, keys)
    sums = parts.drop(*_STATE)
    return (
        parts.join(listed, [*keys], "left")
        .select(*in_units(sums), F.date_format("_ts", "HH:mm:ss").alias("timestamp"), whole.alias("ok"))
        .join(current.withColumnRenamed("app_id", "candidate"), [*keys], "left")
    )


def spark_snapshot(raw: DataFrame, keys: Names) -> DataFrame:
    """Job, stage, task and executor figures, one row per application and poll.

    A listing that arrived empty counts as zeros. A poll with a failed, missing or
    unreadable page gives nothing.
    """
    return complete_polls(spark_parts(raw, keys), keys)


def status_histogram(jobs: DataFrame, keys: Names) -> DataFrame:
    """How many jobs have each status; a missing one counts as UNKNOWN."""
    return (
        jobs.withColumn("status", units.or_unknown(F.col("status")))
        .groupBy(*keys, "status")
        .agg(F.count(F.lit(1)).alias("jobs"))
    )


def flink_polls(raw: DataFrame, keys: Names) -> DataFrame:
    """Figures of all polls, failed ones too, with the first running job listed.

    ``ok`` tells whether a poll is complete; only then its figures mean something.
    """
    endpoints = ("overview", "jobs", "taskmanagers")
    pages = raw.filter(F.col("endpoint").isin(*endpoints)).select(
        *keys, "endpoint", "poll_ts", "page", "ok",
        payloads.page_object(F.col("payload"), schemas.FLINK_OBJECT).alias("_doc"),
    )
    pages = pages.withColumn(
        "page_ok", F.coalesce(F.col("ok") & payloads.readable(F.col("_doc")), F.lit(False))
    )
    jobs, doc = F.col("_doc.jobs"), F.col("_doc")

    def listed(values: Column) -> Column:
        return _total(F.when(values.isNotNull(), F.size(values)).cast("bigint"))

    def with_status(*names: str) -> Column:
        return listed(F.filter(jobs, lambda job: job["status"].isin(*names)))

    def gauge(value: Column) -> Column:
        return units.or_zero(F.max(value))

    running = F.filter(jobs, lambda job: job["status"] == "RUNNING")
    first_running = F.get(running, F.lit(0))["id"]
    used, total = gauge(doc["slots-used"]), gauge(doc["slots-total"])
    aggs = [
        listed(jobs).alias("total_jobs"),
        with_status("RUNNING").alias("running_jobs"),
        with_status("FAILED").alias("failed_jobs"),
        with_status("FINISHED").alias("finished_jobs"),
        # Jobs are reported with either spelling, tasks with the second only.
        with_status("CANCELLED", "CANCELED").alias("cancelled_jobs"),
        gauge(doc["tasks"]["total"]).alias("total_tasks"),
        gauge(doc["tasks"]["running"]).alias("running_tasks"),
        gauge(doc["tasks"]["failed"]).alias("failed_tasks"),
        gauge(doc["tasks"]["finished"]).alias("finished_tasks"),
        gauge(doc["tasks"]["canceled"]).alias("cancelled_tasks"),
        total.alias("total_slots"),
        used.alias("used_slots"),
        units.free_slots(total, used).alias("free_slots"),
        listed(doc["taskmanagers"]).alias("task_managers"),
        units.bytes_to_mib(gauge(doc["total-memory"])).alias("total_memory_mb"),
        units.bytes_to_mib(gauge(doc["total-network-memory"])).alias("total_network_memory_mb"),
        units.bytes_to_mib(gauge(doc["total-jvm-memory"])).alias("total_jvm_memory_mb"),
    ]
    candidate = F.min_by(first_running, F.when(first_running.isNotNull(), F.col("page")))
    return _polls(pages, keys, endpoints, [*aggs, candidate.alias("candidate")])


def flink_snapshot(raw: DataFrame, keys: Names) -> DataFrame:
    """Job, task, slot and memory figures, one row per cluster and poll."""
    return flink_polls(raw, keys).filter("ok").drop("ok", "candidate")
