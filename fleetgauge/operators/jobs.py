"""Scheduler jobs: identity, lookup, nodes and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import nodelists, rows


def job_identity(jobs: DataFrame) -> DataFrame:
    """Numeric job id and start with a partition, from texts.

    A zero id or start is not ok but keeps its fields; a text that is no whole
    number leaves all fields null.
    """
    job_id = F.trim("job_id").try_cast("bigint")
    start = F.trim("start_time").try_cast("bigint")
    named = F.when(F.col("partition") != "", F.col("partition"))
    readable = job_id.isNotNull() & start.isNotNull()
    return jobs.withColumns({
        "ok": F.coalesce((job_id != 0) & (start != 0), F.lit(False)),
        "job_id": F.when(readable, job_id),
        "job_start": F.when(readable, start),
        "partition": F.when(readable, F.coalesce(named, F.lit("local"))),
    }).drop("start_time")


def lookup_jobs(jobs: DataFrame, wanted: DataFrame, position: str) -> DataFrame:
    """The first job listed under each wanted numeric ``job_id``.

    Only wanted jobs are folded, to one per id, so an id listed any number of times
    meets each request once.
    """
    others = [name for name in jobs.columns if name != "job_id"]
    first = (
        jobs.withColumn("job_id", F.col("job_id").try_cast("bigint"))
        .join(wanted.select("job_id").distinct(), "job_id", "left_semi")
        .groupBy("job_id")
        .agg(F.min_by(F.struct(*others), position).alias("_job"))
    )
    return wanted.join(first, "job_id").select(
        *wanted.columns, *[F.col(f"_job.{name}") for name in others]
    )


def with_nodes(jobs: DataFrame) -> DataFrame:
    """Node names of each job, whichever way they were landed."""
    return jobs.withColumn("node_list", nodelists.normalise(F.col("job_resources.nodes")))


def job_nodes(jobs: DataFrame) -> DataFrame:
    """One row per job and node, in the order of the job's list."""
    return rows.positions(jobs, ["job_id"], F.col("node_list"), "position", "node")


def master_and_workers(jobs: DataFrame) -> DataFrame:
    """Sorted distinct nodes are the workers, the first of them is the master too."""
    workers = nodelists.sorted_distinct(F.col("node_list"))
    return jobs.withColumn("workers", workers).withColumn(
        "master", F.get("workers", F.lit(0))
    )


def _number(triple: str) -> Column:
    return F.col(triple)["number"].try_cast("bigint")


def resource_columns(jobs: DataFrame) -> DataFrame:
    """Plain numbers from the scheduler's triples.

    The scheduler gives the tasks of the whole job, which are taken per node. A
    memory per node counts only where it is set, and then also as zero.
    """
    return jobs.withColumns({
        "cpus_per_task": _number("cpus_per_task"),
        "tasks_per_node": _number("tasks"),
        "memory_per_cpu": _number("memory_per_cpu"),
        "memory_per_node": F.when(F.col("memory_per_node")["set"], _number("memory_per_node")),
    })


# What `with_nodes` and `resource_columns` read of a scheduler job.
RESOURCE_FIELDS = [
    "job_id",
    "cpus_per_task",
    "tasks",
    "memory_per_cpu",
    "memory_per_node",
    "job_resources",
]


def job_resources(jobs: DataFrame) -> DataFrame:
    """CPUs and memory per node and in total."""
    cpus = F.col("cpus_per_task") * F.col("tasks_per_node")
    return (
        jobs.withColumns({
            "node_count": F.coalesce(F.size("node_list"), F.lit(0)).cast("bigint"),
            "cpus_per_node": cpus,
            "memory_per_node_effective": F.coalesce(
                F.col("memory_per_node"), F.col("memory_per_cpu") * cpus
            ),
        })
        .withColumn("total_cpus", F.col("cpus_per_node") * F.col("node_count"))
        .withColumn(
            "total_memory", F.col("memory_per_node_effective") * F.col("node_count")
        )
    )
