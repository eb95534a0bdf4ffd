"""Whether clusters run with all the workers they were configured with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.constants import NO_WORKERS, PROCESS_PATTERNS
from fleetgauge.functions import payloads

#: What is told of a listing that failed without a message.
UNKNOWN_ERROR = "listing failed"


def workers_up(expected: DataFrame, listed: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Compare the number of expected hosts with the number of active workers.

    ``expected`` has ``cluster_id``, ``framework`` and ``host``; a cluster without
    workers is a row without host. ``listed`` has ``cluster_id``, ``state`` and
    ``host``; task managers have neither state nor distinct hosts. The numbers are
    compared, not the names. Both sides are folded to hosts before they meet.

    ``errors`` has ``cluster_id`` and the ``message`` of listings that failed; such a
    cluster is not up, and the first message is told.
    """
    sides = expected.select(
        "cluster_id", "framework", "host", F.lit(1).alias("expected"),
        F.lit(0).alias("alive"), F.lit(0).alias("managers"),
    ).unionByName(listed.select(
        "cluster_id", F.lit(None).cast("string").alias("framework"),
        F.trim("host").alias("host"), F.lit(0).alias("expected"),
        (F.col("state") == "ALIVE").cast("int").alias("alive"), F.lit(1).alias("managers"),
    ))
    hosts = sides.groupBy("cluster_id", "host").agg(
        F.max("framework").alias("framework"),
        F.max("expected").alias("expected"),
        F.coalesce(F.max("alive"), F.lit(0)).alias("alive"),
        F.sum("managers").alias("managers"),
    )
    named = F.col("host").isNotNull()
    framework = F.lower(F.max("framework"))
    wanted = F.count_if(named & (F.col("expected") == 1))
    active = (
        F.when(wanted == 0, F.lit(0))
        .when(framework == "spark", F.count_if(named & (F.col("alive") == 1)))
        .when(framework == "flink", F.sum("managers"))
        .otherwise(F.lit(0))
    )
    known = (wanted > 0) & framework.isin("spark", "flink")
    checked = F.coalesce(known, F.lit(False))
    counted = hosts.groupBy("cluster_id").agg(
        (checked & (wanted == active)).alias("ok"),
        active.alias("active_count"),
        F.when(checked, F.lit("")).otherwise(F.lit(NO_WORKERS)).alias("message"),
    )
    if errors is None:
        return counted
    told = F.coalesce("message", F.lit(UNKNOWN_ERROR))
    failed = errors.groupBy("cluster_id").agg(F.min(told).alias("_error"))
    told = (F.col("message") == "") & F.col("_error").isNotNull()
    return counted.join(failed, "cluster_id", "left").select(
        "cluster_id",
        (F.col("ok") & ~told).alias("ok"),
        "active_count",
        F.when(told, F.col("_error")).otherwise(F.col("message")).alias("message"),
    )


def cluster_up(
    expected: DataFrame, listed: DataFrame, processes: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """Clusters whose master process runs under its owner and whose workers are up.

    ``processes`` has ``cluster_id``, ``framework``, ``username``, ``owner`` and
    ``cmdline``.
    """
    command = F.array_join("cmdline", " ")
    is_master = F.lit(False)
    for framework, patterns in PROCESS_PATTERNS.items():
        master = dict(patterns)["Master"]
        is_master = is_master | ((F.lower("framework") == framework) & command.contains(master))
    masters = processes.groupBy("cluster_id").agg(
        F.bool_or((F.col("username") == F.col("owner")) & is_master).alias("_found")
    )
    found = F.coalesce("_found", F.lit(False))
    return (
        workers_up(expected, listed, errors)
        .join(masters, "cluster_id", "left")
        .select(
            "cluster_id",
            found.alias("master_found"),
            F.col("ok").alias("workers_up"),
            (found & F.col("ok")).alias("cluster_up"),
        )
    )


def report_up(
    framework: str, expected: str, payload: str, ok: str, master_found: str
) -> Column:
    """Whether one poll's report shows its cluster up, from the columns of its row.

    ``expected`` is an array of hosts, ``payload`` the whole worker listing. As for
    :func:`workers_up`, distinct hosts are counted, and task managers one by one.
    """
    page = payloads.page_object(F.col(payload), schemas.WORKER_LISTING)
    alive = F.filter(page["workers"], lambda w: w["state"] == "ALIVE")
    hosts = F.array_compact(F.array_distinct(F.transform(alive, lambda w: F.trim(w["host"]))))
    wanted = F.size(F.array_compact(F.array_distinct(expected)))
    kind = F.lower(framework)
    active = F.when(kind == "spark", F.size(hosts)).when(kind == "flink", F.size(page["taskmanagers"]))
    usable = F.col(ok) & payloads.readable(page) & F.col(master_found)
    return F.coalesce(usable & (wanted > 0) & (wanted == active), F.lit(False))
