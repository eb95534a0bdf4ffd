"""Resource plans: are they feasible, and what they put on each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import constants as fixed
from fleetgauge.functions import rows


def _rules() -> dict[str, Column]:
    """Name and condition of every rule a plan must keep on its node."""
    col = F.col

    def stepped(memory: str) -> Column:
        return (col(memory) - fixed.MIN_MEMORY_MB) % fixed.MEMORY_STEP_MB == 0

    def within(value: str, low: int, high: Column) -> Column:
        return (col(value) >= low) & (col(value) <= high)

    cores, memory = fixed.MIN_CORES, fixed.MIN_MEMORY_MB
    return {
        "driver_cpu": within("driver_cpu", cores, col("node_cpus") - fixed.DEFAULT_WORKER_CORES),
        "worker_cpu": within("worker_cpu", cores, col("node_cpus") - col("driver_cpu")),
        "executor_cpu": within("executor_cpu", cores, col("worker_cpu")),
        "driver_memory": within(
            "driver_memory", memory, col("node_mem") - fixed.DEFAULT_WORKER_MEMORY_MB
        ),
        "worker_memory": within("worker_memory", memory, col("node_mem") - col("driver_memory")),
        "executor_memory": within("executor_memory", memory, col("worker_memory")),
        "driver_memory_step": stepped("driver_memory"),
        "worker_memory_step": stepped("worker_memory"),
        "executor_memory_step": stepped("executor_memory"),
    }


def check_plans(plans: DataFrame) -> DataFrame:
    """Add the names of the rules each plan breaks, and whether it breaks none.

    A rule that cannot be told, for a missing number, is broken.
    """
    broken = F.array_compact(
        F.array(*[
            F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in _rules().items()
        ])
    )
    return plans.withColumn("violated", broken).withColumn(
        "feasible", F.size("violated") == 0
    )


def allocation_tree(jobs: DataFrame) -> DataFrame:
    """The tree job, nodes, coordinator and pools, compute units as flat rows.

    ``jobs`` has the node list, the resources per node and in total, the plan's
    cores and memory, and optionally ``master_node`` and ``worker_nodes``; the
    first node and all nodes stand in where these are null. ``node_position`` and
    ``child_position`` give a row's place, so a job's tree is never collected.
    """
    here, place = F.col("_node"), F.col("_place")
    master = F.coalesce("master_node", F.get("node_list", F.lit(0)))
    workers = F.coalesce("worker_nodes", "node_list")
    # A job without nodes keeps one row here, for its root.
    on_node = jobs.select(
        "*",
        master.alias("_master"),
        workers.alias("_workers"),
        F.posexplode_outer("node_list").alias("_place", "_node"),
    )

    def card(
        level: int, kind: str, title: str | Column, cores: str, memory: str,
        child: Column | None = None, position: Column = place,
    ) -> Column:
        return F.struct(
            position.alias("node_position"),
            F.lit(level).alias("level"),
            (F.lit(0) if child is None else child).cast("int").alias("child_position"),
            F.lit(kind).alias("card_type"),
            (F.lit(title) if isinstance(title, str) else title).alias("title"),
            F.col(cores).cast("bigint").alias("cores"),
            F.col(memory).cast("bigint").alias("memory_mb"),
        )

    def only_if(condition: Column, one: Column) -> Column:
        return F.when(condition, F.array(one)).otherwise(F.array().cast(_CARDS))

    pools = F.transform(F.filter("_workers", lambda w: w == here), lambda w, i: i + 1)
    root = card(
        0, *fixed.JOB_CARD, "total_cpus", "total_memory", position=F.lit(-1)
    )
    node = card(
        1, fixed.NODE_CARD[0], F.concat(F.lit(fixed.NODE_CARD[1]), here),
        "cpus_per_node", "memory_per_node_effective",
    )
    coordinator = card(2, *fixed.COORDINATOR_CARD, "driver_cpu", "driver_memory")
    cards = F.concat(
        only_if(F.coalesce(place, F.lit(0)) == 0, root),
        only_if(place.isNotNull(), node),
        only_if(here == F.col("_master"), coordinator),
        F.coalesce(
            F.flatten(F.transform(pools, lambda i: F.array(
                card(2, *fixed.POOL_CARD, "worker_cpu", "worker_memory", i),
                card(3, *fixed.UNIT_CARD, "executor_cpu", "executor_memory", i),
            ))),
            F.array().cast(_CARDS),
        ),
    )
    return rows.structs(on_node, ["job_id"], cards, always="level")


_CARDS = (
    "array<struct<node_position:int,level:int,child_position:int,card_type:string,"
    "title:string,cores:bigint,memory_mb:bigint>>"
)
