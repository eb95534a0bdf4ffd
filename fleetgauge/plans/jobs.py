"""Scheduler job, node list and allocation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import nodelists
from fleetgauge.operators import allocation, noderanges
from fleetgauge.operators import jobs as ops
from fleetgauge.plans.registry import query
from fleetgauge.session import new_folder
from fleetgauge.sources import fixtures, landing
from fleetgauge.sources.tables import table

SLURM_SQL = """
    slurm AS (
        SELECT o_orderkey * 2 AS job_id, ['a' || (o_custkey % 7), 'b'] AS node_list, * FROM orders
        UNION ALL
        SELECT o_orderkey * 2 + 1, list_transform(range(1, o_orderkey % 3 + 2), lambda i: 'n' || i), *
        FROM orders
    )
"""


@query("slurm_jobs_explode", f"""
    WITH {SLURM_SQL}
    SELECT CAST(job_id AS VARCHAR) AS job_id, 'j' || o_custkey AS name, o_orderstatus AS "partition",
           'u' || (o_custkey % 50) AS user_name, CAST(o_orderkey + 1700000000 AS VARCHAR) AS start_time
    FROM slurm
""")
def slurm_jobs_explode(spark, sf_dir):
    jobs = landing.slurm_jobs(fixtures.slurm_documents(spark, sf_dir))
    return jobs.select(
        "job_id", "name", "partition", "user_name", F.col("start_time.number").alias("start_time")
    )


@query("slurm_job_resources", f"""
    WITH {SLURM_SQL}, resources AS (
        SELECT job_id, len(node_list) AS node_count, o_custkey % 16 + 1 AS cpus, o_orderkey % 4 + 1 AS tasks,
               CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 3 * 4000 END AS memory_per_node
        FROM slurm
    ), effective AS (
        SELECT *, coalesce(memory_per_node, 512 * cpus * tasks) AS memory FROM resources
    )
    SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(node_count AS BIGINT) AS node_count,
           cpus * tasks AS cpus_per_node, memory AS memory_per_node_effective,
           CAST(cpus * tasks * node_count AS BIGINT) AS total_cpus,
           CAST(memory * node_count AS BIGINT) AS total_memory
    FROM effective
""")
def slurm_job_resources(spark, sf_dir):
    documents = fixtures.slurm_documents(spark, sf_dir)
    jobs = landing.slurm_jobs(documents, fields=ops.RESOURCE_FIELDS)
    return ops.job_resources(ops.resource_columns(ops.with_nodes(jobs))).select(
        "job_id", "node_count", "cpus_per_node", "memory_per_node_effective", "total_cpus", "total_memory"
    )


@query("slurm_job_lookup", """
    SELECT c_custkey AS job_id, min(o_orderkey) AS position, 'u' || (min(o_orderkey) % 50) AS user_name,
           min_by(o_orderstatus, o_orderkey) AS "partition"
    FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderkey % 10 <> 9
    GROUP BY c_custkey
""")
def slurm_job_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    return ops.lookup_jobs(fixtures.job_rows(spark, sf_dir), wanted, "position")


@query("job_identity", """
    WITH texts AS (
        SELECT o_orderkey AS row_id,
               CASE WHEN o_orderkey % 6 = 0 THEN 0 WHEN o_orderkey % 6 > 2 THEN o_custkey END AS id,
               CASE WHEN o_custkey % 5 = 1 THEN 0 WHEN o_custkey % 5 > 1 THEN 1700000000 + o_orderkey END AS start,
               CASE o_orderstatus WHEN 'O' THEN 'batch' ELSE 'local' END AS part
        FROM orders
    )
    SELECT row_id, coalesce(id <> 0 AND start <> 0, false) AS ok,
           CASE WHEN start IS NOT NULL THEN CAST(id AS VARCHAR) END AS job_id,
           CASE WHEN id IS NOT NULL THEN CAST(start AS VARCHAR) END AS job_start,
           CASE WHEN id IS NOT NULL AND start IS NOT NULL THEN part END AS "partition"
    FROM texts
""")
def job_identity(spark, sf_dir):
    jobs = ops.job_identity(fixtures.job_identity_rows(spark, sf_dir))
    return jobs.select(
        "row_id", "ok", F.col("job_id").cast("string"), F.col("job_start").cast("string"), "partition"
    )


RESOURCES_SQL = """
    given AS (
        SELECT o_orderkey AS job_id,
               CASE WHEN o_orderkey % 9 = 8 THEN []::VARCHAR[]
                    ELSE list_transform(range(1, o_orderkey % 4 + 2), lambda i: 'n' || (o_custkey % 10 + i))
               END AS node_list,
               (o_custkey % 16 + 1) * (o_orderkey % 3 + 1) AS cpus_per_node,
               512 * (o_custkey % 3) AS memory_per_cpu,
               CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 * 8000 END AS memory_per_node
        FROM orders
    ), resources AS (
        SELECT job_id, node_list, CAST(len(node_list) AS BIGINT) AS node_count, cpus_per_node,
               coalesce(memory_per_node, memory_per_cpu * cpus_per_node) AS memory_per_node_effective
        FROM given
    )
"""


@query("job_resources", f"""
    WITH {RESOURCES_SQL}
    SELECT job_id, node_count, cpus_per_node, memory_per_node_effective,
           cpus_per_node * node_count AS total_cpus,
           memory_per_node_effective * node_count AS total_memory
    FROM resources
""")
def job_resources(spark, sf_dir):
    return ops.job_resources(fixtures.job_resource_rows(spark, sf_dir)).select(
        "job_id", "node_count", "cpus_per_node", "memory_per_node_effective", "total_cpus", "total_memory"
    )


NODES_SQL = """
    shapes AS (SELECT o_orderkey AS job_id, o_custkey AS c, o_orderkey % 12 AS shape, o_orderkey AS k FROM orders),
    nodes AS (
        SELECT job_id, shape, CASE shape
            WHEN 0 THEN list_transform(range(c, c + k % 4 + 1), lambda i: 'n' || lpad(
                CAST(i AS VARCHAR), CAST(greatest(len(CAST(c AS VARCHAR)), len(CAST(i AS VARCHAR))) AS INTEGER), '0'))
            WHEN 1 THEN list_concat(
                list_transform(range(c % 9, 11 + c % 5), lambda i: 'node' || lpad(CAST(i AS VARCHAR), 2, '0')),
                ['node' || k])
            WHEN 2 THEN ['host' || c]
            WHEN 3 THEN ['n98', 'n99', 'n100', 'n101']
            WHEN 6 THEN ['x' || c]
            WHEN 7 THEN ['c' || c]
            WHEN 8 THEN ['p' || c, 'p1', 'p' || c]
            WHEN 11 THEN ['l1', 'l2']
            WHEN 5 THEN NULL
            ELSE []::VARCHAR[] END AS node_list
        FROM shapes
    )
"""


@query("nodelist_normalise", f"""
    WITH {NODES_SQL}
    SELECT job_id, node_list IS NOT NULL AS readable, CAST(coalesce(len(node_list), 0) AS BIGINT) AS node_count,
           array_to_string(node_list, ' ') AS names
    FROM nodes
""")
def nodelist_normalise(spark, sf_dir):
    names = nodelists.normalise(F.col("nodes"))
    return fixtures.node_texts(spark, sf_dir).withColumn("node_list", names).select(
        "job_id", F.col("node_list").isNotNull().alias("readable"),
        F.coalesce(F.size("node_list"), F.lit(0)).cast("bigint").alias("node_count"),
        F.array_join("node_list", " ").alias("names"),
    )


@query("nodelist_expand", f"""
    WITH {NODES_SQL}
    SELECT job_id, CAST(i - 1 AS BIGINT) AS position, node_list[i] AS node
    FROM nodes, unnest(range(1, len(node_list) + 1)) AS r(i)
""")
def nodelist_expand(spark, sf_dir):
    jobs = fixtures.node_texts(spark, sf_dir).withColumn(
        "node_list", nodelists.normalise(F.col("nodes"))
    )
    return ops.job_nodes(jobs).withColumn("position", F.col("position").cast("bigint"))


@query("master_and_workers", f"""
    WITH {NODES_SQL}
    SELECT job_id, list_sort(list_distinct(node_list))[1] AS master,
           array_to_string(list_sort(list_distinct(node_list)), ' ') AS workers
    FROM nodes
""")
def master_and_workers(spark, sf_dir):
    jobs = fixtures.node_texts(spark, sf_dir).withColumn(
        "node_list", nodelists.normalise(F.col("nodes"))
    )
    return ops.master_and_workers(jobs).select(
        "job_id", "master", F.array_join("workers", " ").alias("workers")
    )


@query("allocation_check", """
    WITH plans AS (
        SELECT l_orderkey AS plan_id, s_suppkey AS node_id, CAST(l_quantity AS BIGINT) % 9 AS dc,
               CAST(l_quantity AS BIGINT) % 14 AS wc, CAST(l_quantity AS BIGINT) % 8 AS ec,
               872 + l_orderkey % 4 * 128 + l_linenumber // 7 * 28 AS dm,
               1000 + CAST(l_quantity AS BIGINT) * 128 AS wm,
               1000 + CAST(l_quantity AS BIGINT) % 25 * 192 AS em,
               s_suppkey % 12 + 2 AS nc, 2000 + s_suppkey % 10 * 700 AS nm
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    ), checked AS (
        SELECT plan_id, node_id, list_filter([
            CASE WHEN dc NOT BETWEEN 1 AND nc - 1 THEN 'driver_cpu' END,
            CASE WHEN wc NOT BETWEEN 1 AND nc - dc THEN 'worker_cpu' END,
            CASE WHEN ec NOT BETWEEN 1 AND wc THEN 'executor_cpu' END,
            CASE WHEN dm NOT BETWEEN 1000 AND nm - 1000 THEN 'driver_memory' END,
            CASE WHEN wm NOT BETWEEN 1000 AND nm - dm THEN 'worker_memory' END,
            CASE WHEN em NOT BETWEEN 1000 AND wm THEN 'executor_memory' END,
            CASE WHEN (dm - 1000) % 128 <> 0 THEN 'driver_memory_step' END,
            CASE WHEN (wm - 1000) % 128 <> 0 THEN 'worker_memory_step' END,
            CASE WHEN (em - 1000) % 128 <> 0 THEN 'executor_memory_step' END
        ], lambda x: x IS NOT NULL) AS broken
        FROM plans
    )
    SELECT plan_id, node_id, len(broken) = 0 AS feasible, array_to_string(broken, ',') AS violated FROM checked
""")
def allocation_check(spark, sf_dir):
    checked = allocation.check_plans(fixtures.plans(spark, sf_dir))
    return checked.select(
        "plan_id", "node_id", "feasible", F.array_join("violated", ",").alias("violated")
    )


@query("allocation_tree", f"""
    WITH {RESOURCES_SQL}, planned AS (
        SELECT *, cpus_per_node * node_count AS total_cpus, memory_per_node_effective * node_count AS total_memory,
               CASE job_id % 3 WHEN 0 THEN node_list[-1] WHEN 1 THEN 'elsewhere' ELSE node_list[1] END AS master,
               CASE job_id % 4 WHEN 0 THEN [node_list[-1], node_list[1], node_list[-1]]
                    ELSE node_list END AS workers
        FROM resources
    ), on_nodes AS (
        SELECT *, i - 1 AS node_position, node_list[i] AS node
        FROM planned, unnest(range(1, len(node_list) + 1)) AS r(i)
    ), pools AS (
        SELECT o.*, p FROM on_nodes o,
               unnest(range(1, len(list_filter(workers, lambda w: w = node)) + 1)) AS q(p)
    ), tree AS (
        SELECT job_id, -1 AS node_position, 0 AS level, 0 AS child_position, 'Job Allocation' AS card_type,
               'Slurm Job' AS title, total_cpus AS cores, total_memory AS memory_mb FROM planned
        UNION ALL SELECT job_id, node_position, 1, 0, 'Physical Node', 'Node ID: ' || node,
               cpus_per_node, memory_per_node_effective FROM on_nodes
        UNION ALL SELECT job_id, node_position, 2, 0, 'Process', 'Coordinator',
               job_id % 4 + 1, 1000 + job_id % 5 * 128 FROM on_nodes WHERE node = master
        UNION ALL SELECT job_id, node_position, 2, p, '', 'Resource Pool',
               job_id % 8 + 1, 2000 + job_id % 7 * 128 FROM pools
        UNION ALL SELECT job_id, node_position, 3, p, 'Process', 'Compute Unit',
               job_id % 2 + 1, 1000 + job_id % 3 * 128 FROM pools
    )
    SELECT job_id, CAST(node_position AS BIGINT) AS node_position, CAST(level AS BIGINT) AS level,
           CAST(child_position AS BIGINT) AS child_position, card_type, title, cores, memory_mb
    FROM tree
""")
def allocation_tree(spark, sf_dir):
    tree = allocation.allocation_tree(fixtures.tree_jobs(spark, sf_dir))
    return tree.withColumns({
        name: F.col(name).cast("bigint") for name in ("node_position", "level", "child_position")
    })


# ------------------------------------------------------------------- scheduler files


def _slurm_files(spark, sf_dir):
    path = new_folder(spark, "slurm-files")
    fixtures.write_slurm_files(spark, sf_dir, path)
    file = F.regexp_extract("file", "file=([0-9]+)", 1).cast("bigint")
    return landing.slurm_file_documents(spark, path).withColumn("file", file)


@query("slurm_files", """
    SELECT o_orderkey % 40 AS file, CAST(o_orderkey AS VARCHAR) AS job_id, 'u' || o_custkey AS user_name
    FROM orders
    WHERE o_orderkey % 40 NOT IN (3, 7, 11, 13) AND NOT (o_orderkey % 40 = 17 AND o_orderkey % 3 = 0)
""")
def slurm_files(spark, sf_dir):
    return landing.slurm_file_jobs(_slurm_files(spark, sf_dir)).select("file", "job_id", "user_name")


@query("slurm_file_faults", """
    SELECT file, CASE file WHEN 11 THEN 'empty file' WHEN 13 THEN 'no list of jobs'
        WHEN 17 THEN 'job without an id' ELSE 'unreadable document' END AS reason
    FROM (SELECT DISTINCT o_orderkey % 40 AS file FROM orders)
    WHERE file IN (3, 7, 11, 13, 17)
""")
def slurm_file_faults(spark, sf_dir):
    return landing.slurm_file_faults(_slurm_files(spark, sf_dir))


# ------------------------------------------------------------------------ node ranges

NODE_RANGES_SQL = """
    lists AS (
        SELECT o_orderkey AS job_id, o_custkey % 50 AS cluster_id, o_orderstatus = 'F' AS drained,
               o_orderkey * 10 AS low, o_orderkey * 10 + CASE WHEN o_orderkey % 5000 = 0 THEN 3000000000
                   ELSE o_custkey % 7 - 1 END AS high, o_custkey % 10 AS padded
        FROM orders
    )
"""


@query("nodelist_count", f"""
    WITH {NODE_RANGES_SQL}
    SELECT job_id, greatest(high - low + 1, 0) + 1 AS nodes FROM lists
""")
def nodelist_count(spark, sf_dir):
    lists = fixtures.node_range_texts(spark, sf_dir)
    return lists.select("job_id", nodelists.count_nodes(nodelists.ranges(F.col("nodes"))).alias("nodes"))


@query("nodelist_members", f"""
    WITH {NODE_RANGES_SQL}
    SELECT 'n' || number AS name, job_id
    FROM (SELECT c_custkey * 10 + c_custkey % 3 AS number FROM customer) JOIN lists
        ON number BETWEEN low AND high
""")
def nodelist_members(spark, sf_dir):
    ranges = noderanges.exploded(fixtures.node_range_texts(spark, sf_dir), ["job_id"])
    return noderanges.members(fixtures.node_names(spark, sf_dir), ranges)


@query("nodelist_difference", f"""
    WITH {NODE_RANGES_SQL}, names AS (
        SELECT cluster_id, drained, 'n' || unnest(range(low, high + 1)) AS name
        FROM lists WHERE job_id % 5000 <> 0
        UNION ALL SELECT cluster_id, drained, 'n0' || padded FROM lists WHERE job_id % 5000 <> 0
    )
    SELECT cluster_id, CAST(count(DISTINCT name) AS BIGINT) AS nodes FROM names n
    WHERE NOT drained AND NOT EXISTS (
        SELECT 1 FROM names d WHERE d.drained AND d.cluster_id = n.cluster_id AND d.name = n.name)
    GROUP BY cluster_id
""")
def nodelist_difference(spark, sf_dir):
    """Nodes per cluster that jobs name and no drained one does."""
    lists = fixtures.node_range_texts(spark, sf_dir).filter("job_id % 5000 <> 0")
    keys = ["cluster_id"]
    busy = noderanges.exploded(lists.filter("NOT drained"), keys)
    drained = noderanges.exploded(lists.filter("drained"), keys)
    return noderanges.sizes(noderanges.difference(busy, drained, keys), keys)
