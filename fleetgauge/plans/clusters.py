"""Cluster liveness queries."""

from __future__ import annotations

from fleetgauge.operators import liveness as ops
from fleetgauge.plans.registry import query
from fleetgauge.sources import fixtures, landing

WORKERS_SQL = """
    expected AS (
        SELECT c_custkey // 10 AS cluster_id,
               CASE (c_custkey // 10) % 4 WHEN 3 THEN 'storm' WHEN 2 THEN 'flink' ELSE 'spark' END AS framework,
               CASE WHEN (c_custkey // 10) % 7 <> 6 THEN 'host-' || (c_custkey % 10 // 3) END AS host,
               c_acctbal
        FROM customer
    ), counted AS (
        SELECT cluster_id, framework, count(DISTINCT host) AS wanted,
               CASE WHEN count(DISTINCT host) = 0 THEN 0 WHEN framework = 'spark' THEN alive
                    WHEN framework = 'flink' THEN managers ELSE 0 END AS active
        FROM expected JOIN (
            SELECT c_custkey // 10 AS cluster_id,
                   count(DISTINCT c_custkey % 10 // 3) FILTER (WHERE c_acctbal > 0) AS alive,
                   count(*) FILTER (WHERE c_acctbal > 4000) AS managers
            FROM customer WHERE c_custkey % 50 NOT IN (7, 23) GROUP BY 1
        ) USING (cluster_id)
        GROUP BY cluster_id, framework, alive, managers
    ), failed AS (
        SELECT c_custkey // 10 AS cluster_id,
               min(CASE WHEN c_custkey % 50 = 7 THEN 'HTTPError: 503' ELSE 'unreadable listing' END) AS error
        FROM customer WHERE c_custkey % 50 IN (7, 23) GROUP BY 1
    ), checked AS (
        SELECT cluster_id,
               wanted > 0 AND framework <> 'storm' AND wanted = active AND error IS NULL AS ok, active,
               CASE WHEN wanted > 0 AND framework <> 'storm' THEN coalesce(error, '')
                    ELSE 'no workers configured' END AS message
        FROM counted LEFT JOIN failed USING (cluster_id)
    )
"""


def _sides(spark, sf_dir):
    raw, keys = fixtures.worker_polls(spark, sf_dir), ["cluster_id"]
    listed = landing.worker_listing(raw, keys)
    return fixtures.expected_workers(spark, sf_dir), listed, landing.listing_errors(raw, keys)


@query("worker_listing", """
    SELECT c_custkey // 10 AS cluster_id,
           CASE WHEN (c_custkey // 10) % 4 = 2 THEN NULL WHEN c_acctbal > 0 THEN 'ALIVE' ELSE 'DEAD' END AS state,
           CASE WHEN (c_custkey // 10) % 4 <> 2 THEN ' host-' || (c_custkey % 10 // 3) || ' ' END AS host
    FROM customer
    WHERE ((c_custkey // 10) % 4 <> 2 OR c_acctbal > 4000) AND c_custkey % 50 NOT IN (7, 23)
""")
def worker_listing(spark, sf_dir):
    return _sides(spark, sf_dir)[1]


@query("workers_up", f"""
    WITH {WORKERS_SQL} SELECT cluster_id, ok, CAST(active AS BIGINT) AS active_count, message FROM checked
""")
def workers_up(spark, sf_dir):
    return ops.workers_up(*_sides(spark, sf_dir))


@query("cluster_up", f"""
    WITH {WORKERS_SQL}, masters AS (
        SELECT o_custkey // 10 AS cluster_id, bool_or(
            o_orderkey % 3 <> 0 AND CASE (o_custkey // 10) % 4 WHEN 3 THEN false
                WHEN 2 THEN o_orderkey % 40 = 2 ELSE o_orderkey % 40 = 1 END) AS found
        FROM orders GROUP BY 1
    )
    SELECT cluster_id, coalesce(found, false) AS master_found, ok AS workers_up,
           coalesce(found, false) AND ok AS cluster_up
    FROM checked LEFT JOIN masters USING (cluster_id)
""")
def cluster_up(spark, sf_dir):
    expected, listed, errors = _sides(spark, sf_dir)
    return ops.cluster_up(expected, listed, fixtures.cluster_processes(spark, sf_dir), errors)
