"""Process queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import processes as ops
from fleetgauge.plans.registry import query
from fleetgauge.sources import fixtures, landing

PROCS_SQL = """
    procs AS (
        SELECT p_partkey AS pid, p_brand AS username, 'cluster-' || (p_partkey % 3) AS cluster_id,
               'host-' || (p_partkey % 7) AS host, p_partkey // 50 AS poll_id,
               CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'root' END AS owner,
               CASE p_size % 10 WHEN 0 THEN 'zombie' WHEN 1 THEN 'dead' WHEN 2 THEN 'running'
                    ELSE 'sleeping' END AS status,
               CASE WHEN p_size % 13 = 0 THEN '' ELSE p_name || ' ' || p_type END AS command,
               p_name, p_type, p_size
        FROM part
    )
"""

MATCH_SQL = f"""
    WITH {PROCS_SQL}, titled AS (
        SELECT *, CASE WHEN contains(command, 'gear') THEN 'Gears' WHEN contains(command, 'ring') THEN 'ring'
                       WHEN contains(command, 'ECONOMY') THEN 'ECONOMY'
                       WHEN contains(command, 'ECON') THEN 'Eco again'
                       WHEN contains(command, 'economy') THEN 'Never'
                       WHEN contains(command, 'red ') THEN 'Red' END AS title
        FROM procs WHERE status NOT IN ('zombie', 'dead') AND username = owner
    ), matched AS (SELECT * FROM titled WHERE title IS NOT NULL)
"""

def _matched(spark, sf_dir):
    return ops.match_processes(
        fixtures.processes(spark, sf_dir), F.col("owner"), fixtures.PATTERNS
    )


@query("process_match", MATCH_SQL + "SELECT pid, username, title FROM matched")
def process_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("pid", "username", "title")


@query("process_samples", f"""
    WITH {PROCS_SQL}
    SELECT cluster_id, host, poll_id, pid, username, status, CAST(p_size AS BIGINT) AS num_threads,
           pid * 123456 AS rss
    FROM procs WHERE pid % 31 <> 5
""")
def process_samples(spark, sf_dir):
    raw = fixtures.process_polls(spark, sf_dir)
    return landing.process_samples(raw, ["cluster_id", "host", "poll_id"]).select(
        "cluster_id", "host", "poll_id", "pid", "username", "status", "num_threads", "rss"
    )


@query("process_snapshot", MATCH_SQL + """
    SELECT title, pid, CAST(p_size * 0.25 AS DOUBLE) AS cpu, CAST(p_size AS DOUBLE) AS mem_pct,
           CAST(pid * 123456 AS DOUBLE) / 1048576 AS mem_rss,
           CAST(pid * 234567 AS DOUBLE) / 1048576 AS mem_vms, CAST(p_size AS BIGINT) AS threads,
           CAST(pid * 1000 AS DOUBLE) / 1048576 AS io_read,
           CAST(pid * 3000 AS DOUBLE) / 1048576 AS io_write
    FROM matched
""")
def process_snapshot(spark, sf_dir):
    return ops.process_snapshot(_matched(spark, sf_dir), ["title", "pid"])


@query("process_any_pattern", f"""
    WITH {PROCS_SQL}
    SELECT pid, command FROM procs
    WHERE username = owner AND command <> ''
      AND (contains(command, 'bolt') OR contains(command, 'PROMO'))
""")
def process_any_pattern(spark, sf_dir):
    found = ops.any_pattern(
        fixtures.processes(spark, sf_dir), F.col("owner"), ["bolt", "", "PROMO"]
    )
    return found.select("pid", F.array_join("cmdline", " ").alias("command"))


@query("pattern_normalise", """
    WITH landed AS (
        SELECT p_partkey AS priority, CASE WHEN p_size % 4 IN (0, 2) THEN p_type END AS title,
               CASE WHEN p_size % 4 IN (0, 1) THEN p_name END AS pattern,
               CASE WHEN p_size % 8 = 3 THEN p_brand END AS plain
        FROM part
    )
    SELECT priority, coalesce(plain, title, pattern, 'unknown') AS label,
           coalesce(plain, pattern) AS pattern
    FROM landed
""")
def pattern_normalise(spark, sf_dir):
    rows = ops.normalise_patterns(fixtures.pattern_rows(spark, sf_dir))
    return rows.select("priority", "label", "pattern")


TABLE_MATCH_SQL = f"""
    WITH {PROCS_SQL}, patterns AS (
        SELECT p_name AS pattern, min(p_partkey) AS priority FROM part GROUP BY 1
    )
    SELECT pid, 't-' || min_by(pattern, priority) AS title
    FROM procs JOIN patterns ON contains(command, pattern)
    WHERE status NOT IN ('zombie', 'dead') AND username = owner GROUP BY pid
"""


def _table_match(spark, sf_dir, gram):
    matched = ops.match_processes_table(
        fixtures.processes(spark, sf_dir),
        F.col("owner"),
        fixtures.part_patterns(spark, sf_dir),
        gram,
    )
    return matched.select("pid", "title")


@query("process_match_table", TABLE_MATCH_SQL)
def process_match_table(spark, sf_dir):
    return _table_match(spark, sf_dir, ops.GRAM)


@query("process_match_join", TABLE_MATCH_SQL)
def process_match_join(spark, sf_dir):
    """The same with runs longer than many patterns."""
    return _table_match(spark, sf_dir, 6)
