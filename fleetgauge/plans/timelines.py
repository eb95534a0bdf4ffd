"""Timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import units
from fleetgauge.operators import catalog
from fleetgauge.operators import history, timelines as ops
from fleetgauge.plans.history import SAMPLES_SQL
from fleetgauge.plans.registry import query
from fleetgauge.sources import fixtures, landing

SERIES = ["job_id", "metric"]
POLL = [*SERIES, "poll_id"]

# The blocks of each document, as the adapter writes them: values are texts.
BLOCKS_SQL = """
    polls AS (
        SELECT user_id % 5 AS job_id, event_type AS metric, event_id AS poll_id,
               CASE WHEN user_id % 2 = 0 THEN 'timeline' ELSE 'timeline_extern' END AS endpoint,
               event_id % 6 AS shape, user_id % 9 AS j, epoch_us(ts) // 300000000 * 300 AS g,
               CAST(round(value * 100) AS BIGINT) AS v
        FROM events
    ),
    blocks AS (
        SELECT *, 0 AS block, 'rack1' AS key, [NULL, NULL, v::VARCHAR, NULL] AS vals,
               '4' AS mean, NULL AS best_node, NULL AS lowest_node FROM polls WHERE shape = 0
        UNION ALL SELECT *, 1, 'rack2', [(v + 2)::VARCHAR, NULL, v::VARCHAR, (v + 1)::VARCHAR],
               (v + 1)::VARCHAR, 'top' || j, 'low' || j FROM polls WHERE shape = 0
        UNION ALL SELECT *, 0, 'zone', [NULL, NULL, (v + 1)::VARCHAR, v::VARCHAR],
               '7.25', NULL, NULL FROM polls WHERE shape = 1
        UNION ALL SELECT *, 1, 'area', [v::VARCHAR, (v + 2)::VARCHAR, NULL, NULL],
               NULL, 'q', NULL FROM polls WHERE shape = 1
        UNION ALL SELECT *, 0, 'fan', [NULL, (v + 3)::VARCHAR, 'stalled', v::VARCHAR],
               'none yet', 'top' || j, NULL FROM polls WHERE shape = 2
        UNION ALL SELECT *, 0, 'probe', [(v + 1)::VARCHAR, v::VARCHAR],
               NULL, NULL, NULL FROM polls WHERE shape = 5
    ),
    picked AS (
        SELECT * FROM blocks
        QUALIFY row_number() OVER (
            PARTITION BY poll_id ORDER BY len(list_filter(vals, lambda x: x IS NOT NULL)) DESC, block
        ) = 1
    ),
    points AS (
        SELECT job_id, metric, poll_id, i - 1 AS position, CAST(g + 300 * (i - 1) AS DOUBLE) AS ts,
               TRY_CAST(vals[i] AS DOUBLE) AS value
        FROM picked, range(1, 5) AS r(i)
        WHERE i <= len(vals) AND TRY_CAST(vals[i] AS DOUBLE) IS NOT NULL
    )
"""


def _polls(spark, sf_dir):
    return landing.timeline_polls(fixtures.timeline_polls(spark, sf_dir))


@query("timeline_blocks", f"""
    WITH {BLOCKS_SQL}
    SELECT job_id, metric, poll_id, endpoint, CAST(block AS BIGINT) AS block, key,
           CAST(len(vals) AS BIGINT) AS points,
           CAST(len(list_filter(vals, lambda x: x IS NOT NULL)) AS BIGINT) AS known, mean
    FROM blocks
""")
def timeline_blocks(spark, sf_dir):
    blocks = ops.timeline_blocks(_polls(spark, sf_dir), [*POLL, "endpoint"])
    return blocks.select(
        *POLL, "endpoint", F.col("block").cast("bigint").alias("block"), "key",
        F.size("values").cast("bigint").alias("points"),
        F.size(F.filter("values", lambda v: v.isNotNull())).cast("bigint").alias("known"),
        F.get_json_object("meta", "$.mean").alias("mean"),
    )


@query("timeline_densest", f"""
    WITH {BLOCKS_SQL}
    SELECT p.poll_id, k.key, CAST(CASE WHEN p.shape = 3 THEN 2 ELSE 4 END AS BIGINT) AS timestamps,
           CAST(coalesce(len(k.vals), 0) AS BIGINT) AS points
    FROM polls p LEFT JOIN picked k USING (poll_id) WHERE p.shape <> 4
""")
def timeline_densest(spark, sf_dir):
    return ops.densest_block(_polls(spark, sf_dir), ["poll_id"]).select(
        "poll_id", "key", F.size("timestamps").cast("bigint").alias("timestamps"),
        F.size("values").cast("bigint").alias("points"),
    )


@query("timeline_points", f"""
    WITH {BLOCKS_SQL}
    SELECT job_id, metric, poll_id, CAST(position AS BIGINT) AS position, ts, value FROM points
""")
def timeline_points(spark, sf_dir):
    points = ops.timeline_points(_polls(spark, sf_dir), POLL)
    return points.withColumn("position", F.col("position").cast("bigint"))


META_SQL = f"""
    WITH {BLOCKS_SQL}, metas AS (
        SELECT p.job_id, p.metric, p.poll_id,
               CASE WHEN p.shape IN (0, 1) THEN 'kW' WHEN p.shape <> 5 THEN 'rpm' END AS unit,
               TRY_CAST(k.mean AS DOUBLE) AS mean, k.best_node, k.lowest_node, k.key AS data_key
        FROM polls p LEFT JOIN picked k USING (poll_id)
    )
"""


@query("timeline_meta", META_SQL + "SELECT * FROM metas")
def timeline_meta(spark, sf_dir):
    return ops.timeline_meta(_polls(spark, sf_dir), POLL)


@query("timeline_meta_merge", META_SQL + """
    SELECT job_id, metric,
           max_by(unit, poll_id) FILTER (WHERE unit IS NOT NULL) AS unit,
           max_by(mean, poll_id) FILTER (WHERE mean IS NOT NULL) AS mean,
           max_by(best_node, poll_id) FILTER (WHERE best_node IS NOT NULL) AS best_node,
           max_by(lowest_node, poll_id) FILTER (WHERE lowest_node IS NOT NULL) AS lowest_node,
           max_by(data_key, poll_id) FILTER (WHERE data_key IS NOT NULL) AS data_key
    FROM metas GROUP BY job_id, metric
""")
def timeline_meta_merge(spark, sf_dir):
    return ops.merge_meta(ops.timeline_meta(_polls(spark, sf_dir), POLL), SERIES)


MERGED_SQL = f"""
    WITH {BLOCKS_SQL}, merged AS (
        SELECT * FROM (
            SELECT * FROM points
            QUALIFY row_number() OVER (PARTITION BY job_id, metric, ts ORDER BY poll_id, position) = 1
        )
        QUALIFY row_number() OVER (PARTITION BY job_id, metric ORDER BY ts DESC) <= 500
    )
"""


@query("timeline_merge", MERGED_SQL + "SELECT job_id, metric, ts, value FROM merged")
def timeline_merge(spark, sf_dir):
    points = ops.timeline_points(_polls(spark, sf_dir), POLL)
    return ops.merge_points(points, SERIES).drop("age")


@query("timeline_stats", MERGED_SQL + """
    SELECT job_id, metric, CAST(count(*) AS BIGINT) AS samples,
           CAST(sum(CAST(value AS BIGINT)) AS DOUBLE) / count(*) AS mean, max(value) AS max, min(value) AS min
    FROM merged GROUP BY job_id, metric
""")
def timeline_stats(spark, sf_dir):
    # The values are whole numbers, so their sum is exact in any order.
    points = ops.timeline_points(_polls(spark, sf_dir), POLL)
    return history.series_stats(ops.merge_points(points, SERIES), SERIES)


@query("timeline_monitor", META_SQL.rstrip() + """, ranked AS (
        SELECT * FROM points
        QUALIFY row_number() OVER (PARTITION BY job_id, metric, ts ORDER BY poll_id, position) = 1
    ), shown AS (
        SELECT * FROM ranked
        QUALIFY row_number() OVER (PARTITION BY job_id, metric ORDER BY ts DESC) <= 500
    ), latest AS (
        SELECT job_id, metric, max_by(unit, poll_id) FILTER (WHERE unit IS NOT NULL) AS unit,
               max_by(data_key, poll_id) FILTER (WHERE data_key IS NOT NULL) AS data_key
        FROM metas GROUP BY job_id, metric
    )
    SELECT job_id, metric, ts, value, unit, data_key,
           CAST(sum(CAST(value AS BIGINT)) OVER w AS DOUBLE) / count(*) OVER w AS mean,
           max(value) OVER w AS max, min(value) OVER w AS min
    FROM shown JOIN latest USING (job_id, metric) WINDOW w AS (PARTITION BY job_id, metric)
""")
def timeline_monitor(spark, sf_dir):
    """Merged points, each with the latest metadata and the statistics of its series."""
    polls = _polls(spark, sf_dir)
    points = ops.merge_points(ops.timeline_points(polls, POLL), SERIES).drop("age")
    latest = ops.merge_meta(ops.timeline_meta(polls, POLL), SERIES)
    shown = history.overlay(points, SERIES)
    return shown.join(latest.select(*SERIES, "unit", "data_key"), SERIES)


@query("epoch_to_hms", f"""
    WITH {BLOCKS_SQL}
    SELECT poll_id, ts, strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), '%H:%M:%S') AS display_time
    FROM points
""")
def epoch_to_hms(spark, sf_dir):
    points = ops.timeline_points(_polls(spark, sf_dir), POLL)
    return points.select("poll_id", "ts", units.epoch_to_hms(F.col("ts")).alias("display_time"))


# Metric keys of the catalog for the event types; one type has none.
KEYS = {"click": "cpu_usage", "view": "mem_used", "purchase": "gpu_mem", "signup": "horse_read_bw"}

CATALOG_SQL = f"""
    WITH {SAMPLES_SQL}, catalog(kind, metric, label) AS (VALUES
        ('click', 'cpu_usage', 'CPU Usage'), ('view', 'mem_used', 'Memory Used'),
        ('purchase', 'gpu_mem', 'GPU Memory'), ('signup', 'horse_read_bw', 'FS Horse Read BW'),
        ('error', 'error', 'error')
    ), labelled AS (
        SELECT sample_id, c.metric, label FROM samples s JOIN catalog c ON s.metric = c.kind
    )
"""


def _keyed(spark, sf_dir):
    kinds = " ".join(f"WHEN '{kind}' THEN '{key}'" for kind, key in KEYS.items())
    return fixtures.samples(spark, sf_dir).select(
        "sample_id", F.expr(f"CASE metric {kinds} ELSE metric END").alias("metric")
    )


@query("metric_label", CATALOG_SQL + "SELECT * FROM labelled")
def metric_label(spark, sf_dir):
    return catalog.with_labels(_keyed(spark, sf_dir), "timeline")


@query("metric_search", CATALOG_SQL + """
    SELECT * FROM labelled WHERE contains(lower(metric), 'mem') OR contains(lower(label), 'mem')
""")
def metric_search(spark, sf_dir):
    return catalog.search_metrics(_keyed(spark, sf_dir), "timeline", "MEM")


@query("job_detail_normalise", """
    SELECT o_orderkey AS poll_id,
           CASE WHEN o_orderkey % 8 IN (0, 1) THEN 'j' || o_custkey END AS job_name,
           CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey % 4 AS VARCHAR)
                WHEN 6 THEN CAST(o_custkey AS VARCHAR) END AS nodes,
           CAST(CASE o_orderkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS BIGINT) AS members
    FROM orders
""")
def job_detail_normalise(spark, sf_dir):
    details = landing.job_details(fixtures.job_detail_polls(spark, sf_dir), ["poll_id"])
    return details.select(
        "poll_id", F.col("detail")["job_name"].alias("job_name"), F.col("detail")["nodes"].alias("nodes"),
        F.size("detail").cast("bigint").alias("members"),
    )
