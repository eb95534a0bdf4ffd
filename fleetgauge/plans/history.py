"""History queries over the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import chunks
from fleetgauge.operators import history as ops
from fleetgauge.plans.registry import query
from fleetgauge.sources import fixtures

ENTITY = ["entity_id"]
SERIES = ["entity_id", "metric"]
ORDER = ["ts", "sample_id"]

# Chunks that all samples together are cut into; null for the session's partitions.
PIECES: int | None = None

SAMPLES_SQL = """
    samples AS (
        SELECT 'u' || user_id AS entity_id, event_type AS metric, ts,
               CAST(value AS DECIMAL(9,2)) AS value, event_id AS sample_id
        FROM events
    )
"""


def recent_sql(keys: str) -> str:
    return f"""
    WITH {SAMPLES_SQL}, recent AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, sample_id DESC) AS age
            FROM samples
        ) WHERE age <= 40
    )
    """


HISTORY_SQL = recent_sql("entity_id") + """
    SELECT entity_id, sample_id, epoch_us(ts) AS ts_us, CAST(value AS DOUBLE) AS value,
           CAST(age AS BIGINT) AS age
    FROM recent
"""


def history_columns(recent):
    return recent.select(
        "entity_id", "sample_id", F.unix_micros("ts").alias("ts_us"),
        F.col("value").cast("double").alias("value"), F.col("age").cast("bigint").alias("age"),
    )


@query("history_last_n", HISTORY_SQL)
def history_last_n(spark, sf_dir):
    return history_columns(ops.last_n(fixtures.samples(spark, sf_dir), ENTITY, ORDER))


@query("history_last_n_spread", HISTORY_SQL)
def history_last_n_spread(spark, sf_dir):
    samples = fixtures.samples(spark, sf_dir)
    return history_columns(ops.last_n(samples, ENTITY, ORDER, spread=8))


@query("history_padded", recent_sql("entity_id, metric") + """,
    sized AS (SELECT entity_id, metric, count(*) AS n FROM recent GROUP BY ALL)
    SELECT entity_id, metric, CAST(40 - age AS BIGINT) AS position, CAST(value AS DOUBLE) AS value
    FROM recent
    UNION ALL
    SELECT entity_id, metric, CAST(pad AS BIGINT), CAST(0 AS DOUBLE)
    FROM sized, unnest(range(40 - n)) AS pads(pad)
""")
def history_padded(spark, sf_dir):
    arrays = ops.history_arrays(fixtures.samples(spark, sf_dir), SERIES, ORDER)
    return arrays.select(
        *SERIES, F.posexplode("values").alias("position", "value")
    ).withColumn("position", F.col("position").cast("bigint"))


STATS_SQL = """
    CAST(count(*) AS BIGINT) AS samples, CAST(sum(value) AS DOUBLE) / count(*) AS mean,
    CAST(max(value) AS DOUBLE) AS max, CAST(min(value) AS DOUBLE) AS min
"""


@query("series_stats", recent_sql("entity_id") + f"""
    SELECT entity_id, {STATS_SQL} FROM recent GROUP BY entity_id
""")
def series_stats(spark, sf_dir):
    recent = ops.last_n(fixtures.samples(spark, sf_dir), ENTITY, ORDER)
    return ops.series_stats(recent, ENTITY)


@query("series_stats_padded", recent_sql("entity_id, metric") + """
    SELECT entity_id, metric, CAST(count(*) AS BIGINT) AS samples,
           CAST(sum(value) AS DOUBLE) / 40 AS mean,
           CAST(CASE WHEN count(*) < 40 THEN greatest(max(value), 0) ELSE max(value) END AS DOUBLE) AS max,
           CAST(CASE WHEN count(*) < 40 THEN least(min(value), 0) ELSE min(value) END AS DOUBLE) AS min
    FROM recent GROUP BY entity_id, metric
""")
def series_stats_padded(spark, sf_dir):
    recent = ops.last_n(fixtures.samples(spark, sf_dir), SERIES, ORDER)
    return ops.padded_stats(recent, SERIES)


@query("stat_overlay", recent_sql("entity_id, metric") + """
    SELECT entity_id, metric, sample_id, CAST(value AS DOUBLE) AS value,
           CAST(sum(value) OVER w AS DOUBLE) / count(*) OVER w AS mean,
           CAST(max(value) OVER w AS DOUBLE) AS max, CAST(min(value) OVER w AS DOUBLE) AS min
    FROM recent WINDOW w AS (PARTITION BY entity_id, metric)
""")
def stat_overlay(spark, sf_dir):
    recent = ops.last_n(fixtures.samples(spark, sf_dir), SERIES, ORDER)
    return ops.overlay(recent, SERIES).select(
        *SERIES, "sample_id", F.col("value").cast("double").alias("value"), "mean", "max", "min"
    )


def rolling_sql(count: str, high: str, low: str) -> str:
    return f"""
    WITH {SAMPLES_SQL}, rolled AS (
        SELECT entity_id, sample_id, count(*) OVER w AS n, sum(value) OVER w AS total,
               max(value) OVER w AS high, min(value) OVER w AS low
        FROM samples
        WINDOW w AS (PARTITION BY entity_id ORDER BY ts, sample_id
                     ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)
    )
    SELECT entity_id, sample_id, CAST(n AS BIGINT) AS samples, CAST(total AS DOUBLE) / {count} AS mean,
           CAST({high} AS DOUBLE) AS max, CAST({low} AS DOUBLE) AS min
    FROM rolled
    """


def _rolling(spark, sf_dir, padded):
    samples = fixtures.samples(spark, sf_dir)
    samples = chunks.with_chunks(samples, ENTITY, ORDER, PIECES)
    rolled = ops.rolling_stats(samples, ENTITY, ORDER, F.col("chunk"), padded=padded)
    return rolled.select("entity_id", "sample_id", "samples", "mean", "max", "min")


@query("rolling_stats", rolling_sql("n", "high", "low"))
def rolling_stats(spark, sf_dir):
    return _rolling(spark, sf_dir, padded=False)


@query("rolling_stats_padded", rolling_sql(
    "40",
    "CASE WHEN n < 40 THEN greatest(high, 0) ELSE high END",
    "CASE WHEN n < 40 THEN least(low, 0) ELSE low END",
))
def rolling_stats_padded(spark, sf_dir):
    return _rolling(spark, sf_dir, padded=True)
