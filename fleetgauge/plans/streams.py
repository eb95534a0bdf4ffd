"""Streaming queries: process all landed files, then return what was written.

The given tables are landed as several files, one to a micro-batch, so that every
stream spans batches.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fleetgauge.operators import liveness as liveness_ops
from fleetgauge.operators.history import last_n
from fleetgauge.operators.snapshots import complete_polls, spark_parts
from fleetgauge.plans.history import ENTITY, HISTORY_SQL
from fleetgauge.plans.registry import query
from fleetgauge.plans.snapshots import APP, SPARK_SNAPSHOT_SQL
from fleetgauge.plans.timelines import BLOCKS_SQL, META_SQL, SERIES
from fleetgauge.session import new_folder
from fleetgauge.sources import fixtures, landing
from fleetgauge.sources.tables import table
from fleetgauge.streaming import history, liveness, push, selection, snapshots, timelines
from fleetgauge.streaming.ingest import run_available, stream_files

# Micro-batches that each table arrives in, and the rows that a landed file may hold about.
BATCHES, FILE_ROWS = 4, 100_000


def landed(spark, sf_dir, name):
    """A table as a stream of files, dealt to them by a hash of its rows.

    The files grow in number with the table, not in size, so that each is written and read
    by a task of its own; a micro-batch takes its share of them.
    """
    rows = table(spark, sf_dir, name)
    folder = new_folder(spark, f"landed-{name}")
    share = max(1, math.ceil(rows.count() / (BATCHES * FILE_ROWS)))
    rows.repartition(BATCHES * share, F.xxhash64(*rows.columns)).write.parquet(folder)
    return stream_files(spark, folder, rows.schema, files_per_batch=share)


def _events(spark, sf_dir):
    return landed(spark, sf_dir, "events")


def _columns(recent):
    return recent.select(
        "entity_id", "sample_id", "ts_us", "value", F.col("age").cast("bigint").alias("age")
    )


@query("stream_history_sink", HISTORY_SQL)
def stream_history_sink(spark, sf_dir):
    sink = history.merged_history(spark, new_folder(spark, "history"), ENTITY)
    samples = fixtures.samples_of(_events(spark, sf_dir))
    run_available(spark, samples.writeStream.foreachBatch(
        lambda batch, batch_id: sink.add(history.newest_samples(batch, ENTITY), batch_id)
    ))
    return _columns(last_n(sink.read(), ENTITY, history.ORDER))


@query("stream_last_n", HISTORY_SQL)
def stream_last_n(spark, sf_dir):
    sink = history.merged_history(spark, new_folder(spark, "rings"), ENTITY)
    rings = history.stream_last_n(fixtures.samples_of(_events(spark, sf_dir)), ENTITY)
    run_available(spark, rings.drop("part").writeStream.outputMode("update").foreachBatch(sink.add))
    return _columns(last_n(sink.read(), ENTITY, history.ORDER))


def _polls(spark, sf_dir):
    return landing.timeline_polls(fixtures.timeline_polls_of(_events(spark, sf_dir)))


@query("stream_dedup_points", f"""
    WITH {BLOCKS_SQL}
    SELECT job_id, metric, ts, value FROM points
    QUALIFY row_number() OVER (PARTITION BY job_id, metric, ts ORDER BY poll_id, position) = 1
""")
def stream_dedup_points(spark, sf_dir):
    sink = timelines.merged_points(spark, new_folder(spark, "points"), SERIES)
    run_available(spark, _polls(spark, sf_dir).writeStream.foreachBatch(
        lambda batch, batch_id: sink.add(timelines.batch_points(batch, SERIES), batch_id)
    ))
    return sink.read().drop("seen")


@query("stream_latest_meta", META_SQL + """
    SELECT job_id, metric,
           max_by(unit, poll_id) FILTER (WHERE unit IS NOT NULL) AS unit,
           max_by(mean, poll_id) FILTER (WHERE mean IS NOT NULL) AS mean,
           max_by(best_node, poll_id) FILTER (WHERE best_node IS NOT NULL) AS best_node,
           max_by(lowest_node, poll_id) FILTER (WHERE lowest_node IS NOT NULL) AS lowest_node,
           max_by(data_key, poll_id) FILTER (WHERE data_key IS NOT NULL) AS data_key
    FROM metas GROUP BY job_id, metric
""")
def stream_latest_meta(spark, sf_dir):
    sink = snapshots.merged_rows(spark, new_folder(spark, "meta"), SERIES)
    latest = timelines.latest_meta(_polls(spark, sf_dir), SERIES)
    run_available(spark, latest.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: sink.add(snapshots.marked(batch, batch_id), batch_id)
    ))
    return sink.read().drop("batch_id")


@query("stream_spark_snapshot", SPARK_SNAPSHOT_SQL + "SELECT * EXCLUDE (no) FROM snapshot")
def stream_spark_snapshot(spark, sf_dir):
    sink = snapshots.merged_snapshots(spark, new_folder(spark, "snapshots"), APP)
    raw = fixtures.spark_raw_polls(spark, sf_dir, read=landed)
    run_available(spark, raw.writeStream.foreachBatch(
        lambda batch, batch_id: sink.add(spark_parts(batch, APP), batch_id)
    ))
    return complete_polls(sink.read(), APP)


# ------------------------------------------- rows that land out of their order

# Files that rows land in, by their time and up to JITTER seconds later; the watermark
# waits DELAY. Of SOME rows one lands in the last file, behind the watermark or not.
FILES, SOME = 4, 97


def landed_late(spark, rows, number, jitter):
    """Rows (with ``seconds``) as a stream of files in order, then one row far ahead.

    Each of the ``FILES`` is a share of files of about ``FILE_ROWS`` rows, and a micro-batch
    of its own. The last row moves the watermark past all others; its key is null throughout.
    """
    first, end, count = rows.agg(F.min("seconds"), F.max("seconds"), F.count(F.lit(1))).first()
    first, end = first or 0, end or 0
    folder = new_folder(spark, "landed-late")
    arrival = F.col("seconds") + F.pmod(F.col(number) * 7919, F.lit(jitter))
    file = F.floor((arrival - first) * FILES / F.lit(end - first + jitter))
    file = F.when(F.col(number) % SOME == 5, FILES - 1).otherwise(file)
    placed = rows.withColumn("_file", file)
    share = max(1, math.ceil(count / (FILES * FILE_ROWS)))
    nobody = [F.lit(None).cast(field.dataType).alias(field.name) for field in rows.schema]
    slot = F.pmod(F.xxhash64("seconds", number), F.lit(share)).cast("int").alias("_slot")
    for part in range(FILES):
        # A row without a time, which has no place in the order, lets no file be missing.
        some = placed.filter(F.col("_file") == part).select(*rows.columns, slot)
        every = some.unionByName(spark.range(share).select(*nobody, F.col("id").cast("int").alias("_slot")))
        every.repartitionById(share, "_slot").drop("_slot").write.mode("append").parquet(folder)
    ahead = [F.lit(end + 10**9).cast("bigint").alias("seconds") if c == "seconds"
             else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    spark.range(1).select(*ahead).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_files(spark, folder, rows.schema, files_per_batch=share)
    return stream.withColumn("ts", F.timestamp_seconds("seconds"))


def late_sql(number: str, seconds: str, jitter: int, delay: int) -> str:
    """CTEs from ``rows`` to ``timed``: with the file of each row and whether it came too late."""
    return f"""
    placed AS (
        SELECT *, CASE WHEN {number} % {SOME} = 5 THEN {FILES - 1} ELSE CAST(floor(
            ({seconds} + ({number} * 7919) % {jitter} - least) * {FILES} / (most - least + {jitter})) AS BIGINT)
            END AS file
        FROM rows, (SELECT min({seconds}) AS least, max({seconds}) AS most FROM rows)
    ), seen AS (
        SELECT f.file, (SELECT max({seconds}) FROM placed p WHERE p.file < f.file) - {delay} AS mark
        FROM (SELECT DISTINCT file FROM placed) f
    ), timed AS (
        SELECT placed.*, coalesce({seconds} <= mark, false) AS late FROM placed JOIN seen USING (file)
    )
    """


STICKY_JITTER, STICKY_DELAY = 200, 250


@query("stream_sticky_entity", f"""
    WITH rows AS (
        SELECT o_orderpriority AS cluster_id, o_orderkey AS poll_id, o_orderkey AS seconds,
               o_orderstatus <> 'P' AS ok,
               CASE WHEN o_custkey % 3 <> 0 THEN 'app-' || o_custkey END AS candidate
        FROM orders
    ), {late_sql("poll_id", "seconds", STICKY_JITTER, STICKY_DELAY)}, eras AS (
        SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (
            PARTITION BY cluster_id ORDER BY poll_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era
        FROM timed WHERE NOT late
    ), chosen AS (
        SELECT *, first_value(candidate IGNORE NULLS) OVER (
            PARTITION BY cluster_id, era ORDER BY poll_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entity_id
        FROM eras
    )
    SELECT cluster_id, poll_id, entity_id, false AS late FROM chosen
    WHERE ok AND entity_id IS NOT NULL
    UNION ALL SELECT cluster_id, poll_id, NULL, true FROM timed WHERE late
""")
def stream_sticky_entity(spark, sf_dir):
    polls = fixtures.poll_outcomes(spark, sf_dir).withColumn(
        "seconds", F.col("poll_id") + fixtures.EPOCH
    )
    told = selection.stream_sticky_entity(
        landed_late(spark, polls, "poll_id", STICKY_JITTER), ["cluster_id"], "poll_id", "ts",
        f"{STICKY_DELAY} seconds",
    )
    folder = new_folder(spark, "sticky")
    run_available(spark, told.writeStream.foreachBatch(history.batch_sink(folder)))
    return history.read_batches(spark, folder).drop("batch_id").filter("cluster_id IS NOT NULL")


UP_JITTER, UP_DELAY, INTERVAL, FORGET = 6 * 3600, 7 * 3600, 9 * 3600, 20 * 3600


@query("stream_cluster_up", f"""
    WITH rows AS (
        SELECT 'u' || user_id AS cluster_id, event_id AS number,
               CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds,
               event_id % 5 <> 3 AND event_id % 7 <> 2 AND event_id % 4 <> 1 AS up
        FROM events
    ), {late_sql("number", "seconds", UP_JITTER, UP_DELAY)}, gaps AS (
        SELECT *, lead(seconds) OVER (PARTITION BY cluster_id ORDER BY seconds, number) AS next
        FROM timed WHERE NOT late
    )
    SELECT cluster_id, seconds AS at, number, up, 'reported' AS reason FROM gaps
    UNION ALL SELECT cluster_id, seconds + {INTERVAL}, NULL, false, 'silent' FROM gaps
    WHERE next IS NULL OR next - seconds > {INTERVAL}
    UNION ALL SELECT cluster_id, seconds, number, NULL, 'late' FROM timed WHERE late
""")
def stream_cluster_up(spark, sf_dir):
    reports = fixtures.cluster_reports(spark, sf_dir)
    stream = landed_late(spark, reports, "number", UP_JITTER)
    up = liveness_ops.report_up("framework", "expected", "payload", "ok", "master_found")
    told = liveness.stream_cluster_up(
        stream.withColumn("up", up), ["cluster_id"], "number", "ts", f"{UP_DELAY} seconds",
        INTERVAL, FORGET,
    )
    folder = new_folder(spark, "liveness")
    run_available(spark, told.writeStream.foreachBatch(history.batch_sink(folder)))
    return history.read_batches(spark, folder).filter("cluster_id IS NOT NULL").select(
        "cluster_id", F.unix_seconds("ts").alias("at"), "number", "up", "reason"
    )


@query("stream_push", """
    SELECT 'u' || user_id AS entity_id, event_type AS metric, epoch_us(ts) AS ts_us,
           event_id AS sample_id, CAST(round(value, 2) AS DOUBLE) AS value
    FROM events WHERE value > 20
""")
def stream_push(spark, sf_dir):
    push.register(spark)
    folder = new_folder(spark, "mailbox")
    samples = fixtures.samples_of(_events(spark, sf_dir)).filter("value > 20").select(
        "entity_id", "metric", F.unix_micros("ts").alias("ts_us"), "sample_id",
        F.col("value").cast("double").alias("value"),
    )
    run_available(spark, samples.writeStream.format(push.NAME).option("path", folder))
    return push.delivered(spark, folder, samples.schema).drop("batch")
