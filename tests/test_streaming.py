"""Streams give what the batch operators give, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.constants import POLL_INTERVALS
from fleetgauge.operators import history, timelines
from fleetgauge.operators.snapshots import spark_snapshot
from fleetgauge.plans import streams
from fleetgauge.session import new_folder
from fleetgauge.sources import fixtures
from fleetgauge.sources.tables import table
from fleetgauge.streaming import history as stream_history
from fleetgauge.streaming import snapshots as stream_snapshots
from fleetgauge.streaming import timelines as stream_timelines
from fleetgauge.streaming.ingest import poll_interval, run_available, stream_files, trigger

SF_DIR = "/root/testdata/sf0.001"
KEYS = ["entity_id"]
SERIES = ["job_id", "metric"]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The events in four files, in time order."""
    folder = str(tmp_path_factory.mktemp("landed") / "events")
    events = table(spark, SF_DIR, "events")
    for part in range(4):
        chosen = events.filter(F.floor(F.col("event_id") / 250) == part)
        chosen.coalesce(1).write.mode("append").parquet(folder)
    return folder


def events(spark, landed):
    schema = table(spark, SF_DIR, "events").schema
    return stream_files(spark, landed, schema, files_per_batch=1)


def ids(df):
    return sorted((r["entity_id"], r["sample_id"]) for r in df.collect())


def batch_ids(spark, n):
    samples = fixtures.samples(spark, SF_DIR)
    return ids(history.last_n(samples, KEYS, ["ts", "sample_id"], n))


def test_ring_state_equals_batch(spark, landed):
    folder = new_folder(spark, "rings")
    rings = stream_history.stream_last_n(fixtures.samples_of(events(spark, landed)), KEYS, n=7, parts=3)
    run_available(spark, rings.writeStream.outputMode("update").foreachBatch(stream_history.batch_sink(folder)))
    written = stream_history.read_batches(spark, folder)
    assert written.select("batch_id").distinct().count() == 4
    assert ids(stream_history.merge_rings(written, KEYS, n=7)) == batch_ids(spark, 7)


def test_history_sink_equals_batch_before_and_after_compaction(spark, landed):
    folder, base = new_folder(spark, "history"), new_folder(spark, "base")
    samples = fixtures.samples_of(events(spark, landed))
    run_available(spark, samples.writeStream.foreachBatch(stream_history.history_sink(folder, KEYS, n=7)))
    want = batch_ids(spark, 7)
    assert ids(stream_history.read_history(spark, folder, KEYS, n=7)) == want
    stream_history.compact_history(spark, folder, base, KEYS, through=2, n=7)
    assert ids(stream_history.read_history(spark, folder, KEYS, n=7, base=base, after=2)) == want


def test_repeated_batch_replaces_itself(spark):
    folder = new_folder(spark, "repeat")
    sink = stream_history.history_sink(folder, KEYS, n=7)
    samples = fixtures.samples(spark, SF_DIR)
    for batch_id in (0, 1, 1):
        sink(samples.filter(F.col("sample_id") % 2 == batch_id), batch_id)
    assert ids(stream_history.read_history(spark, folder, KEYS, n=7)) == batch_ids(spark, 7)


def newest_first(spark, tmp_path, df, by, parts=4):
    """The rows in files by ``by``, the last ones landing first."""
    folder = str(tmp_path / "landed")
    bounds = df.selectExpr(f"min({by}) AS low", f"max({by}) AS high").first()
    step = (bounds.high - bounds.low) // parts + 1
    for part in reversed(range(parts)):
        low = bounds.low + part * step
        chosen = df.filter((F.col(by) >= low) & (F.col(by) < low + step))
        chosen.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_points_that_land_newest_first(spark, tmp_path):
    events = table(spark, SF_DIR, "events")
    folder, out = newest_first(spark, tmp_path, events, "event_id"), new_folder(spark, "points")
    stream = stream_files(spark, folder, events.schema, files_per_batch=1)
    run_available(
        spark,
        fixtures.timeline_polls_of(stream).writeStream.foreachBatch(
            stream_timelines.points_sink(out, SERIES)
        ),
    )
    assert stream_history.read_batches(spark, out).select("batch_id").distinct().count() == 4
    got = stream_timelines.read_points(spark, out, SERIES)
    batch = timelines.timeline_points(fixtures.timeline_polls(spark, SF_DIR), [*SERIES, "poll_id"])
    want = timelines.merge_points(batch, SERIES, keep=None)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_latest_meta_equals_batch(spark, landed):
    folder = new_folder(spark, "meta")
    latest = stream_timelines.latest_meta(fixtures.timeline_polls_of(events(spark, landed)), SERIES)
    run_available(
        spark, latest.writeStream.outputMode("update").foreachBatch(stream_history.batch_sink(folder))
    )
    batches = stream_history.read_batches(spark, folder)
    assert batches.select("batch_id").distinct().count() == 4
    metas = timelines.timeline_meta(fixtures.timeline_polls(spark, SF_DIR), [*SERIES, "poll_id"])
    want = timelines.merge_meta(metas, SERIES)
    got = stream_snapshots.newest_rows(batches, SERIES).select(*want.columns)
    key = [*SERIES]
    assert got.orderBy(*key).collect() == want.orderBy(*key).collect()


def test_snapshots_of_polls_that_arrive_in_parts(spark, tmp_path):
    """One endpoint per micro-batch at its own time, one poll's last page coming late."""
    keys = ["entity_id", "poll_id"]
    raw = fixtures.spark_raw_polls(spark, SF_DIR)
    late = (F.col("endpoint") == "jobs") & (F.col("page") % 10 == 3)
    folder, out = str(tmp_path / "raw"), new_folder(spark, "snapshots")
    parts = (
        raw.filter(late), raw.filter("endpoint = 'executors'"), raw.filter("endpoint = 'stages'"),
        raw.filter((F.col("endpoint") == "jobs") & ~late),
    )
    for days, part in enumerate(parts):
        moved = part.withColumn("poll_ts", F.col("poll_ts") - F.expr(f"INTERVAL {days} DAYS"))
        moved.coalesce(1).write.mode("append").parquet(folder)
    stream = stream_files(spark, folder, raw.schema, files_per_batch=1)
    run_available(spark, stream.writeStream.foreachBatch(stream_snapshots.snapshot_sink(out, keys)))
    batches = stream_history.read_batches(spark, out)
    got = stream_snapshots.read_snapshots(spark, out, keys)
    want = spark_snapshot(raw, keys)
    assert batches.select("batch_id").distinct().count() == 4
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_registered_streams_span_batches(spark):
    stream = streams.landed(spark, SF_DIR, "events")
    out = new_folder(spark, "spans")
    run_available(spark, stream.writeStream.foreachBatch(stream_history.batch_sink(out)))
    written = stream_history.read_batches(spark, out)
    assert written.select("batch_id").distinct().count() == streams.BATCHES
    assert written.count() == table(spark, SF_DIR, "events").count()


def test_poll_intervals():
    for source, (default, low, high) in POLL_INTERVALS.items():
        assert poll_interval(source) == default
        assert poll_interval(source, 0) == low
        assert poll_interval(source, 1000) == high
    assert trigger("flink") == {"processingTime": "5.0 seconds"}
