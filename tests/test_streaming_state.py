"""Keyed state machines over polls that come shuffled, late, or not at all."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetgauge.plans import streams
from fleetgauge.session import new_folder
from fleetgauge.streaming.history import batch_sink, read_batches
from fleetgauge.streaming.ingest import run_available, stream_files
from fleetgauge.streaming.liveness import LATE, REPORTED, SILENT, stream_cluster_up
from fleetgauge.streaming.selection import Sticky, stream_sticky_entity
from test_selection import brute_force

START = 1_000_000
BEAT = "beat"  # a cluster of its own whose late times move the watermark


def streamed(spark, batches, schema, make):
    """What a stream gives that reads one file of rows after the other."""
    folder, out = new_folder(spark, "landed"), new_folder(spark, "told")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_files(spark, folder, schema, files_per_batch=1)
    stream = stream.withColumn("ts", F.timestamp_seconds(F.col("seconds") + START))
    run_available(spark, make(stream).writeStream.foreachBatch(batch_sink(out)))
    return read_batches(spark, out).filter(F.coalesce("cluster", F.lit("")) != BEAT)


POLLS = "cluster string, poll long, seconds long, candidate string, ok boolean"


@pytest.mark.parametrize("fallback", [None, "cluster"])
def test_sticky_choice_over_shuffled_polls(spark, fallback):
    """Polls up to 50 s apart from their place; some come far too late."""
    rng = random.Random(str(fallback))
    polls = {
        c: [(i, None if rng.random() < 0.6 else f"app-{i}", rng.random() < 0.8) for i in range(150)]
        for c in ("a", "b", None)
    }
    rows, late = [], set()
    for c, own in polls.items():
        for i, candidate, ok in own:
            arrival = i * 10 + rng.randrange(50)
            if i in (3, 40, 41) and c == "a":
                arrival = 10_000
                late.add((c, i))
            rows.append((arrival, (c, i, i * 10, candidate, ok)))
    rows.sort(key=lambda r: r[0])
    batches = [[r for at, r in rows if 300 * b <= at < 300 * (b + 1)] for b in range(5)]
    batches += [[r for at, r in rows if at >= 1500], [(BEAT, 0, 100_000, None, True)]]
    told = streamed(
        spark, [b for b in batches if b], POLLS,
        lambda s: stream_sticky_entity(s, ["cluster"], "poll", "ts", "60 seconds", fallback=fallback),
    ).collect()
    want = {
        (c, poll): entity for c, own in polls.items()
        for poll, entity in brute_force([p for p in own if (c, p[0]) not in late], fallback).items()
    }
    assert {(r.cluster, r.poll) for r in told if r.late} == late
    timely = [r for r in told if not r.late]
    assert {(r.cluster, r.poll): r.entity_id for r in timely} == want and len(timely) == len(want)


def test_failed_and_unknown_outcomes_end_the_choice(spark):
    polls = [("a", i, i, c, ok) for i, (c, ok) in enumerate(
        [("x", True), ("y", True), ("z", None), ("w", True), (None, False), (None, True), ("v", True)])]
    told = streamed(
        spark, [polls[::-1], [(BEAT, 0, 999, None, True)]], POLLS,
        lambda s: stream_sticky_entity(s, ["cluster"], "poll", "ts", "0 seconds"),
    ).collect()
    assert sorted((r.poll, r.entity_id) for r in told) == [(0, "x"), (1, "x"), (3, "w"), (6, "v")]


REPORTS = "cluster string, number long, seconds long, up boolean"


def silences(times, interval, end):
    """Moments at which a cluster with reports at these times has been silent for long."""
    return [t + interval for t, after in zip(times, [*times[1:], end + interval + 1])
            if after - t > interval and t + interval <= end]


def test_silent_clusters_turn_down(spark):
    """Equal to a batch with gaps; reports shuffled by up to 20 s, one far too late."""
    rng, rows, want = random.Random(7), [], set()
    for c in range(6):
        t, times = rng.randrange(60), []
        for _ in range(25):
            t += rng.choice([5, 10, 20, 31, 90, 400])
            times.append(t)
        for i, at in enumerate(times):
            up = rng.random() < 0.7
            rows.append((at + rng.randrange(20), (f"c{c}", i, at, up)))
            want.add((f"c{c}", at, i, up, REPORTED))
        want |= {(f"c{c}", at, None, False, SILENT) for at in silences(times, 30, 99_000)}
    rows.append((6_000, ("c0", 99, 1, True)))
    want.add(("c0", 1, 99, None, LATE))
    rows.sort(key=lambda r: r[0])
    edges = [0, 500, 1000, 2000, 6000, 9999]
    batches = [[r for at, r in rows if low <= at < high] for low, high in zip(edges, edges[1:])]
    told = streamed(
        spark, [*(b for b in batches if b), [(BEAT, 0, 99_000, True)]], REPORTS,
        lambda s: stream_cluster_up(s, ["cluster"], "number", "ts", "25 seconds", 30, 300),
    ).select("cluster", (F.unix_seconds("ts") - START).alias("at"), "number", "up", "reason").collect()
    assert sorted(map(tuple, told), key=str) == sorted(want, key=str)


def test_silence_is_told_while_the_cluster_stays_silent(spark):
    """By the timer alone, before any further report, and once."""
    batches = [[("a", 0, 0, True)], [(BEAT, 0, 100, True)], [(BEAT, 1, 200, True)],
               [("a", 1, 250, True)], [(BEAT, 2, 255, True)]]
    told = streamed(
        spark, batches, REPORTS,
        lambda s: stream_cluster_up(s, ["cluster"], "number", "ts", "0 seconds", 30, 10_000),
    ).select("batch_id", "cluster", (F.unix_seconds("ts") - START).alias("at"), "up", "reason").collect()
    assert [tuple(r)[1:] for r in sorted(told)] == [
        ("a", 0, True, REPORTED), ("a", 30, False, SILENT), ("a", 250, True, REPORTED)]
    silent = next(r for r in told if r.reason == SILENT)
    back = next(r for r in told if r["at"] == 250)
    assert silent.batch_id < back.batch_id


def test_an_interval_longer_than_memory_is_refused():
    with pytest.raises(ValueError):
        stream_cluster_up(None, ["cluster"], "number", "ts", "1 second", 30, 10)


class Calls:
    """Stands for the state that Spark keeps, and counts what is put into it."""

    def __init__(self):
        self.items, self.timers = {}, set()

    def getListState(self, name, schema):
        return State(self.items.setdefault(name, []))

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class State:
    def __init__(self, items):
        self.items = items

    def get(self):
        return iter(list(self.items)) if self.items and isinstance(self.items[0][0], bytes) else (
            self.items[0] if self.items else None)

    def exists(self):
        return bool(self.items)

    def appendList(self, some):
        self.items += some

    def put(self, some):
        self.items[:] = some

    def update(self, one):
        self.items[:] = [one]

    def clear(self):
        self.items.clear()


class Mark(int):
    def getCurrentWatermarkInMs(self):
        return int(self)


def test_rows_are_held_in_few_items_of_state():
    """Each item is a call to Spark, so a busy key must not make one of every row."""
    machine, calls = Sticky(["cluster"]), Calls()
    machine.init(calls)
    number = 25_000
    frame = pd.DataFrame({
        "cluster": "a", "ts": range(1, number + 1), "place": range(number),
        "candidate": [None, "x"] * (number // 2), "ok": True,
    })[::-1]
    assert list(machine.handleInputRows(("a",), iter([frame]), Mark(0))) == []
    assert len(calls.items["held"]) <= 3 and calls.timers == {1}
    for mark, want in ((10, 9), (number, number - 10)):
        told = pd.concat(machine.handleExpiredTimer(("a",), Mark(mark), None))
        assert len(told) == want and set(told["entity_id"]) == {"x"}
        assert list(told["place"]) == sorted(told["place"])
    assert calls.items["held"] == []


def batches_of(spark, stream):
    """The rows of each micro-batch of a stream, and the number of files they come from."""
    out = []
    run_available(spark, stream.withColumn("_file", F.input_file_name()).writeStream.foreachBatch(
        lambda batch, _: out.append(batch.collect())))
    return [(rows, len({r["_file"] for r in rows})) for rows in out]


def test_landed_tables_come_in_more_files_as_they_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    spark.range(1000).write.parquet(str(tmp_path / "events.parquet"))
    found = batches_of(spark, streams.landed(spark, str(tmp_path), "events"))
    assert [files for _, files in found] == [5] * streams.BATCHES
    assert sorted(r.id for rows, _ in found for r in rows) == list(range(1000))


def test_rows_landed_late_keep_their_micro_batch(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    rows = spark.range(1, 1001).select("id", F.col("id").alias("seconds"))
    found = batches_of(spark, streams.landed_late(spark, rows, "id", 3))
    assert [files for _, files in found] == [5] * streams.FILES + [1]
    last = streams.FILES - 1
    want = [set() for _ in range(streams.FILES)]
    for i in range(1, 1001):
        late = i % streams.SOME == 5
        want[last if late else (i + i * 7919 % 3 - 1) * streams.FILES // (999 + 3)].add(i)
    assert [{r.id for r in rows if r.id is not None} for rows, _ in found[:-1]] == want
