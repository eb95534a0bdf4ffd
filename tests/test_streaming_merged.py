"""Folders that stay small, whatever is repeated or breaks off."""

import os

import pytest
from pyspark.sql import functions as F

from fleetgauge.session import new_folder
from fleetgauge.streaming.merged import MergedFolder
from fleetgauge.streaming.snapshots import marked, merged_rows


def sums(rows):
    return rows.groupBy("key").agg(F.sum("value").alias("value"))


def batch(spark, batch_id):
    return spark.range(4).select(
        (F.col("id") * batch_id % 3).alias("key"), F.lit(2**batch_id).cast("bigint").alias("value")
    ).coalesce(1)


def want(n):
    out = {}
    for batch_id in range(n):
        for i in range(4):
            key = i * batch_id % 3
            out[key] = out.get(key, 0) + 2**batch_id
    return out


def values(folder):
    return {r.key: r.value for r in folder.read().collect()}


def segments_on_disk(path):
    at = f"{path.removeprefix('file://')}/segments"
    return sorted(os.listdir(at)) if os.path.exists(at) else []


def test_segments_stay_few(spark):
    path = new_folder(spark, "merged")
    folder, most = MergedFolder(spark, path, sums, fanout=3), 0
    for batch_id in range(40):
        folder.add(batch(spark, batch_id), batch_id)
        most = max(most, len(folder.current()["segments"]))
    assert most <= 2 * 4  # two per level, and log 40 to base 3 is under 4
    assert len(segments_on_disk(path)) <= most + 2 * (3 + 1)  # and what two manifests still name
    assert values(folder) == want(40)
    last = [s["last"] for s in folder.current()["segments"]]
    assert max(last) == 39 and sum(s["last"] - s["first"] + 1 for s in folder.current()["segments"]) == 40


def test_repeated_batches_count_once(spark):
    folder = MergedFolder(spark, new_folder(spark, "merged"), sums, fanout=2)
    for batch_id in (0, 0, 1, 1, 2, 1, 2, 0):
        folder.add(batch(spark, batch_id), batch_id)
    assert values(folder) == want(3)


class Broken(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["_write", "_publish", "_forget"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_broken_off_steps_lose_and_double_nothing(spark, monkeypatch, step, when):
    """Every call of each step breaks off once, before or after what it does."""
    path, calls = new_folder(spark, "merged"), set()
    real = getattr(MergedFolder, step)

    def breaking(self, *args):
        at = str(args[1:]) if step == "_write" else str(args[0])
        if at in calls:
            return real(self, *args)
        calls.add(at)
        if when == "after":
            real(self, *args)
        raise Broken(at)

    monkeypatch.setattr(MergedFolder, step, breaking)
    for batch_id in range(5):
        for _ in range(12):
            try:
                MergedFolder(spark, path, sums, fanout=2).add(batch(spark, batch_id), batch_id)
                break
            except Broken:
                continue
    monkeypatch.undo()
    assert len(calls) >= 5
    assert values(MergedFolder(spark, path, sums, fanout=2)) == want(5)


def test_a_reader_keeps_its_manifest(spark):
    folder = MergedFolder(spark, new_folder(spark, "merged"), sums, fanout=2, kept=3)
    folder.add(batch(spark, 0), 0)
    before = folder.read()
    folder.add(batch(spark, 1), 1)  # merges, two more manifests
    assert {r.key: r.value for r in before.collect()} == want(1)


def test_two_writers_do_not_overwrite_each_other(spark):
    path = new_folder(spark, "merged")
    folder = MergedFolder(spark, path, sums)
    folder.add(batch(spark, 0), 0)
    seen = folder.current()
    folder._publish(seen)
    with pytest.raises(RuntimeError):
        folder._publish(seen)


def test_newest_row_of_each_key(spark):
    folder = merged_rows(spark, new_folder(spark, "merged"), ["key"])
    for batch_id in range(6):
        rows = spark.createDataFrame([(k, f"{k}-{batch_id}") for k in range(batch_id % 3 + 1)], "key long, value string")
        folder.add(marked(rows, batch_id), batch_id)
    assert sorted((r.key, r.value) for r in folder.read().collect()) == [(0, "0-5"), (1, "1-5"), (2, "2-5")]


def test_nothing_written_and_wrong_sizes(spark):
    with pytest.raises(FileNotFoundError):
        MergedFolder(spark, new_folder(spark, "merged"), sums).read()
    with pytest.raises(ValueError):
        MergedFolder(spark, "x", sums, fanout=1)
