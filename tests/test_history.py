"""Histories, their statistics, and windows over cut series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge.operators import history as ops
from fleetgauge.operators.chunks import with_chunks

SCHEMA = "entity string, at long, id long, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def naive(rows):
    """Samples per entity, oldest first."""
    by = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(row[0], []).append(row)
    return by


def random_rows(seed, entities=4, count=400, hot=0.5):
    rng = random.Random(seed)
    return [
        (
            "hot" if rng.random() < hot else f"e{rng.randrange(entities)}",
            rng.randrange(500),
            i,
            float(rng.randrange(-50, 50)),
        )
        for i in range(count)
    ]


def test_ring_keeps_the_newest_forty(spark):
    rows = [("a", i, i, float(i)) for i in range(45)]
    kept = ops.last_n(frame(spark, rows), ["entity"], ["at", "id"]).collect()
    assert sorted(r["value"] for r in kept) == [float(i) for i in range(5, 45)]
    assert {r["age"]: r["value"] for r in kept}[1] == 44.0


@pytest.mark.parametrize("spread", [1, 7])
def test_last_n_matches_brute_force(spark, spread):
    rows = random_rows(1)
    kept = ops.last_n(frame(spark, rows), ["entity"], ["at", "id"], n=9, spread=spread)
    want = {(e, r[2]) for e, rs in naive(rows).items() for r in rs[-9:]}
    assert {(r["entity"], r["id"]) for r in kept.collect()} == want


def test_padding_fills_the_old_end(spark):
    rows = [("a", 1, 1, 5.0), ("a", 2, 2, 7.0)]
    df = frame(spark, rows)
    padded = ops.history_arrays(df, ["entity"], ["at", "id"], n=5).first()["values"]
    assert padded == [0.0, 0.0, 0.0, 5.0, 7.0]
    plain = ops.history_arrays(df, ["entity"], ["at", "id"], n=5, padded=False)
    assert plain.first()["values"] == [5.0, 7.0]


def test_padded_stats_equal_stats_of_padded_arrays(spark):
    rows = random_rows(2, count=150)
    df = frame(spark, rows)
    recent = ops.last_n(df, ["entity"], ["at", "id"], n=40)
    stats = {r["entity"]: r for r in ops.padded_stats(recent, ["entity"], n=40).collect()}
    arrays = ops.history_arrays(df, ["entity"], ["at", "id"], n=40).collect()
    for row in arrays:
        values, got = row["values"], stats[row["entity"]]
        assert len(values) == 40
        assert got["mean"] == pytest.approx(sum(values) / 40)
        assert (got["max"], got["min"]) == (max(values), min(values))


def test_padded_equals_unpadded_once_full(spark):
    rows = [("a", i, i, float(i + 1)) for i in range(60)]
    recent = ops.last_n(frame(spark, rows), ["entity"], ["at", "id"])
    assert (
        ops.padded_stats(recent, ["entity"]).collect()
        == ops.series_stats(recent, ["entity"]).collect()
    )


def test_negative_series_shows_padding_zero(spark):
    recent = ops.last_n(frame(spark, [("a", 1, 1, -4.0)]), ["entity"], ["at", "id"])
    row = ops.padded_stats(recent, ["entity"]).first()
    assert (row["max"], row["min"], row["mean"]) == (0.0, -4.0, -0.1)


@pytest.mark.parametrize("width", [1, 3, 40, 1000])
@pytest.mark.parametrize("padded", [False, True])
def test_rolling_stats_do_not_depend_on_the_cut(spark, width, padded):
    """Chunks emptier than the window, and a key with half of all rows."""
    rows, n = random_rows(3), 6
    chunk = F.floor(F.col("at") / width)
    got = ops.rolling_stats(
        frame(spark, rows), ["entity"], ["at", "id"], chunk, n=n, padded=padded
    ).collect()
    want = {}
    for series in naive(rows).values():
        for i, row in enumerate(series):
            ring = [r[3] for r in series[max(0, i - n + 1): i + 1]]
            size = len(ring)
            if padded:
                ring = [0.0] * (n - len(ring)) + ring
            want[row[2]] = (size, pytest.approx(sum(ring) / len(ring)), max(ring), min(ring))
    assert {r["id"]: (r["samples"], r["mean"], r["max"], r["min"]) for r in got} == want
    assert len(got) == len(rows)


def test_a_burst_is_cut_as_evenly_as_the_rest(spark):
    """99 in 100 rows of a key at one moment, and rows without a time."""
    rows = [("hot", 500, i, 1.0) for i in range(9_900)] + [("hot", i, i, 1.0) for i in range(100)]
    rows += [("hot", None, -i, 1.0) for i in range(1, 20)] + [("calm", i, i, 1.0) for i in range(10)]
    cut = with_chunks(frame(spark, rows), ["entity"], ["at", "id"], pieces=10)
    sizes = [r["count"] for r in cut.groupBy("chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * len(rows) / 10
    assert len(sizes) >= 9
    along = sorted(cut.collect(), key=lambda r: (r["entity"], r["at"] is not None, r["at"], r["id"]))
    assert [r["chunk"] for r in along] == sorted(r["chunk"] for r in along)


@pytest.mark.parametrize("n", [1, 2, 7, 40, 5000])
def test_windows_of_any_length_equal_sliding_frames(spark, n):
    rows = [(e, i // 3, i, None if i % 11 == 4 else v) for e, _, i, v in random_rows(9, count=900)]
    df = frame(spark, rows).cache()
    got = ops.rolling_stats(df, ["entity"], ["at", "id"], F.floor(F.col("at") / 70), n=n)
    ring = Window.partitionBy("entity").orderBy("at", "id").rowsBetween(1 - n, 0)
    want = df.select(
        "entity", "at", "id", "value", F.count("value").over(ring).alias("samples"),
        (F.sum("value").over(ring) / F.count("value").over(ring).cast("double")).alias("mean"),
        F.max("value").over(ring).alias("max"), F.min("value").over(ring).alias("min"),
    )
    spark.conf.set("spark.sql.ansi.enabled", "false")  # windows of null values alone
    try:
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("pieces", [1, 2, 7, 60])
def test_rolling_stats_with_null_times_and_values(spark, pieces):
    rows = [("a", None if i < 5 else i // 3, i, None if i % 4 == 1 else float(i % 7)) for i in range(200)]
    cut = with_chunks(frame(spark, rows), ["entity"], ["at", "id"], pieces)
    got = ops.rolling_stats(cut, ["entity"], ["at", "id"], F.col("chunk"), n=6).collect()
    values = [r[3] for r in rows]
    for r in got:
        ring = [v for v in values[max(0, r["id"] - 5) : r["id"] + 1] if v is not None]
        assert r["samples"] == len(ring)
        assert (r["max"], r["min"]) == ((max(ring), min(ring)) if ring else (None, None))
    assert len(got) == len(rows)


def test_statistics_agree_on_null_values(spark):
    df = frame(spark, [("a", 1, 1, 1.0), ("a", 2, 2, None)])
    recent = ops.last_n(df, ["entity"], ["at", "id"])
    stats, shown = ops.series_stats(recent, ["entity"]).first(), ops.overlay(recent, ["entity"]).first()
    assert (stats["samples"], stats["mean"], shown["mean"]) == (1, 1.0, 1.0)
