"""Chosen applications and jobs."""

import random

import pytest

from fleetgauge.operators import selection as ops

APPS = "poll long, app_id string, position long, attempts array<struct<completed boolean>>"


def current_app(spark, *apps):
    rows = [(1, app_id, i, attempts) for i, (app_id, attempts) in enumerate(apps)]
    return ops.current_app(spark.createDataFrame(rows, APPS), ["poll"]).first()["app_id"]


@pytest.mark.parametrize("apps, want", [
    ([("a1", [(True,)]), ("a2", [(False,)]), ("a3", [(False,)])], "a2"),
    ([("a1", [(True,)]), ("a2", [(True,)])], "a2"),
    ([("a1", None), ("a2", [(None,)]), ("a3", [])], "a3"),
    ([("a1", [(True,), (False,)]), ("a2", [(True,)])], "a2"),
    ([(None, None)], None),
])
def test_current_app(spark, apps, want):
    assert current_app(spark, *apps) == want


@pytest.mark.parametrize("statuses, want", [
    (["FINISHED", "RUNNING", "RUNNING"], "job-1"),
    (["FINISHED", "FAILED"], "cluster"),
    ([None], "cluster"),
])
def test_current_flink_job(spark, statuses, want):
    rows = [(1, f"job-{i}", i, s) for i, s in enumerate(statuses)]
    df = spark.createDataFrame(rows, "poll long, job_id string, position long, status string")
    assert ops.current_flink_job(df, ["poll"]).first()["job_id"] == want


def brute_force(polls, fallback):
    """What a collector that polls one cluster reports, poll by poll."""
    held, out = None, {}
    for poll, candidate, ok in polls:
        held = held or candidate
        if held is None and fallback is None:
            continue
        if ok:
            out[poll] = held or fallback
        else:
            held = None
    return out


@pytest.mark.parametrize("fallback", [None, "cluster"])
@pytest.mark.parametrize("width", [1, 3, 10, 1000])
@pytest.mark.parametrize("fail", [0.02, 0.3, 0.9])
def test_sticky_entity(spark, fallback, width, fail):
    rng = random.Random(f"{width}-{fail}")
    clusters = {
        c: [
            (i, None if rng.random() < 0.6 else f"app-{i}", rng.random() >= fail)
            for i in range(120)
        ]
        for c in ("a", "b")
    }
    rows = [(c, *poll) for c, polls in clusters.items() for poll in polls]
    df = spark.createDataFrame(rows, "cluster string, poll long, candidate string, ok boolean")
    chunk = (df["poll"] / width).cast("long")
    got = ops.sticky_entity(df, ["cluster"], "poll", chunk, fallback=fallback).collect()
    want = {
        (c, poll): entity
        for c, polls in clusters.items()
        for poll, entity in brute_force(polls, fallback).items()
    }
    assert {(r["cluster"], r["poll"]): r["entity_id"] for r in got} == want


def test_unknown_outcome_ends_the_choice(spark):
    rows = [("a", 1, "x", True), ("a", 2, "y", None), ("a", 3, "z", True), ("a", 4, "w", True)]
    df = spark.createDataFrame(rows, "cluster string, poll long, candidate string, ok boolean")
    got = ops.sticky_entity(df, ["cluster"], "poll", df["poll"] * 0).collect()
    assert sorted((r.poll, r.entity_id) for r in got) == [(1, "x"), (3, "z"), (4, "z")]
