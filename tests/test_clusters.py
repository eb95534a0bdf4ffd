"""Cluster liveness."""

import json

import pytest

from fleetgauge.operators import liveness as ops
from fleetgauge.sources import landing

SPARK_MASTER = ["java", "org.apache.spark.deploy.master.Master", "--host", "h"]


def check(spark, framework, hosts, payload):
    expected = spark.createDataFrame(
        [("c", framework, h) for h in hosts], "cluster_id string, framework string, host string"
    )
    raw = spark.createDataFrame([("c", True, json.dumps(payload))], "cluster_id string, ok boolean, payload string")
    return expected, landing.worker_listing(raw, ["cluster_id"])


def result(spark, *args):
    row = ops.workers_up(*check(spark, *args)).first()
    return row["ok"], row["active_count"], row["message"]


def workers(*pairs):
    return {"workers": [{"state": s, "host": h} for s, h in pairs]}


@pytest.mark.parametrize("framework, hosts, payload, want", [
    ("spark", ["n1", "n2"], workers(("ALIVE", " n1 "), ("ALIVE", "n2"), ("DEAD", "n3")), (True, 2, "")),
    ("Spark", ["n1", "n2"], workers(("ALIVE", "n1"), ("ALIVE", "n1 ")), (False, 1, "")),
    ("spark", ["n1", "n1"], workers(("ALIVE", "other")), (True, 1, "")),
    ("FLINK", ["n1", "n2"], {"taskmanagers": [{"id": "a"}, {"id": "a"}]}, (True, 2, "")),
    ("flink", ["n1"], {"taskmanagers": []}, (False, 0, "")),
    ("spark", ["n1"], {}, (False, 0, "")),
    ("spark", [None], workers(("ALIVE", "n1")), (False, 0, ops.NO_WORKERS)),
    ("storm", ["n1"], workers(("ALIVE", "n1")), (False, 0, ops.NO_WORKERS)),
])
def test_workers_up(spark, framework, hosts, payload, want):
    assert result(spark, framework, hosts, payload) == want


@pytest.mark.parametrize("user, command, alive, up", [
    ("ops", SPARK_MASTER, "ALIVE", True),
    ("root", SPARK_MASTER, "ALIVE", False),
    ("ops", SPARK_MASTER, "DEAD", False),
    ("ops", ["python"], "ALIVE", False),
    ("ops", [], "ALIVE", False),
])
def test_cluster_up(spark, user, command, alive, up):
    sides = check(spark, "spark", ["n1"], workers((alive, "n1")))
    processes = spark.createDataFrame(
        [("c", "spark", user, "ops", command)],
        "cluster_id string, framework string, username string, owner string, cmdline array<string>",
    )
    assert ops.cluster_up(*sides, processes).first()["cluster_up"] is up


def test_cluster_without_processes_is_down(spark):
    sides = check(spark, "spark", ["n1"], workers(("ALIVE", "n1")))
    none = spark.createDataFrame(
        [], "cluster_id string, framework string, username string, owner string, cmdline array<string>"
    )
    row = ops.cluster_up(*sides, none).first()
    assert (row["workers_up"], row["cluster_up"]) == (True, False)


@pytest.mark.parametrize("framework, hosts, payload, ok, master, want", [
    ("Spark", ["n1", "n2", "n1"], workers(("ALIVE", " n1 "), ("ALIVE", "n2"), ("DEAD", "n3")), True, True, True),
    ("spark", ["n1", "n2"], workers(("ALIVE", "n1"), ("ALIVE", "n1")), True, True, False),
    ("spark", ["n1"], workers(("ALIVE", "n1")), None, True, False),
    ("spark", ["n1"], workers(("ALIVE", "n1")), True, None, False),
    ("flink", ["n1", "n2"], {"taskmanagers": [{"id": "a"}, {"id": "a"}]}, True, True, True),
    ("flink", [], {"taskmanagers": []}, True, True, False),
    ("flink", [None], {"taskmanagers": []}, True, True, False),
    ("storm", ["n1"], workers(("ALIVE", "n1")), True, True, False),
    ("spark", None, workers(("ALIVE", "n1")), True, True, False),
    ("spark", ["n1"], None, True, True, False),
])
def test_report_up(spark, framework, hosts, payload, ok, master, want):
    df = spark.createDataFrame(
        [(framework, hosts, None if payload is None else json.dumps(payload), ok, master)],
        "framework string, expected array<string>, payload string, ok boolean, master boolean")
    up = ops.report_up("framework", "expected", "payload", "ok", "master")
    assert df.select(up).first()[0] is want


def test_failed_listing_without_a_message_is_not_up(spark):
    expected, listed = check(spark, "spark", ["n1"], workers(("ALIVE", "n1")))
    errors = spark.createDataFrame([("c", None)], "cluster_id string, message string")
    row = ops.workers_up(expected, listed, errors).first()
    assert (row["ok"], row["message"]) == (False, ops.UNKNOWN_ERROR)
