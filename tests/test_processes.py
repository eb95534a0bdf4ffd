"""Process matching, metrics, labels and search."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.constants import PROCESS_LABELS, PROCESS_PATTERNS, TIMELINE_LABELS
from fleetgauge.operators import catalog
from fleetgauge.operators import processes as ops

SCHEMA = "pid long, username string, status string, cmdline array<string>"
PATTERNS = [{"title": "Master", "pattern": "deploy.master.Master --host"}, "worker"]


def procs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def titles(df):
    return {r["pid"]: r["title"] for r in df.collect()}


def test_match(spark):
    df = procs(
        spark,
        ("me", "running", ["java", "deploy.master.Master", "--host", "worker"]),
        ("me", "zombie", ["worker"]),
        ("me", "dead", ["worker"]),
        ("you", "running", ["worker"]),
        ("me", "sleeping", ["Worker"]),
        ("me", "sleeping", ["a", "my-worker-1"]),
        ("me", "sleeping", []),
        ("me", "sleeping", None),
    )
    found = ops.match_processes(df, F.lit("me"), PATTERNS)
    assert titles(found) == {0: "Master", 5: "worker"}


def test_empty_patterns_never_match(spark):
    df = procs(spark, ("me", "running", ["x"]))
    for patterns in ([], [""], [{"title": "t"}], [{"title": "t", "pattern": ""}]):
        assert ops.match_processes(df, F.lit("me"), patterns).count() == 0


def test_title_stands_back_to_pattern(spark):
    df = procs(spark, ("me", "running", ["abc"]))
    assert titles(ops.match_processes(df, F.lit("me"), [{"pattern": "b"}])) == {0: "b"}


def test_any_pattern_takes_zombies_but_no_empty_commands(spark):
    df = procs(spark, ("me", "zombie", ["worker"]), ("me", "running", []), ("you", "running", ["worker"]))
    found = ops.any_pattern(df, F.lit("me"), ["", "worker"])
    assert [r["pid"] for r in found.collect()] == [0]


def test_normalise_patterns(spark):
    df = spark.createDataFrame(
        [("t", "p", None), (None, "p", None), (None, None, None), (None, None, "s"), ("t", None, None)],
        "title string, pattern string, plain string",
    )
    got = [(r["label"], r["pattern"]) for r in ops.normalise_patterns(df).collect()]
    assert got == [("t", "p"), ("p", "p"), ("unknown", None), ("s", "s"), ("t", None)]


@pytest.mark.parametrize("gram", [1, 2, 3, 6])
def test_pattern_table_matches_brute_force(spark, gram):
    """Patterns shorter and longer than a run; one command makes up a third of the processes."""
    rng = random.Random(7)

    def text(size):
        return "".join(rng.choice("ab ") for _ in range(size))

    commands = ["ab ba" if rng.random() < 0.33 else text(rng.randrange(0, 9)) for _ in range(200)]
    df = procs(spark, *[("me", "running", [c]) for c in commands])
    titled = [None, "t", ""]
    patterns = [
        (None if i > 15 else i // 2, titled[i % 3], text(rng.randrange(0, 5))) for i in range(20)
    ]
    table = spark.createDataFrame(patterns, "priority long, title string, pattern string")
    want = {}
    for pid, command in enumerate(commands):
        hits = [
            (order is None, order, pattern, pattern if title is None else title)
            for order, title, pattern in patterns if pattern and pattern in command
        ]
        if hits:
            want[pid] = min(hits, key=lambda h: (h[0], h[1] or 0, h[2], h[3]))[3]
    assert titles(ops.match_processes_table(df, F.lit("me"), table, gram)) == want


def test_index_has_a_row_for_each_character_at_most(spark):
    df = spark.createDataFrame([("abab", 1), ("", 2), (None, 3), ("x", 4)], "text string, id long")
    rows = ops._grams(df, "text", ["id"], 3, ends=True).collect()
    assert sorted(map(tuple, rows)) == [(1, "ab"), (1, "aba"), (1, "b"), (1, "bab"), (4, "x")]
    whole = ops._grams(df, "text", ["id"], 3, ends=False).collect()
    assert sorted(map(tuple, whole)) == [(1, "aba"), (1, "bab")]


def test_unreported_status_is_alive(spark):
    df = procs(spark, ("me", None, ["run"]), ("me", "dead", ["run"]), ("you", None, ["run"]))
    assert titles(ops.match_processes(df, F.lit("me"), ["run"])) == {0: "run"}


def test_known_process_patterns(spark):
    line = "java -cp x org.apache.spark.deploy.worker.Worker --webui-port 8081"
    patterns = [{"title": t, "pattern": p} for t, p in PROCESS_PATTERNS["spark"]]
    found = ops.match_processes(procs(spark, ("me", "running", line.split(" "))), F.lit("me"), patterns)
    assert titles(found) == {0: "Worker"}


def test_sizes_in_mib(spark):
    mib = 1024 * 1024
    row = (1, 12.5, 3.5, 100 * mib, 200 * mib, 7, 2 * mib, mib // 2)
    schema = (
        "pid long, cpu_percent double, memory_percent double, rss long, vms long,"
        " num_threads long, read_bytes long, write_bytes long"
    )
    got = ops.process_snapshot(spark.createDataFrame([row], schema), ["pid"]).first().asDict()
    assert got == {
        "pid": 1, "cpu": 12.5, "mem_pct": 3.5, "mem_rss": 100.0, "mem_vms": 200.0, "threads": 7,
        "io_read": 2.0, "io_write": 0.5,
    }
    assert [*got][1:] == [*PROCESS_LABELS]


def samples(spark, *metrics):
    return spark.createDataFrame([(m,) for m in metrics], "metric string")


def test_labels(spark):
    got = catalog.with_labels(samples(spark, "ipc", "own"), "timeline").collect()
    assert {r["metric"]: r["label"] for r in got} == {"ipc": "IPC", "own": "own"}
    own = spark.createDataFrame([("timeline", "own", "Mine")], "source string, metric string, label string")
    got = catalog.with_labels(samples(spark, "own"), "timeline", own).first()
    assert got["label"] == "Mine"


def test_catalog_size(spark):
    sizes = {r["source"]: r["count"] for r in catalog.metric_catalog(spark).groupBy("source").count().collect()}
    assert sizes == {"timeline": 31, "spark": 19, "flink": 17, "process": 7}


@pytest.mark.parametrize("text, want", [
    ("MEM", {"mem_used", "mem_bw", "gpu_mem", "job_mem_used"}),
    ("horse read bw", {"horse_read_bw"}),
    ("", {*TIMELINE_LABELS}),
    ("nothing", set()),
])
def test_search(spark, text, want):
    found = catalog.search_metrics(samples(spark, *TIMELINE_LABELS), "timeline", text)
    assert {r["metric"] for r in found.collect()} == want
