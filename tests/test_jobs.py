"""Scheduler jobs, node lists and resource plans."""

import json

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import nodelists
from fleetgauge.operators import allocation
from fleetgauge.operators import jobs as ops
from fleetgauge.sources import landing


@pytest.mark.parametrize("nodes, want", [
    ("gpu-login", ["gpu-login"]),
    ("", []),
    (None, []),
    ([], []),
    (["left", "right"], ["left", "right"]),
    ({"allocation": [{"name": "r7"}, {}, {"name": "r2"}]}, ["r7", "r2"]),
    ({"allocation": [{"name": ""}, {"name": ""}], "list": "solo9"}, ["solo9"]),
    ({"allocation": [], "list": "r[8-9]"}, ["r8", "r9"]),
    ({"list": ["up", "down"]}, ["up", "down"]),
    ({"count": 4}, []),
    ("rack[008-010]", ["rack008", "rack009", "rack010"]),
    ("z[20-22,7,31]", ["z20", "z21", "z22", "z7", "z31"]),
    ("z[9-11]", ["z9", "z10", "z11"]),
    ("z[0004,12]", ["z0004", "z12"]),
    ("z[6-2]", []),
    ("m1,m2", ["m1,m2"]),
    ("u[1-4],v[2]", None),
    ("u[one]", None),
    ("u[1-2-3]", None),
    ("u[3-]", None),
    ("u[]", None),
    ("u[7]w", ["u[7]w"]),
    ("  u[7]  ", ["u7"]),
])
def test_node_shapes(spark, nodes, want):
    text = nodes if isinstance(nodes, str) or nodes is None else json.dumps(nodes)
    df = spark.createDataFrame([(text,)], "nodes string")
    assert df.select(nodelists.normalise(F.col("nodes"))).first()[0] == want


def document(**fields):
    def triple(number, given=True):
        return {"set": given, "infinite": False, "number": number}

    job = {
        "job_id": 42, "name": "j", "partition": "p", "user_name": "u", "node_count": triple(2),
        "cpus_per_task": triple(4), "tasks": triple(1), "memory_per_cpu": triple(0),
        "memory_per_node": triple(8000), "start_time": triple("2024-01-01T00:00:00"),
        "job_resources": {"nodes": {"allocation": [{"name": "n1"}, {"name": "n2"}]}}, "nodes": "n[1-2]",
    }
    return json.dumps({"jobs": [job | fields, job | {"job_id": 43}]}), triple


def resources(spark, payload):
    raw = spark.createDataFrame([(payload,)], "payload string")
    jobs = ops.with_nodes(landing.slurm_jobs(raw))
    return ops.job_resources(ops.resource_columns(jobs)).filter("job_id = '42'").first()


def test_resources_of_a_landed_job(spark):
    payload, _ = document()
    row = resources(spark, payload)
    assert row["node_list"] == ["n1", "n2"]
    assert (row["cpus_per_node"], row["total_cpus"]) == (4, 8)
    assert (row["memory_per_node_effective"], row["total_memory"]) == (8000, 16000)
    assert row["start_time"]["number"] == "2024-01-01T00:00:00"


def test_memory_per_cpu_and_no_nodes(spark):
    _, triple = document()
    payload, _ = document(
        cpus_per_task=triple(2), tasks=triple(3), memory_per_cpu=triple(512),
        memory_per_node=triple(1, False), job_resources={},
    )
    row = resources(spark, payload)
    assert row["memory_per_node_effective"] == 3072
    assert (row["node_count"], row["total_cpus"], row["total_memory"]) == (0, 0, 0)


def test_explicit_zero_memory_stays(spark):
    _, triple = document()
    payload, _ = document(memory_per_node=triple(0), memory_per_cpu=triple(512))
    assert resources(spark, payload)["memory_per_node_effective"] == 0


def test_slurm_files(spark, tmp_path):
    (tmp_path / "queue.json").write_text(json.dumps(json.loads(document()[0]), indent=2))
    jobs = landing.read_slurm_files(spark, str(tmp_path))
    assert sorted(r["job_id"] for r in jobs.collect()) == ["42", "43"]


def test_faults_of_slurm_files_are_told(spark, tmp_path):
    """Every file is either read or listed, whatever is in it."""
    whole = json.dumps(json.loads(document()[0]), indent=2)
    texts = {
        "good": whole, "cut": whole[:-4], "html": "<html>502</html>", "blank": " \n\n",
        "other": '{"jobs": null}', "word": '"jobs"', "nameless": '{"jobs": [{"name": "x"}, {"job_id": "7"}]}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    documents = landing.slurm_file_documents(spark, str(tmp_path))
    short = F.regexp_extract("file", r"([a-z]+)\.json$", 1).alias("name")
    assert sorted((r.name, r.job_id) for r in landing.slurm_file_jobs(documents).select(short, "job_id").collect()) == [
        ("good", "42"), ("good", "43"), ("nameless", "7")]
    faults = landing.slurm_file_faults(documents).select(short, "reason").collect()
    assert {r.name: r.reason for r in faults} == {
        "cut": landing.UNREADABLE, "html": landing.UNREADABLE,
        "blank": landing.EMPTY_FILE, "other": landing.NO_JOBS, "word": landing.UNREADABLE,
        "nameless": landing.NAMELESS_JOB,
    }


def test_slurm_files_are_read_about_once(spark, tmp_path):
    """Job ids that are numbers do not send the reader back to the file."""
    path = tmp_path / "queue.json"
    jobs = ",\n".join(f'{{"job_id": {i}, "nodes": {{"a": [{i}, 1.50]}}}}' for i in range(5000))
    path.write_text(f'{{"jobs": [\n{jobs}\n]}}')
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem

    def read():
        return sum(some.getBytesRead() for some in files.getAllStatistics())

    for load in (
        lambda: landing.read_slurm_files(spark, str(path)),
        lambda: landing.slurm_file_jobs(landing.slurm_file_documents(spark, str(path))),
    ):
        before, found = read(), load().select("job_id", "nodes").collect()
        assert read() - before < 10 * path.stat().st_size
        assert {(r.job_id, r.nodes) for r in found} == {
            (str(i), f'{{"a": [{i}, 1.50]}}') for i in range(5000)}


def test_slurm_files_that_are_not_utf8_are_told_once(spark, tmp_path):
    for code in ("utf-16", "utf-16-be", "utf-32"):
        (tmp_path / f"{code}.json").write_bytes('{"jobs": [{"job_id": 7}]}'.encode(code))
    documents = landing.slurm_file_documents(spark, str(tmp_path))
    assert landing.slurm_file_jobs(documents).collect() == []
    assert [r.reason for r in landing.slurm_file_faults(documents).collect()] == [landing.UNREADABLE] * 3


def test_lookup_takes_the_first(spark):
    jobs = spark.createDataFrame(
        [("7", 2, "late"), ("7", 1, "early"), ("x", 0, "bad"), ("8", 3, "other")],
        "job_id string, place long, name string",
    )
    wanted = spark.createDataFrame([(7,), (9,)], "job_id long")
    got = ops.lookup_jobs(jobs, wanted, "place").collect()
    assert [(r["job_id"], r["name"]) for r in got] == [(7, "early")]


@pytest.mark.parametrize("row, want", [
    (("12", "1700000000", "batch"), (True, 12, 1700000000, "batch")),
    (("12", "1700000000", ""), (True, 12, 1700000000, "local")),
    (("12", "0", None), (False, 12, 0, "local")),
    (("0", "5", "p"), (False, 0, 5, "p")),
    (("localhost", "5", "p"), (False, None, None, None)),
    (("12", "2024-01-01T00:00:00", "p"), (False, None, None, None)),
    ((None, "5", "p"), (False, None, None, None)),
    (("1.5", "5", "p"), (False, None, None, None)),
])
def test_job_identity(spark, row, want):
    df = spark.createDataFrame([row], "job_id string, start_time string, partition string")
    got = ops.job_identity(df).first()
    assert (got["ok"], got["job_id"], got["job_start"], got["partition"]) == want


def test_master_and_workers(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), (["x"],), ([],)], "node_list array<string>")
    got = [(r["master"], r["workers"]) for r in ops.master_and_workers(df).collect()]
    assert got == [("a", ["a", "b"]), ("x", ["x"]), (None, [])]


PLAN = {
    "driver_cpu": 1, "worker_cpu": 7, "executor_cpu": 7, "driver_memory": 1000,
    "worker_memory": 1000, "executor_memory": 1000, "node_cpus": 8, "node_mem": 2000,
}


@pytest.mark.parametrize("change, violated", [
    ({}, []),
    ({"driver_cpu": 0}, ["driver_cpu"]),
    ({"driver_cpu": 8}, ["driver_cpu", "worker_cpu"]),
    ({"worker_cpu": 8}, ["worker_cpu"]),
    ({"executor_cpu": 8}, ["executor_cpu"]),
    ({"driver_memory": 1128}, ["driver_memory", "worker_memory"]),
    ({"executor_memory": 1001}, ["executor_memory", "executor_memory_step"]),
    ({"executor_memory": 872}, ["executor_memory"]),
])
def test_plan_rules(spark, change, violated):
    row = allocation.check_plans(spark.createDataFrame([PLAN | change])).first()
    assert (row["violated"], row["feasible"]) == (violated, not violated)


def tree(spark, nodes, master=None, workers=None):
    schema = (
        "job_id long, node_list array<string>, master_node string, worker_nodes array<string>,"
        " cpus_per_node long, memory_per_node_effective long, total_cpus long, total_memory long,"
        " driver_cpu long, worker_cpu long, executor_cpu long,"
        " driver_memory long, worker_memory long, executor_memory long"
    )
    row = (1, nodes, master, workers, 4, 800, 8, 1600, 1, 3, 2, 100, 300, 200)
    df = allocation.allocation_tree(spark.createDataFrame([row], schema))
    found = df.orderBy("node_position", "child_position", "level").collect()
    return [(r["node_position"], r["child_position"], r["title"], r["cores"], r["memory_mb"]) for r in found]


def test_allocation_tree(spark):
    assert tree(spark, ["a", "b"]) == [
        (-1, 0, "Slurm Job", 8, 1600),
        (0, 0, "Node ID: a", 4, 800), (0, 0, "Coordinator", 1, 100),
        (0, 1, "Resource Pool", 3, 300), (0, 1, "Compute Unit", 2, 200),
        (1, 0, "Node ID: b", 4, 800),
        (1, 1, "Resource Pool", 3, 300), (1, 1, "Compute Unit", 2, 200),
    ]


def test_allocation_tree_with_named_master_and_workers(spark):
    rows = tree(spark, ["a", "b"], master="b", workers=["b", "b", "elsewhere"])
    assert [(r[0], r[1], r[2]) for r in rows] == [
        (-1, 0, "Slurm Job"), (0, 0, "Node ID: a"), (1, 0, "Node ID: b"), (1, 0, "Coordinator"),
        (1, 1, "Resource Pool"), (1, 1, "Compute Unit"), (1, 2, "Resource Pool"), (1, 2, "Compute Unit"),
    ]


def test_allocation_tree_without_nodes(spark):
    assert tree(spark, []) == [(-1, 0, "Slurm Job", 8, 1600)]


def test_unreadable_scheduler_documents_are_listed(spark):
    texts = ['{"jobs":[{"job_id":7}]}', '{"jobs":[{"job_id":7},{"name":"x"}]}', '{"jobs":[{', "<html>", '{"jobs":[]}']
    raw = spark.createDataFrame(list(enumerate(texts)), "page long, payload string")
    found = landing.slurm_errors(raw, ["page"]).orderBy("page").collect()
    assert [tuple(r) for r in found] == [
        (1, "job without an id"), (2, "unreadable document"), (3, "unreadable document")]
