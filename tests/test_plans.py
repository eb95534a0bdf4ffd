"""Physical plans have the shape that scales."""

import re

import pytest

from fleetgauge.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"
BATCH = [name for name in sorted(QUERIES) if not name.startswith(("stream_", "csv_"))]


def plan(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


def exchanges(text):
    return len(re.findall(r"[:+|\- ]Exchange ", text))


@pytest.mark.parametrize("name", BATCH)
def test_no_python_cross_join_or_single_task(spark, name):
    text = plan(spark, name)
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text
    # A one-row total is the only result that comes from one task.
    assert ("SinglePartition" in text) == (name == "row_count")


@pytest.mark.parametrize("name", ["history_last_n", "series_stats", "stat_overlay", "timeline_merge"])
def test_series_are_cut_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .* Partial", plan(spark, name))


@pytest.mark.parametrize("name, count", [
    ("history_last_n", 1), ("series_stats", 1), ("series_stats_padded", 1), ("stat_overlay", 1),
    ("spark_snapshot", 1), ("enabled_metrics", 1), ("spark_job_counts", 1), ("current_app", 1),
    ("timeline_meta_merge", 1), ("timeline_merge", 2), ("timeline_points", 0), ("process_match", 0),
    ("nodelist_expand", 0), ("allocation_tree", 0), ("job_resources", 0), ("slurm_jobs_explode", 0),
])
def test_number_of_shuffles(spark, name, count):
    assert exchanges(plan(spark, name)) == count


@pytest.mark.parametrize("name, columns", [
    ("trips_per_day", "ts"), ("trips_per_base", "event_type"), ("row_count", ""),
    ("spark_stage_counts", "l_orderkey,l_returnflag,l_linestatus"),
    ("timeline_points", "event_id,ts,user_id,event_type,value"),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, name)).group(1)
    assert ",".join(field.split(":")[0] for field in schema.split(",")) == columns


@pytest.mark.parametrize("name", ["timeline_points", "timeline_densest", "nodelist_expand"])
def test_documents_are_parsed_once(spark, name):
    assert not re.search(r"Filter .*(from_json|regexp_extract)", plan(spark, name))


def test_points_are_folded_without_a_sort(spark):
    assert "SortAggregate" not in plan(spark, "timeline_merge")


def test_commands_are_not_cut_into_arrays_of_texts(spark):
    assert not re.search(r"transform\(sequence", plan(spark, "process_match_join"))


def test_landed_polls_are_pruned_by_folder(spark):
    found = re.search(r"PartitionFilters: \[([^]]*)\]", plan(spark, "raw_polls_landed"))
    assert "endpoint" in found[1]
