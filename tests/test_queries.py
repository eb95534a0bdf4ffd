"""Every registered query against its SQL, on whole tables."""

import os
import subprocess
import sys

import pytest

from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from fleetgauge.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, name):
    assert compare(queries()[name](spark, SF_DIR), tables, oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_import_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("pieces", [1, 60])
@pytest.mark.parametrize("name", [
    "rolling_stats", "rolling_stats_padded", "sticky_entity", "sticky_entity_flink",
    "metric_errors_first", "flink_monitor",
])
def test_cut_series_match_sql(spark, tables, monkeypatch, name, pieces):
    """The same results however finely the series are cut."""
    monkeypatch.setattr("fleetgauge.plans.history.PIECES", pieces)
    monkeypatch.setattr("fleetgauge.plans.selection.PIECES", pieces)
    assert compare(queries()[name](spark, SF_DIR), tables, oracle_sql()[name]) == []
