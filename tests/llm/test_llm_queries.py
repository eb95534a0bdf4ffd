import os
import subprocess
import sys

import pytest

from oracle import TYPES, compare, connect

import __spark_entry__
from fleetgauge.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES["INTEGER"] = "int"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


def test_all_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_the_rest_works_without_this_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    code = (
        "import sys; sys.modules['fleetgauge.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
