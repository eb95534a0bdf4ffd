import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fleetgauge.session import build_session, remove_written  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fleetgauge-tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_written(session)
    session.stop()
