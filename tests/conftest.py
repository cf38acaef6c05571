import functools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def pytest_sessionstart(session):
    """Some modules make columns when they are collected, which takes a session."""
    _session()


@functools.cache
def _session():
    from tidewatch.session import build_session

    session = build_session(
        app="tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.noDataMicroBatches.enabled": "true",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def spark():
    yield _session()
    _session().stop()
