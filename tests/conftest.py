from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from footfall.session import build_session, scratch  # noqa: E402
from footfall.sources.tables import table_exists  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "footfall-tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    with scratch(session) as made:
        yield session
    assert not any(table_exists(session, path) for path in made)


@pytest.fixture(scope="session")
def testdata():
    return os.environ.get("FOOTFALL_TESTDATA", "/root/testdata")
