import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pulsegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "pulsegrid-tests", "local[*]", 8, spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__adaptive__coalescePartitions__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """DataFrame from tuples and a DDL schema."""
    return lambda data, ddl: spark.createDataFrame(data, ddl)
