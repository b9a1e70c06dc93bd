import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import edge_tables  # noqa: E402


@pytest.fixture(scope="session")
def edge_folder(spark, tmp_path_factory):
    return edge_tables.save(spark, tmp_path_factory.mktemp("edge"), edge_tables.documents())


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory):
    return edge_tables.save(spark, tmp_path_factory.mktemp("empty"), [])
