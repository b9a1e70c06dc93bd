"""Every query with checking SQL gives DuckDB's result on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from pulsegrid.plans import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value if value is None or isinstance(value, int) else str(value)


def kind(type_name):
    name = str(type_name).lower()
    if "int" in name:
        return "int"
    return "double" if name in ("double", "float") else "text"


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_matches_sql(name, spark, duck):
    df = all_queries.QUERIES[name](spark, FOLDER)
    relation = duck.sql(all_queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    types = dict(zip(relation.columns, relation.types))
    assert {c: kind(df.schema[c].dataType.simpleString()) for c in columns} == {c: kind(types[c]) for c in columns}
    order = [relation.columns.index(c) for c in columns]
    ours = [tuple(map(plain, row)) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    theirs = [tuple(plain(row[i]) for i in order) for row in relation.fetchall()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)
    assert ours


def test_every_oracle_has_a_query():
    assert set(all_queries.ORACLES) <= set(all_queries.QUERIES)
