"""Unions of pair sets and of per-run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def concat_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column some tables lack is null there."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
