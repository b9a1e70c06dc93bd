"""Row selection, renaming and cell overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    if not isinstance(mapping, Mapping):
        raise ValueError("mapping must be a dict of old name to new name")
    for old, new in mapping.items():
        df = df.withColumnRenamed(old, new)
    return df


def parse_rename_list(pairs: Sequence[str]) -> dict[str, str]:
    """``["old:new", ...]`` as a dict."""
    return dict(pair.split(":", 1) for pair in pairs)


def between_dates(df: DataFrame, column: str, min_date: str | None = None, max_date: str | None = None) -> DataFrame:
    """Inclusive date range; each bound is optional. Typed literals reach the scan."""
    if min_date is not None:
        df = df.where(F.col(column) >= F.lit(min_date).cast(df.schema[column].dataType))
    if max_date is not None:
        df = df.where(F.col(column) <= F.lit(max_date).cast(df.schema[column].dataType))
    return df


def cut_dates(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open range ``[start, end)``."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(df.schema[column].dataType))
    if end is not None:
        df = df.where(F.col(column) < F.lit(end).cast(df.schema[column].dataType))
    return df


def keep_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in ``listed``; duplicate list entries do not multiply rows.

    Spark picks the join from the list's size, so a list may be as large as it likes.
    """
    return df.join(listed, on=on, how="left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(listed, on=on, how="left_anti")


def keep_consented(df: DataFrame, consent: DataFrame, id_col: str, consent_col: str = "consent_id") -> DataFrame:
    """Rows whose external id, read as a number, is in the consent list."""
    number = F.col(id_col).try_cast("bigint")
    return df.join(consent, number == consent[consent_col].cast("bigint"), "left_semi")


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def override_cells(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Replace listed cells.

    ``overrides`` has the key plus any of the columns of ``df``; its non-null
    cells win. Overrides must be unique per key.
    """
    columns = [c for c in overrides.columns if c != key]
    renamed = overrides.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(renamed, on=key, how="left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )
