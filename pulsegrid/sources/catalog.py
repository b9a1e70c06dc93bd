"""Named tables under one data root."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pulsegrid.sources import schemas as S
from pulsegrid.sources.readers import read_csv, read_json_lines, read_parquet


@dataclass(frozen=True)
class TableSpec:
    path: str
    fmt: str = "parquet"
    schema: T.StructType | None = None


_READERS: dict[str, Callable] = {"csv": read_csv, "jsonl": read_json_lines}

# Table names by the kind of their export.
PROCESSED = {
    "lab_results": TableSpec("processed/lab_results.csv", "csv"),
    "lab_updates": TableSpec("processed/lab_updates.csv", "csv"),
    "lab_results_with_triggerdate": TableSpec("processed/lab_results_with_triggerdate.csv", "csv"),
    "baseline_screener_survey": TableSpec("processed/baseline_screener_survey.csv", "csv"),
    "daily_surveys_onehot": TableSpec("processed/daily_surveys_onehot.csv", "csv"),
    "fitbit_day_level_activity": TableSpec("processed/fitbit_day_level_activity.csv", "csv", S.DAY_ACTIVITY),
    "processed_fitbit_minute_level_activity": TableSpec("processed/processed_fitbit_minute_level_activity"),
}


class Catalog:
    """Tables by name: ``Catalog(spark, root).table("lab_results")``.

    ``debug_root`` replaces the root when the environment has ``DEBUG_DATA``.
    """

    def __init__(
        self, spark: SparkSession, root: str, debug_root: str | None = None, specs: dict[str, TableSpec] | None = None
    ) -> None:
        self.spark = spark
        self.root = debug_root if debug_root and os.environ.get("DEBUG_DATA") else root
        self.specs = dict(PROCESSED if specs is None else specs)

    def add(self, name: str, spec: TableSpec) -> None:
        self.specs[name] = spec

    def path(self, name: str) -> str:
        if name not in self.specs:
            raise ValueError(f"unknown table {name!r} under {self.root}")
        return f"{self.root.rstrip('/')}/{self.specs[name].path}"

    def table(self, name: str) -> DataFrame:
        path, spec = self.path(name), self.specs[name]
        if spec.fmt == "parquet":
            return read_parquet(self.spark, path)
        return _READERS[spec.fmt](self.spark, path, spec.schema)

    def register(self, *names: str) -> None:
        """Make tables visible to SQL under their names."""
        for name in names or self.specs:
            self.table(name).createOrReplaceTempView(name)
