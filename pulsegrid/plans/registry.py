"""Registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.plans.fixtures import FIXTURES, SPARK_AGG, SQL_AGG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Base tables and fixture projections of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._bases: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            if name not in self._bases:
                self._bases[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return self._bases[name]
        sql, bases = FIXTURES[name]
        frames = {base: self(base) for base in bases}
        sql = sql.replace("{", "{{").replace("}", "}}")
        for base in bases:
            sql = sql.replace(f"[{base}]", f"{{{base}}}")
        return self.spark.sql(sql.replace("<agg>", SPARK_AGG), **frames)


def publish(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: dates and times as text, flags as 0/1, arrays joined."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.BooleanType):
            column = column.cast("int")
        elif isinstance(field.dataType, T.ArrayType):
            inner = field.dataType.elementType
            as_text = "int" if isinstance(inner, T.BooleanType) else "string"
            column = F.array_join(column.cast(f"array<{as_text}>").cast("array<string>"), ",", "null")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None):
    """Register a function ``(Tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, folder: publish(build(Tables(spark, folder)))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def sql(select: str, fixtures: list[str] | tuple[str, ...] = (), ctes: str = "") -> str:
    """Oracle text: the fixtures as CTEs, further CTEs, then the select."""
    parts = []
    for name in fixtures:
        text, bases = FIXTURES[name]
        for base in bases:
            text = text.replace(f"[{base}]", base)
        parts.append(f"{name} AS ({text.replace('<agg>', SQL_AGG)})")
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return (f"WITH {', '.join(parts)} " if parts else "") + select.strip()
