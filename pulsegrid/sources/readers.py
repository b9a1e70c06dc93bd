"""Scans with the typing rules of the survey and device exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.schemas import PARTICIPANT_DATES

ID_COLUMNS = ("participant_id", "id_participant_external")


def read_parquet(spark: SparkSession, path: str | Sequence[str], merge_schema: bool = False) -> DataFrame:
    """Parquet path, glob, list of paths or partitioned directory."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Ids stay text; columns named like dates or times are parsed.

    Without a schema the cells are read as text, and one pass over them finds
    the types of all columns (:func:`with_types`).
    """
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    return with_types(spark.read.csv(path, header=True))


#: Types a column of text may have, the narrowest first, and what a cell must be to fit.
_CELL_TYPES = {
    "int": "try_cast({c} AS int) IS NOT NULL",
    "bigint": "try_cast({c} AS bigint) IS NOT NULL",
    "double": "try_cast({c} AS double) IS NOT NULL",
    "boolean": "lower({c}) IN ('true', 'false')",
}


def with_types(text: DataFrame) -> DataFrame:
    """``text``, whose columns are text, with the narrowest types that hold all cells.

    A column whose name contains "date" or "time" becomes a timestamp if every
    cell parses and stays text otherwise; ids stay text; other columns become
    int, bigint, double or boolean if every cell fits. A column of nulls stays
    text. One aggregate of one row decides for all columns: flags per column
    that merge with "and", so the rows are read once and nothing is shuffled.
    """
    names = {c: f"`{c}`" for c in text.columns if c not in ID_COLUMNS}
    tests = {c: {"timestamp_ntz": "try_to_timestamp({c}) IS NOT NULL"} if "date" in c or "time" in c else _CELL_TYPES for c in names}
    fits = [f"bool_and({test.format(c=q)}) FILTER (WHERE {q} IS NOT NULL)" for c, q in names.items() for test in tests[c].values()]
    if not fits:
        return text
    found = iter(text.selectExpr(f"array({', '.join(fits)}) AS fits").first().fits)
    kinds = {c: [kind for kind in tests[c] if next(found)] for c in names}

    def typed(c: str) -> str:
        if not kinds.get(c):
            return f"`{c}`"
        kind = kinds[c][0]
        return f"cast({f'try_to_timestamp(`{c}`)' if kind == 'timestamp_ntz' else f'`{c}`'} AS {kind}) AS `{c}`"

    return text.selectExpr(*map(typed, text.columns))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema) if schema is not None else spark.read.json(path)


def read_participant_dates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PARTICIPANT_DATES)


def participant_dates_from_pairs(spark: SparkSession, pairs: Iterable[tuple[str, object]]) -> DataFrame:
    """A short hand-kept list of (participant, date) pairs."""
    return spark.createDataFrame([(str(p), d) for p, d in pairs], "participant_id string, date string").select(
        "participant_id", F.col("date").cast("date").alias("date")
    )
