"""Schemas of the documented tables and of the window datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "boolean": T.BooleanType(),
    "smallint": T.ShortType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<double>": T.ArrayType(T.DoubleType()),
}


def _struct(text: str) -> T.StructType:
    """Schema from ``name type, ...``; needs no session, unlike Spark's own DDL reader."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_DAY_STRINGS = _struct("id_participant_external string, dt date, minute_level_str string")
RAW_SLEEP_STRINGS = _struct(
    "id_participant_external string, main_start_time timestamp_ntz, main_in_bed_minutes int, minute_level_str string"
)
MINUTE_ACTIVITY = _struct(
    "participant_id string, timestamp timestamp_ntz, date date, heart_rate smallint, steps smallint, "
    "missing_heart_rate boolean, missing_steps boolean, sleep_classic_0 boolean, sleep_classic_1 boolean, "
    "sleep_classic_2 boolean, sleep_classic_3 boolean"
)
DAY_ACTIVITY = _struct(
    "participant_id string, date date, resting_heart_rate double, body_temp_f double, main_in_bed_minutes double, "
    "main_efficiency double, nap_count double, total_asleep_minutes double, total_in_bed_minutes double, "
    "activityCalories double, caloriesOut double, caloriesBMR double, marginalCalories double, "
    "sedentaryMinutes double, lightlyActiveMinutes double, fairlyActiveMinutes double, veryActiveMinutes double, "
    "missing_hr double, missing_sleep double, missing_steps double, missing_day double"
)
LAB_RESULTS = _struct(
    "participant_id string, timestamp timestamp_ntz, trigger_datetime timestamp_ntz, test_name string, "
    "result string, first_report_yn boolean"
)
ILI_DAY_LABELS = _struct(
    "participant_id string, date date, event_number_v43 double, days_since_onset_v43 double, ILI_type double"
)
PARTICIPANT_DATES = _struct("participant_id string, date date")
LABEL_INTERVALS = _struct("participant_id string, start timestamp_ntz, end timestamp_ntz")
PREDICTIONS = _struct("participant_id string, date date, label int, pred double")
LOGIT_RESULTS = _struct("label int, logits array<double>")


def _narrow(data_type: T.DataType) -> T.DataType:
    return T.FloatType() if isinstance(data_type, T.DoubleType) else data_type


def window_schema(
    series: T.StructType, expected_length: int, rename: Mapping[str, str] | None = None, key: str = "participant_id"
) -> T.StructType:
    """Schema of the window dataset built from a series.

    Date and timestamp go, doubles narrow to floats, every channel becomes an
    array whose length is kept in the field's metadata.
    """
    rename = rename or {}
    fields = [T.StructField(key, T.StringType(), False)]
    for field in series.fields:
        name = rename.get(field.name, field.name)
        if name in ("date", "timestamp", key):
            continue
        fields.append(
            T.StructField(name, T.ArrayType(_narrow(field.dataType)), False, {"length": expected_length})
        )
    return T.StructType(
        [*fields, T.StructField("start", T.TimestampNTZType(), False), T.StructField("end", T.TimestampNTZType(), False),
         T.StructField("id", T.LongType(), False)]
    )


def pair_schema(windows: T.StructType) -> T.StructType:
    """Every field twice, with ``_l`` and ``_r``."""
    return T.StructType(
        [
            T.StructField(f.name + side, f.dataType, f.nullable, f.metadata)
            for f in windows.fields
            for side in ("_l", "_r")
        ]
    )


def narrow_doubles(df: DataFrame) -> DataFrame:
    """Double columns, also inside arrays, as floats."""
    casts = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DoubleType):
            casts[field.name] = F.col(field.name).cast("float")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.DoubleType):
            casts[field.name] = F.col(field.name).cast("array<float>")
    return df.withColumns(casts) if casts else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; ANSI casts reject values out of range."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata or {}) for f in schema.fields])


def check_lengths(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows as they are, failing at run time on an array of another length than declared."""
    checked = {}
    for field in schema.fields:
        length = (field.metadata or {}).get("length")
        if length is None:
            continue
        message = F.concat(
            F.lit(f"{field.name}: expected {length} values, got "), F.size(field.name).cast("string")
        )
        checked[field.name] = F.when(F.size(field.name) == length, F.col(field.name)).otherwise(
            F.raise_error(message).cast(df.schema[field.name].dataType)
        )
    return df.withColumns(checked) if checked else df
