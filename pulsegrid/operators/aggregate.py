"""Profiles, scaling, downsampling and window building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ordered import rolling_days
from pulsegrid.operators.reshape import day_pages

NUMERIC = (T.DoubleType, T.FloatType, T.ShortType, T.IntegerType, T.LongType)


def participant_dates(df: DataFrame, key: str = "participant_id", day: str = "date") -> DataFrame:
    return df.select(key, day).distinct()


def value_counts(df: DataFrame, column: str, alias: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(alias))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, the support of a classifier."""
    return value_counts(df, label, "support")


def downsample(
    df: DataFrame, width: str, *, key: str = "participant_id", ts_col: str = "timestamp"
) -> DataFrame:
    """Tumbling windows: lower median of numeric channels, any() of flags, other columns dropped.

    Both aggregates combine before the shuffle. Also runs on a streaming
    DataFrame that carries a watermark on ``ts_col``.
    """
    aggs: list[Column] = []
    for field in df.schema.fields:
        if field.name in (key, ts_col, "date"):
            continue
        if isinstance(field.dataType, NUMERIC):
            aggs.append(F.percentile_approx(field.name, 0.5).alias(field.name))
        elif isinstance(field.dataType, T.BooleanType):
            aggs.append(F.max(field.name).alias(field.name))
    grouped = df.groupBy(key, F.col(ts_col).cast("date").alias("date"), F.window(ts_col, width).alias("_w"))
    channels = [c for c in df.columns if c not in (key, ts_col, "date")]
    result = grouped.agg(*aggs)
    return result.select(
        key, "date", F.col("_w.start").alias(ts_col), *[c for c in channels if c in result.columns]
    )


def sliding_windows(
    pages: DataFrame, channels: Sequence[str], days: int, slots_per_day: int, *, key: str = "participant_id",
    counted: str | None = None,
) -> DataFrame:
    """Complete ``days``-day windows, one per day, with one array per channel.

    Works on day pages (see ``reshape.day_pages``): minutes are shuffled once
    into their day and only whole days take part in the sliding step, instead
    of every minute being copied into each window it belongs to. A window stays
    when the non-null values of ``counted`` (its first channel) number ``days *
    slots_per_day``; (participant, slot) is unique. ``end`` is exclusive.
    Without channels only the window keys are built and no array is shuffled.
    """
    # A window is complete when each of its days is, so other days stop here.
    counted = counted or channels[0]
    whole = F.size(F.filter(F.col(counted), lambda x: x.isNotNull())) == slots_per_day
    framed = rolling_days(pages.where(whole), key, "date", channels, days)
    end = F.date_add("date", 1).cast("timestamp_ntz")
    start = F.date_sub("date", days - 1).cast("timestamp_ntz")
    return framed.where(F.size("frame") == days).select(
        key, start.alias("start"), end.alias("end"), F.xxhash64(key, "date").alias("id"),
        *[F.flatten(F.col(f"frame.{c}")).alias(c) for c in channels],
    )


def sliding_windows_direct(
    df: DataFrame, channels: Sequence[str], days: int, expected: int, *, key: str = "participant_id",
    ts_col: str = "timestamp",
) -> DataFrame:
    """The same windows for a series whose step does not divide a day: each row is copied ``days`` times."""
    entries = F.sort_array(F.collect_list(F.struct(ts_col, *channels)))
    grouped = df.groupBy(key, F.window(ts_col, f"{days} days", "1 day").alias("_w")).agg(
        entries.alias("_e"), F.count(channels[0]).alias("_n")
    )
    return grouped.where(F.col("_n") == expected).select(
        key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"),
        F.xxhash64(key, F.date_sub(F.col("_w.end").cast("date"), 1)).alias("id"),
        *[F.col(f"_e.{c}").alias(c) for c in channels],
    )


def windows_from_series(
    df: DataFrame, channels: Sequence[str], days: int, step_seconds: int, *, key: str = "participant_id"
) -> DataFrame:
    """Sliding windows from rows with unique (participant, timestamp)."""
    if 86_400 % step_seconds:
        return sliding_windows_direct(df, channels, days, days * 86_400 // step_seconds, key=key)
    return sliding_windows(day_pages(df, channels, key=key), channels, days, 86_400 // step_seconds, key=key)


# --- scaling -----------------------------------------------------------------


def zscore_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole-table (x - mean) / sample std per column; the statistics are one scalar row."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
        ).alias("s")
    ).scalar()
    return df.withColumns({c: F.try_divide(F.col(c) - stats[f"m_{c}"], stats[f"s_{c}"]) for c in columns})


def unit_variance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every double column divided by its sample std, not centred; 0 where the std is 0."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)])
    stats = df.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in columns]).alias("s")).scalar()
    scaled = {
        c: F.when(stats[c] == 0, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise(F.try_divide(F.col(c), stats[c]))
        for c in columns
    }
    return df.withColumns(scaled)


# --- events ------------------------------------------------------------------


def any_by_day(df: DataFrame, flag: str, key: str = "participant_id", day: str = "date") -> DataFrame:
    return df.groupBy(key, day).agg(F.bool_or(flag).alias(flag))


def max_by_day(df: DataFrame, value: str, key: str = "participant_id", day: str = "date") -> DataFrame:
    return df.groupBy(key, day).agg(F.max(value).alias(value))


def spread_any(df: DataFrame, flag: str, groups: Sequence[str], alias: str) -> DataFrame:
    """Group-wise any() given back to the rows: null only where every row of the group is null."""
    groups = list(groups)
    known = df.groupBy(*groups).agg(F.max(flag).alias(alias))
    return df.join(known, groups).select(*df.columns, alias)


def completed_benchmarks(df: DataFrame, model: str = "classifier_name") -> DataFrame:
    """Rows of the models that were run on the largest number of datasets."""
    counts = df.groupBy(model).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).scalar()
    return df.join(counts.where(F.col("_n") == most).select(model), model, "left_semi")
