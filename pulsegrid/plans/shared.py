"""Series and windows that many queries start from, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import minute_flags
from pulsegrid.operators.aggregate import sliding_windows
from pulsegrid.operators.reshape import gap_filled_pages, last_per_slot, pages_to_rows, spine_defaults
from pulsegrid.plans.registry import Tables

HOUR = 3600
CHANNELS = [
    "heart_rate", "steps", "missing_heart_rate", "missing_steps",
    "sleep_classic_0", "sleep_classic_1", "sleep_classic_2", "sleep_classic_3",
]
WINDOW_DAYS = 7


def hourly_observations(t: Tables) -> DataFrame:
    """Last observation per participant and hour, raw channels."""
    return last_per_slot(
        t("fx_activity_raw"), ["heart_rate", "steps", "sleep_classic"], ["timestamp", "event_id"], step_seconds=HOUR
    )


def hourly_flags(t: Tables) -> DataFrame:
    flags = minute_flags()
    return hourly_observations(t).select("participant_id", "timestamp", *[c.alias(n) for n, c in flags.items()])


def series_pages(t: Tables, channels: list[str] | None = None) -> DataFrame:
    """Gap-filled hourly series as day pages; an unknown heart rate is 0. Only the named channels travel."""
    observed = hourly_flags(t).withColumn("heart_rate", F.coalesce("heart_rate", F.lit(0)))
    defaults = spine_defaults()
    return gap_filled_pages(observed, {c: defaults[c] for c in channels or CHANNELS}, step_seconds=HOUR)


def series_rows(t: Tables, channels: list[str] | None = None) -> DataFrame:
    return pages_to_rows(series_pages(t, channels), channels or CHANNELS, step_seconds=HOUR)


def week_windows(t: Tables, channels: list[str] | None = None) -> DataFrame:
    channels = channels or ["heart_rate", "steps"]
    return sliding_windows(series_pages(t, channels), channels, WINDOW_DAYS, 24)


def window_keys(t: Tables) -> DataFrame:
    """participant_id, start, end and a readable window id."""
    keys = sliding_windows(series_pages(t, ["heart_rate"]), [], WINDOW_DAYS, 24, counted="heart_rate")
    return keys.select(
        "participant_id", "start", "end",
        F.concat("participant_id", F.lit(":"), F.date_sub(F.col("end").cast("date"), 1).cast("string")).alias("id"),
    )


# --- SQL counterparts, to be used in this order as CTEs ----------------------

SLOTS = """
slots AS (
    SELECT participant_id, date_trunc('hour', timestamp) AS timestamp, heart_rate, steps, sleep_classic
    FROM fx_activity_raw
    QUALIFY row_number() OVER (
        PARTITION BY participant_id, date_trunc('hour', timestamp) ORDER BY fx_activity_raw.timestamp DESC, event_id DESC) = 1
)"""

FLAGS = (
    SLOTS
    + """, flags AS (
    SELECT participant_id, timestamp, heart_rate, coalesce(steps, 0) AS steps,
        heart_rate IS NULL OR heart_rate = 0 AS missing_heart_rate, steps IS NULL AS missing_steps,
        coalesce(sleep_classic, 0) = 0 AS sleep_classic_0, coalesce(sleep_classic, 0) = 1 AS sleep_classic_1,
        coalesce(sleep_classic, 0) = 2 AS sleep_classic_2, coalesce(sleep_classic, 0) = 3 AS sleep_classic_3
    FROM slots
)"""
)

SERIES = (
    FLAGS
    + """, spine AS (
    SELECT participant_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
    FROM flags GROUP BY participant_id
), series AS (
    SELECT s.participant_id, CAST(s.timestamp AS DATE) AS date, s.timestamp,
        coalesce(f.heart_rate, 0) AS heart_rate, coalesce(f.steps, 0) AS steps,
        coalesce(f.missing_heart_rate, true) AS missing_heart_rate, coalesce(f.missing_steps, true) AS missing_steps,
        coalesce(f.sleep_classic_0, false) AS sleep_classic_0, coalesce(f.sleep_classic_1, false) AS sleep_classic_1,
        coalesce(f.sleep_classic_2, false) AS sleep_classic_2, coalesce(f.sleep_classic_3, false) AS sleep_classic_3
    FROM spine s LEFT JOIN flags f ON s.participant_id = f.participant_id AND s.timestamp = f.timestamp
)"""
)

WINDOWS = (
    SERIES
    + """, day_counts AS (
    SELECT participant_id, date, count(heart_rate) AS n FROM series GROUP BY participant_id, date
), windows AS (
    SELECT a.participant_id, a.date, CAST(a.date - 6 AS TIMESTAMP) AS start, CAST(a.date + 1 AS TIMESTAMP) AS "end",
        concat(a.participant_id, ':', CAST(a.date AS VARCHAR)) AS id
    FROM day_counts a JOIN day_counts b
        ON a.participant_id = b.participant_id AND b.date BETWEEN a.date - 6 AND a.date
    GROUP BY a.participant_id, a.date HAVING sum(b.n) = 168
)"""
)

RAW = ["fx_activity_raw"]
