"""Packed strings, gap filling, arrays, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.columns import local_timestamp, window_zscore
from pulsegrid.operators import reshape as R
from pulsegrid.operators.aggregate import unit_variance
from pulsegrid.operators.labels import rolling_day_vectors
from pulsegrid.plans.q_rows import _SEGMENTS
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.shared import (
    CHANNELS, FLAGS, HOUR, RAW, SERIES, SLOTS, WINDOWS, hourly_flags, hourly_observations, series_rows, week_windows,
)

_TOKENS = """
tokens AS (
    SELECT participant_id, dt, len(string_split(hour_level_str, ' ')) AS n,
        unnest(string_split(hour_level_str, ' ')) AS tok, generate_subscripts(string_split(hour_level_str, ' '), 1) AS i
    FROM fx_intraday
)"""


@query(
    "r1_explode_day_string",
    sql(
        """SELECT participant_id, CAST(CAST(dt AS TIMESTAMP) + to_hours(i - 1) AS VARCHAR) AS timestamp,
            least(CAST(tok AS DOUBLE), 200.0) AS value
        FROM (SELECT participant_id, dt, unnest(string_split(hour_level_str, ' ')) AS tok,
            generate_subscripts(string_split(hour_level_str, ' '), 1) AS i FROM fx_full_day)""",
        ["fx_full_day"],
    ),
)
def explode_day(t: Tables):
    return R.explode_day_string(t("fx_full_day"), "hour_level_str", "value", step_seconds=HOUR)


@query(
    "r1_explode_day_string_trim",
    sql(
        """SELECT participant_id, CAST(CAST(dt AS TIMESTAMP) + to_hours(i - 1) AS VARCHAR) AS timestamp,
            least(CAST(tok AS DOUBLE), 200.0) AS value,
            CAST(greatest(len(string_split(hour_level_str, ' ')) - 24, 0) AS INT) AS tokens_dropped
        FROM (SELECT *, unnest(string_split(hour_level_str, ' ')) AS tok,
            generate_subscripts(string_split(hour_level_str, ' '), 1) AS i FROM fx_intraday) WHERE i <= 24""",
        ["fx_intraday"],
    ),
)
def explode_day_trim(t: Tables):
    return R.explode_day_string(t("fx_intraday"), "hour_level_str", "value", step_seconds=HOUR, mode="trim")


@query(
    "r2_explode_session_string",
    sql(
        """SELECT participant_id,
            CAST(make_timestamp(CAST(round_even((epoch(CAST(dt AS TIMESTAMP)) + 30 * (n % 7)) / 60.0, 0) AS BIGINT) * 60000000)
                + to_minutes(i - 1) AS VARCHAR) AS timestamp,
            least(CAST(tok AS DOUBLE), 200.0) AS value FROM tokens""",
        ["fx_intraday"], _TOKENS,
    ),
)
def explode_session(t: Tables):
    n = F.size(F.split("hour_level_str", " "))
    sessions = t("fx_intraday").select(
        "participant_id", "hour_level_str", n.alias("main_in_bed_minutes"),
        (F.col("dt").cast("timestamp_ntz") + F.make_dt_interval(secs=30 * (n % 7))).alias("main_start_time"),
    )
    return R.explode_session_string(
        sessions, "hour_level_str", "value", start_col="main_start_time", slots_col="main_in_bed_minutes"
    )


@query(
    "r3_explode_constant",
    sql(
        """SELECT id_participant_external, CAST(timestamp AS VARCHAR) AS timestamp, sleep_classic FROM (
            SELECT id_participant_external, sleep_classic,
                make_timestamp((startTimeInSeconds + startTimeOffsetInSeconds) * 1000000)
                + to_minutes(unnest(range(0, CAST(ceil((endTimeInSeconds - startTimeInSeconds) / 60.0) AS BIGINT)))) AS timestamp
            FROM segments)""",
        ["fx_garmin_sleep"],
        # Starts lie on whole minutes after rounding half to even.
        _SEGMENTS.replace("s.startTimeInSeconds,", "CAST(round_even(s.startTimeInSeconds / 60.0, 0) AS BIGINT) * 60 AS startTimeInSeconds,").replace(
            "s.endTimeInSeconds,",
            "s.endTimeInSeconds + CAST(round_even(s.startTimeInSeconds / 60.0, 0) AS BIGINT) * 60 - s.startTimeInSeconds AS endTimeInSeconds,",
        ),
    ),
)
def explode_constant(t: Tables):
    segments = R.flatten_sleep_levels(t("fx_garmin_sleep")).withColumn(
        "start", local_timestamp("startTimeInSeconds", "startTimeOffsetInSeconds")
    ).withColumn("seconds", F.col("endTimeInSeconds") - F.col("startTimeInSeconds"))
    return R.explode_constant(
        segments, "sleep_classic", start_col="start", seconds_col="seconds", key="id_participant_external"
    )


@query(
    "r4_last_per_slot",
    sql(
        """SELECT participant_id, CAST(timestamp AS VARCHAR) AS timestamp, coalesce(heart_rate, -1) AS heart_rate,
            coalesce(steps, -1) AS steps, coalesce(sleep_classic, -1) AS sleep_classic FROM slots""",
        RAW, SLOTS,
    ),
)
def last_per_slot(t: Tables):
    return hourly_observations(t).fillna(-1)


@query(
    "r5_gap_filled_spine",
    sql(
        "SELECT participant_id, CAST(timestamp AS VARCHAR) AS timestamp, heart_rate, steps, "
        + ", ".join(f"CAST({c} AS INT) AS {c}" for c in CHANNELS[2:])
        + " FROM series",
        RAW, SERIES,
    ),
)
def gap_filled_spine(t: Tables):
    return series_rows(t).drop("date")


@query(
    "r6_flatten_stage_map",
    sql(
        """SELECT id_participant_external, event_id, sleep_type, startTimeInSeconds AS start_s, endTimeInSeconds AS end_s, sleep_classic
        FROM segments""",
        ["fx_garmin_sleep"], _SEGMENTS,
    ),
)
def flatten_stage_map(t: Tables):
    return R.flatten_sleep_levels(t("fx_garmin_sleep")).select(
        "id_participant_external", "event_id", "sleep_type", F.col("startTimeInSeconds").alias("start_s"),
        F.col("endTimeInSeconds").alias("end_s"), "sleep_classic",
    )


@query(
    "r7_event_date_expansion",
    sql(
        """SELECT participant_id, test_name, CAST(CAST(unnest(generate_series(CAST(trigger_datetime AS DATE) + 1, CAST(trigger_datetime AS DATE) + 5, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date
        FROM fx_lab_results""",
        ["fx_lab_results"],
    ),
)
def event_date_expansion(t: Tables):
    return R.expand_event_dates(t("fx_lab_results"), F.col("trigger_datetime").cast("date"), -1, 5).select(
        "participant_id", "test_name", "date"
    )


@query(
    "r8_ordered_channel_arrays",
    sql(
        """SELECT participant_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date,
            string_agg(CAST(steps AS VARCHAR), ',' ORDER BY timestamp) AS steps,
            string_agg(CAST(CAST(missing_heart_rate AS INT) AS VARCHAR), ',' ORDER BY timestamp) AS missing_heart_rate
        FROM flags GROUP BY participant_id, CAST(timestamp AS DATE)""",
        RAW, FLAGS,
    ),
)
def ordered_channel_arrays(t: Tables):
    return R.day_pages(hourly_flags(t), ["steps", "missing_heart_rate"])


@query(
    "r9_stack_channels",
    sql(
        """SELECT participant_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS n_slots,
            sum(steps * (1 + 2 * slot)) + sum(CAST(missing_steps AS INT) * (2 + 2 * slot)) AS checksum
        FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, CAST(timestamp AS DATE) ORDER BY timestamp) - 1 AS slot FROM flags)
        GROUP BY participant_id, CAST(timestamp AS DATE)""",
        RAW, FLAGS,
    ),
)
def stack_channels(t: Tables):
    pages = R.day_pages(hourly_flags(t).withColumn("missing_steps", F.col("missing_steps").cast("int")), ["steps", "missing_steps"])
    flat = R.flatten_matrix(R.stack_channels(pages, ["steps", "missing_steps"]))
    weighted = F.aggregate(
        F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda acc, x: acc + x
    )
    return flat.select(
        "participant_id", "date", F.size("inputs").cast("bigint").alias("n_slots"), weighted.cast("bigint").alias("checksum")
    )


@query(
    "r11_window_zscore",
    sql(
        """SELECT participant_id, CAST("end" AS VARCHAR) AS "end", round(sum(abs(z)), 6) AS sum_abs_z, round(max(z), 6) AS max_z FROM (
            SELECT w.participant_id, w."end", CASE WHEN stddev_pop(s.heart_rate) OVER p = 0 THEN s.heart_rate
                ELSE (s.heart_rate - avg(s.heart_rate) OVER p) / stddev_pop(s.heart_rate) OVER p END AS z
            FROM windows w JOIN series s ON w.participant_id = s.participant_id AND s.date BETWEEN w.date - 6 AND w.date
            WINDOW p AS (PARTITION BY w.participant_id, w."end"))
        GROUP BY participant_id, "end" """,
        RAW, WINDOWS,
    ),
)
def zscored_windows(t: Tables):
    z = week_windows(t, ["heart_rate"]).select("participant_id", "end", window_zscore("heart_rate").alias("z"))
    total = F.aggregate("z", F.lit(0.0).cast("double"), lambda acc, x: acc + F.abs(x))
    return z.select("participant_id", "end", F.round(total, 6).alias("sum_abs_z"), F.round(F.array_max("z"), 6).alias("max_z"))


@query(
    "r12_rolling_vectors",
    sql(
        """SELECT a.participant_id, CAST(a.date AS VARCHAR) AS date, count(*) AS n_days,
            string_agg(CAST(CAST(b.nap_count AS BIGINT) AS VARCHAR) || ',' || CAST(b.missing_hr AS VARCHAR), ',' ORDER BY b.date) AS features
        FROM fx_day_level a JOIN fx_day_level b ON a.participant_id = b.participant_id AND b.date BETWEEN a.date - 2 AND a.date
        GROUP BY a.participant_id, a.date HAVING count(*) = 3""",
        ["fx_day_level"],
    ),
)
def rolling_vectors(t: Tables):
    vectors = rolling_day_vectors(t("fx_day_level"), ["nap_count", "missing_hr"], days=3)
    return vectors.select(
        "participant_id", "date", F.lit(3).cast("bigint").alias("n_days"),
        F.col("features").cast("array<bigint>").alias("features"),
    )


@query(
    "r13_melt",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, variable, value FROM (
            UNPIVOT (SELECT participant_id, date, resting_heart_rate, "caloriesOut" FROM fx_day_level)
            ON resting_heart_rate, "caloriesOut" INTO NAME variable VALUE value)""",
        ["fx_day_level"],
    ),
)
def melt(t: Tables):
    return R.melt(t("fx_day_level"), ["participant_id", "date"], ["resting_heart_rate", "caloriesOut"])


@query(
    "r14_pivot",
    sql(
        """SELECT classifier_name, round(avg(accuracy) FILTER (dataset_name = 'A-F'), 9) AS "A-F",
            round(avg(accuracy) FILTER (dataset_name = 'N-O'), 9) AS "N-O", round(avg(accuracy) FILTER (dataset_name = 'R-F'), 9) AS "R-F"
        FROM fx_metrics GROUP BY classifier_name""",
        ["fx_metrics"],
    ),
)
def pivot(t: Tables):
    names = ["A-F", "N-O", "R-F"]
    wide = R.pivot_table(t("fx_metrics"), ["classifier_name"], "dataset_name", "accuracy", names)
    return wide.select("classifier_name", *[F.round(F.col(f"`{n}`"), 9).alias(n) for n in names])


@query(
    "r15_row_best",
    sql(
        """SELECT classifier_name, dataset_name, CAST(rounded = max(rounded) OVER (PARTITION BY dataset_name) AS INT) AS is_best
        FROM (SELECT *, round(accuracy, 9) AS rounded FROM fx_metrics)""",
        ["fx_metrics"],
    ),
)
def row_best(t: Tables):
    rounded = t("fx_metrics").withColumn("accuracy", F.round("accuracy", 9))
    return R.mark_best(rounded, "accuracy", ["dataset_name"]).select("classifier_name", "dataset_name", "is_best")


@query(
    "a7_unit_variance",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date,
            round(resting_heart_rate / (SELECT stddev_samp(resting_heart_rate) FROM fx_day_level), 6) AS resting_heart_rate,
            round("caloriesOut" / (SELECT stddev_samp("caloriesOut") FROM fx_day_level), 6) AS "caloriesOut" FROM fx_day_level""",
        ["fx_day_level"],
    ),
)
def scaled(t: Tables):
    columns = ["resting_heart_rate", "caloriesOut"]
    df = unit_variance(t("fx_day_level"), columns)
    return df.select("participant_id", "date", *[F.round(c, 6).alias(c) for c in columns])
