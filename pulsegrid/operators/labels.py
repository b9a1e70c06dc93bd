"""Labelers: event tables to label tables ``(participant_id, date, label)``.

A labeler is a DataFrame to DataFrame function. ``joins.lookup_labels`` attaches
its result to windows; the distinct keys of the result are its positive keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.clause import clause
from pulsegrid.functions.columns import body_mass_over, day_of, last_token_timestamp, weekday_in
from pulsegrid.operators.filters import cut_dates
from pulsegrid.operators.joins import asof_backward
from pulsegrid.operators.ordered import day_islands, keep_last, rolling_days
from pulsegrid.operators.reshape import expand_event_dates

KEY = ["participant_id", "date"]

# The two influenza tests of the lab panel.
FLU_TESTS = ("Influenza A (Flu A)", "Influenza B (Flu B)")
POSITIVE = "Detected"

# The day-level activity columns of the feature vector, in order.
DAY_FEATURE_COLUMNS = (
    "resting_heart_rate", "main_in_bed_minutes", "main_efficiency", "nap_count", "total_asleep_minutes",
    "total_in_bed_minutes", "activityCalories", "caloriesOut", "caloriesBMR", "marginalCalories",
    "sedentaryMinutes", "lightlyActiveMinutes", "fairlyActiveMinutes", "veryActiveMinutes",
    "missing_hr", "missing_sleep", "missing_steps", "missing_day",
)


def read_labs(
    labs: DataFrame, min_date: str | None = None, max_date: str | None = None, positive_only: bool = False,
    ts_col: str = "timestamp",
) -> DataFrame:
    labs = cut_dates(labs, ts_col, min_date, max_date)
    return labs.where(F.col("result") == POSITIVE) if positive_only else labs


def positive_keys(labels: DataFrame) -> DataFrame:
    return labels.select(*KEY).distinct()


def flu_positive(labs: DataFrame, onset_min: int = 0, onset_max: int = 0) -> DataFrame:
    """Days around a detected influenza test."""
    hits = labs.where((F.col("result") == POSITIVE) & F.col("test_name").isin(*FLU_TESTS))
    days = hits.select("participant_id", day_of("trigger_datetime").alias("_d")).distinct()
    return expand_event_dates(days, F.col("_d"), onset_min, onset_max).select(*KEY).distinct().withColumn(
        "label", F.lit(1)
    )


def survey_clause(surveys: DataFrame, text: str, order_cols: Sequence[str] = ("response_id",)) -> DataFrame:
    """Days whose last survey response satisfies the clause."""
    dated = surveys.withColumn("date", day_of("timestamp"))
    last = keep_last(dated, KEY, order_cols)
    return last.where(clause(text)).select(*KEY, F.lit(1).alias("label"))


def ili_window(ili: DataFrame, types: Sequence[int] = (1, 2, 3), onset_min: int = -1, onset_max: int = 5) -> DataFrame:
    """Days of the listed illness types at a signed distance from onset within the range."""
    return (
        ili.where(F.col("ILI_type").isin(*[float(t) for t in types]))
        .where(F.col("days_since_onset_v43").isin(*[float(d) for d in range(onset_min, onset_max + 1)]))
        .select(*KEY).distinct().withColumn("label", F.lit(1))
    )


def diagnosis_date(diagnoses: DataFrame, date_col: str = "covid_diagnosis_dates") -> DataFrame:
    return diagnoses.select("participant_id", day_of(date_col).alias("date")).where(
        F.col("date").isNotNull()
    ).distinct().withColumn("label", F.lit(1))


def lab_survey_positive(
    labs: DataFrame, weekly: DataFrame, onset_min: int = 0, onset_max: int = 0, tolerance_days: int = 7
) -> DataFrame:
    """Days around the kit completion that precedes a positive lab result."""
    completed = weekly.withColumn("date_completed", last_token_timestamp("date_of_test_kit_completion")).where(
        F.col("date_completed").isNotNull()
    )
    matched = asof_backward(
        labs.where(F.col("result") == "Positive"), completed, key="id_participant_external",
        left_ts="date_received", right_ts="date_completed", right_cols=["survey_id"], tie_col="survey_id",
        tolerance_days=tolerance_days,
    )
    days = matched.where(F.col("date_completed").isNotNull()).select(
        F.col("id_participant_external").alias("participant_id"), day_of("date_completed").alias("_d")
    ).distinct()
    return expand_event_dates(days, F.col("_d"), onset_min, onset_max).select(*KEY).distinct().withColumn(
        "label", F.lit(1)
    )


def weekday_label(windows: DataFrame, weekdays: Sequence[int] = (5, 6), date_col: str = "date") -> DataFrame:
    """Windows with 1 where their last day is one of the weekdays (Monday = 0)."""
    return windows.withColumn("label", weekday_in(date_col, weekdays).cast("int"))


def obesity(screener: DataFrame, order_cols: Sequence[str] = ("response_id",)) -> DataFrame:
    """(participant_id, label) from the last screener of each person."""
    last = keep_last(screener, ["participant_id"], order_cols)
    return last.select(
        "participant_id", body_mass_over("weight", "height__ft", "height__in").cast("int").alias("label")
    )


def default_day_vector(columns: Sequence[str], days: int) -> list[float]:
    """0 for each value and 1 for each missing flag, in the order of the columns, repeated per day."""
    return [float("missing" in c) for c in columns] * days


def rolling_day_vectors(day_level: DataFrame, columns: Sequence[str] = DAY_FEATURE_COLUMNS, days: int = 7) -> DataFrame:
    """(participant, day, features): the vectors of ``days`` consecutive days, oldest first."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    daily = day_level.select(*KEY, vector.alias("vector"))
    framed = rolling_days(daily, "participant_id", "date", ["vector"], days)
    return framed.where(F.size("frame") == days).select(*KEY, F.flatten(F.col("frame.vector")).alias("features"))


def clean_annotation(surveys: DataFrame, labs: DataFrame, onset_min: int = 0, onset_max: int = 0) -> DataFrame:
    """Days whose survey answers lack a lab result: label 0, every other day counts as 1.

    A lab result is shared within the participant's run of consecutive survey
    days. A response is unresolved when it reports flu and its run has no
    result, or when it does not say.
    """
    dated = surveys.withColumn("date", day_of("timestamp"))
    islands = day_islands(dated, "participant_id", "date")
    is_flu = (F.col("result") == POSITIVE) & F.col("test_name").isin(*FLU_TESTS)
    results = (
        labs.withColumn("date", day_of("trigger_datetime"))
        .groupBy(*KEY, "first_report_yn").agg(F.max(is_flu).alias("is_pos"))
    )
    responses = (
        dated.groupBy(*KEY, "first_report_yn", "have_flu").agg(F.count(F.lit(1)).alias("_n"))
        .join(results, [*KEY, "first_report_yn"], "left").join(islands, KEY)
    )
    per_run = responses.groupBy("participant_id", "island").agg(F.max("is_pos").alias("run_pos"))
    resolved = ((F.col("have_flu") == 1) & F.col("run_pos").isNotNull()) | (F.col("have_flu") == 0)
    unresolved = responses.join(per_run, ["participant_id", "island"]).where(~F.coalesce(resolved, F.lit(False)))
    days = unresolved.select("participant_id", F.col("date").alias("_d")).distinct()
    return expand_event_dates(days, F.col("_d"), onset_min, onset_max).select(*KEY).distinct().withColumn(
        "label", F.lit(0)
    )


# --- pair labels -------------------------------------------------------------


def same_participant() -> Column:
    return (F.col("participant_id_l") == F.col("participant_id_r")).cast("int")


def sequential() -> Column:
    """Same participant and the right window starts within a day after the left one ends."""
    end, start = F.col("end_l"), F.col("start_r")
    follows = (start >= end) & (start < end + F.make_dt_interval(days=F.lit(1)))
    return ((F.col("participant_id_l") == F.col("participant_id_r")) & follows).cast("int")
