"""Profiles, downsampling, sliding windows and day features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.columns import day_of, epoch_seconds
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import labels as L
from pulsegrid.operators.day_features import ALL_FEATURES, FEATURE_CHANNELS, day_features
from pulsegrid.operators.ordered import day_islands, exact_quantile, streak_sizes
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.shared import CHANNELS, RAW, SERIES, WINDOWS, series_rows, week_windows


@query(
    "a1_participant_dates",
    sql("SELECT DISTINCT participant_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date FROM fx_activity_raw", RAW),
)
def distinct_dates(t: Tables):
    return A.participant_dates(t("fx_activity_raw").withColumn("date", day_of("timestamp")))


@query(
    "a2_tumbling_downsample",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, CAST(time_bucket(INTERVAL 6 HOUR, timestamp) AS VARCHAR) AS timestamp,
            quantile_disc(heart_rate, 0.5) AS heart_rate, quantile_disc(steps, 0.5) AS steps, """
        + ", ".join(f"CAST(bool_or({c}) AS INT) AS {c}" for c in CHANNELS[2:])
        + " FROM series GROUP BY participant_id, date, time_bucket(INTERVAL 6 HOUR, timestamp)",
        RAW, SERIES,
    ),
)
def tumbling_downsample(t: Tables):
    return A.downsample(series_rows(t), "6 hours")


@query(
    "a3_sliding_windows",
    sql(
        """SELECT w.participant_id, CAST(w.start AS VARCHAR) AS start, CAST(w."end" AS VARCHAR) AS "end",
            string_agg(CAST(s.heart_rate AS VARCHAR), ',' ORDER BY s.timestamp) AS heart_rate,
            string_agg(CAST(s.steps AS VARCHAR), ',' ORDER BY s.timestamp) AS steps
        FROM windows w JOIN series s ON w.participant_id = s.participant_id AND s.date BETWEEN w.date - 6 AND w.date
        GROUP BY w.participant_id, w.start, w."end" """,
        RAW, WINDOWS,
    ),
)
def sliding_windows(t: Tables):
    return week_windows(t).drop("id")


_IS_FLU = "result = 'Detected' AND test_name IN ('Influenza A (Flu A)', 'Influenza B (Flu B)')"


@query(
    "a4_any_by_day",
    sql(
        f"""SELECT participant_id, CAST(CAST(trigger_datetime AS DATE) AS VARCHAR) AS date, CAST(bool_or({_IS_FLU}) AS INT) AS is_pos
        FROM fx_lab_results GROUP BY participant_id, CAST(trigger_datetime AS DATE)""",
        ["fx_lab_results"],
    ),
)
def any_by_day(t: Tables):
    is_flu = (F.col("result") == L.POSITIVE) & F.col("test_name").isin(*L.FLU_TESTS)
    return A.any_by_day(t("fx_lab_results").select("participant_id", day_of("trigger_datetime").alias("date"), is_flu.alias("is_pos")), "is_pos")


@query(
    "a5_three_valued_any",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, coalesce(max(is_pos) OVER (PARTITION BY participant_id, g), -1) AS run_pos FROM merged""",
        ["fx_surveys", "fx_lab_results"],
        """days AS (SELECT DISTINCT participant_id, CAST(timestamp AS DATE) AS date FROM fx_surveys),
        islands AS (SELECT participant_id, date, date - CAST(row_number() OVER (PARTITION BY participant_id ORDER BY date) AS INT) AS g FROM days),
        labs AS (SELECT participant_id, CAST(trigger_datetime AS DATE) AS date, max(CAST(result = 'Detected' AS INT)) AS is_pos
            FROM fx_lab_results GROUP BY participant_id, CAST(trigger_datetime AS DATE)),
        merged AS (SELECT i.participant_id, i.date, i.g, l.is_pos FROM islands i LEFT JOIN labs l USING (participant_id, date))""",
    ),
)
def three_valued_any(t: Tables):
    islands = day_islands(t("fx_surveys").withColumn("date", day_of("timestamp")), "participant_id", "date")
    labs = t("fx_lab_results").groupBy("participant_id", day_of("trigger_datetime").alias("date")).agg(
        F.max((F.col("result") == L.POSITIVE).cast("int")).alias("is_pos")
    )
    merged = islands.join(labs, ["participant_id", "date"], "left")
    spread = A.spread_any(merged, "is_pos", ["participant_id", "island"], "run_pos")
    return spread.select("participant_id", "date", F.coalesce("run_pos", F.lit(-1)).alias("run_pos"))


@query(
    "a6_table_zscore",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date,
            round((resting_heart_rate - (SELECT avg(resting_heart_rate) FROM fx_day_level)) / (SELECT stddev_samp(resting_heart_rate) FROM fx_day_level), 6) AS resting_heart_rate,
            round((nap_count - (SELECT avg(nap_count) FROM fx_day_level)) / (SELECT stddev_samp(nap_count) FROM fx_day_level), 6) AS nap_count
        FROM fx_day_level""",
        ["fx_day_level"],
    ),
)
def table_zscore(t: Tables):
    columns = ["resting_heart_rate", "nap_count"]
    scaled = A.zscore_columns(t("fx_day_level"), columns)
    return scaled.select("participant_id", "date", *[F.round(c, 6).alias(c) for c in columns])


@query(
    "a8_profile",
    """SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_participants,
        round(epoch(quantile_cont(ts, 0.5)), 3) AS median_epoch FROM events GROUP BY event_type""",
)
def profile(t: Tables):
    events = t("events").withColumn("seconds", epoch_seconds("ts").cast("double"))
    counts = events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_participants")
    )
    median = exact_quantile(events, "seconds", 0.5, ["event_type"], "median_epoch")
    return counts.join(median, "event_type").withColumn("median_epoch", F.round("median_epoch", 3))


@query("a9_class_balance", sql("SELECT label, count(*) AS support FROM fx_predictions GROUP BY label", ["fx_predictions"]))
def class_balance(t: Tables):
    return A.class_balance(t("fx_predictions"))


@query(
    "a10_completed_benchmarks",
    sql(
        """SELECT classifier_name, dataset_name FROM runs WHERE classifier_name IN (
            SELECT classifier_name FROM runs GROUP BY classifier_name HAVING count(*) = (
                SELECT max(n) FROM (SELECT count(*) AS n FROM runs GROUP BY classifier_name)))""",
        ctes="""runs AS (SELECT DISTINCT concat('model_', CAST(l_linenumber AS VARCHAR)) AS classifier_name, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS dataset_name
            FROM lineitem)""",
    ),
)
def completed_benchmarks(t: Tables):
    """Line numbers as models and shipping days as datasets: no model has them all, and few have the most."""
    runs = t("lineitem").select(
        F.concat(F.lit("model_"), F.col("l_linenumber").cast("string")).alias("classifier_name"), F.col("l_shipdate").cast("date").cast("string").alias("dataset_name")
    ).distinct()
    return A.completed_benchmarks(runs)


# --- day features, one query each --------------------------------------------

_STREAKS = (
    SERIES
    + """, marked AS (
    SELECT participant_id, date, timestamp,
        CASE WHEN (steps = 0) = lead(steps = 0) OVER (PARTITION BY participant_id, date ORDER BY timestamp) THEN 0 ELSE 1 END AS change
    FROM series
), runs AS (
    SELECT participant_id, date, sum(change) OVER (PARTITION BY participant_id, date ORDER BY timestamp) AS streak FROM marked
), streaks AS (
    SELECT participant_id, date, streak, count(*) AS streak_size FROM runs GROUP BY participant_id, date, streak
)"""
)
_REST = "FILTER (steps = 0 AND NOT missing_steps)"
_FEATURE_SQL = {
    "resting_hr_95th_percentile": ("series", f"quantile_cont(heart_rate, 0.95) {_REST}"),
    "resting_hr_50th_percentile": ("series", f"quantile_cont(heart_rate, 0.5) {_REST}"),
    "resting_hr_std": ("series", f"stddev_samp(heart_rate) {_REST}"),
    "hr_awake_95th_percentile": ("series", "quantile_cont(heart_rate, 0.95) FILTER (sleep_classic_0)"),
    "steps_moving_streak_95th_percentile": ("streaks", "quantile_cont(streak_size, 0.95)"),
    "steps_moving_streak_50th_percentile": ("streaks", "quantile_cont(streak_size, 0.5)"),
    "total_steps": ("series", "CAST(sum(steps) AS DOUBLE)"),
    "sleep_minutes": ("series", "CAST(count(*) FILTER (sleep_classic_2) AS DOUBLE)"),
    "in_bed_minutes": ("series", "CAST(count(*) FILTER (sleep_classic_1) AS DOUBLE)"),
    "missing_hr": ("series", "CAST(bool_and(missing_heart_rate) AS DOUBLE)"),
    "missing_steps": ("series", "CAST(bool_and(missing_steps) AS DOUBLE)"),
    "missing_sleep": ("series", "CAST(bool_and(sleep_classic_0) AS DOUBLE)"),
}


def _register_feature(number: int, name: str) -> None:
    source, expression = _FEATURE_SQL[name]
    oracle = sql(
        f"""SELECT participant_id, date, round({name}, 6) AS {name} FROM (
            SELECT participant_id, CAST(date AS VARCHAR) AS date, {expression} AS {name} FROM {source} GROUP BY participant_id, date)
        WHERE {name} IS NOT NULL""",
        RAW, _STREAKS,
    )

    @query(f"f{number}_{name}", oracle)
    def build(t: Tables):
        return day_features(series_rows(t, FEATURE_CHANNELS[name]), [name]).select("participant_id", "date", F.round(name, 6).alias(name))


for _i, _name in enumerate(_FEATURE_SQL, start=1):
    _register_feature(_i, _name)
assert set(_FEATURE_SQL) == set(ALL_FEATURES)


@query(
    "w1_run_detection",
    sql(
        "SELECT participant_id, CAST(date AS VARCHAR) AS date, CAST(streak AS BIGINT) AS streak, streak_size FROM streaks",
        RAW, _STREAKS,
    ),
)
def run_detection(t: Tables):
    return streak_sizes(series_rows(t, ["steps"]), ["participant_id", "date"], "timestamp", F.col("steps") == 0)


