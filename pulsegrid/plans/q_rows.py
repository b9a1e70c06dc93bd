"""Scans, filters, predicates and row-wise expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.clause import clause
from pulsegrid.functions.columns import (
    body_mass_over, clip, day_of, epoch_nanos_to_ts, label_date, last_token_timestamp, local_timestamp,
    minute_flags, numeric_or, remap, sleep_one_hot, softmax_last, weekday_in, SLEEP_STAGE_CLASS,
)
from pulsegrid.operators import filters as P
from pulsegrid.operators.labels import read_labs
from pulsegrid.operators.ordered import keep_last
from pulsegrid.operators.reshape import flatten_matrix, flatten_sleep_levels, stack_channels
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.shared import FLAGS, RAW, WINDOWS, hourly_flags, hourly_observations, week_windows, window_keys
from pulsegrid.sources.readers import with_types


@query("s1_parquet_scan", "SELECT event_id, user_id, event_type, value FROM events")
def parquet_scan(t: Tables):
    return t("events").select("event_id", "user_id", "event_type", "value")


@query(
    "s4_typed_text",
    """SELECT CAST(o_custkey AS VARCHAR) AS participant_id, CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
        CAST(CAST(o_orderdate AS TIMESTAMP) AS VARCHAR) AS o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'open' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_seen,
        'participant_id string, o_orderkey int, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, date_seen string' AS types
    FROM orders""",
)
def typed_text(t: Tables):
    """Orders as a CSV reader sees them, all text, given their types again."""
    seen = F.when(F.col("o_orderkey") % 3 == 0, "open").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    text = t("orders").select(
        F.col("o_custkey").cast("string").alias("participant_id"), *[F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")],
        seen.alias("date_seen"),
    )
    typed = with_types(text)
    return typed.withColumn("types", F.lit(", ".join(f"{c} {kind}" for c, kind in typed.dtypes)))


@query(
    "p1_rename_columns",
    "SELECT user_id AS participant_id, value AS reading, event_type AS kind, event_id FROM events",
)
def rename_columns(t: Tables):
    mapping = P.parse_rename_list(["user_id:participant_id", "value:reading", "event_type:kind"])
    return P.rename_columns(t("events").select("event_id", "user_id", "value", "event_type"), mapping)


@query(
    "r10_flatten_windows",
    sql(
        """SELECT w.id, count(*) * 2 AS width, CAST(sum(s.heart_rate * (2 * slot + 1) + s.steps * (2 * slot + 2)) AS BIGINT) AS weighted_sum FROM windows w
            JOIN (SELECT *, CAST(date_diff('hour', TIMESTAMP '2000-01-01', timestamp) AS BIGINT) AS h FROM series) s
                ON w.participant_id = s.participant_id AND s.date BETWEEN w.date - 6 AND w.date
            JOIN LATERAL (SELECT s.h - CAST(date_diff('hour', TIMESTAMP '2000-01-01', w.start) AS BIGINT) AS slot) ON true
        GROUP BY w.id""",
        RAW, WINDOWS,
    ),
)
def flatten_windows(t: Tables):
    windows = week_windows(t, ["heart_rate", "steps"])
    flat = flatten_matrix(stack_channels(windows, ["heart_rate", "steps"]))
    name = F.concat("participant_id", F.lit(":"), F.date_sub(F.col("end").cast("date"), 1).cast("string"))
    return flat.select(
        name.alias("id"), F.size("features").cast("bigint").alias("width"),
        F.expr("cast(aggregate(transform(features, (x, i) -> x * (i + 1)), 0D, (s, x) -> s + x) AS bigint)").alias("weighted_sum"),
    )


@query(
    "p2_inclusive_date_range",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, resting_heart_rate FROM fx_day_level
        WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
        ["fx_day_level"],
    ),
)
def inclusive_date_range(t: Tables):
    days = P.between_dates(t("fx_day_level"), "date", "2024-01-05", "2024-01-20")
    return days.select("participant_id", "date", "resting_heart_rate")


@query(
    "p3_half_open_cut",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
)
def half_open_cut(t: Tables):
    return P.cut_dates(t("events"), "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("event_id")


_LISTED = "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS participant_id FROM customer WHERE c_mktsegment = 'BUILDING'"


def _listed(t: Tables):
    return t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("participant_id"))


@query(
    "p4_include_list",
    sql(f"SELECT event_id, participant_id FROM fx_activity_raw WHERE participant_id IN ({_LISTED})", RAW),
)
def include_list(t: Tables):
    return P.keep_listed(t("fx_activity_raw"), _listed(t), "participant_id").select("event_id", "participant_id")


@query(
    "p5_exclude_list",
    sql(f"SELECT event_id, participant_id FROM fx_activity_raw WHERE participant_id NOT IN ({_LISTED})", RAW),
)
def exclude_list(t: Tables):
    return P.drop_listed(t("fx_activity_raw"), _listed(t), "participant_id").select("event_id", "participant_id")


@query(
    "p6_consent_filter",
    sql(
        """SELECT survey_id, id_participant_external FROM fx_weekly
        WHERE TRY_CAST(id_participant_external AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
        ["fx_weekly"],
    ),
)
def consent_filter(t: Tables):
    consent = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("consent_id"))
    return P.keep_consented(t("fx_weekly"), consent, "id_participant_external").select(
        "survey_id", "id_participant_external"
    )


@query(
    "p7_epoch_nanos_to_utc",
    """SELECT event_id, CAST(make_timestamp((1700000000 + event_id * 61) * 1000000) AS VARCHAR) AS timestamp FROM events""",
)
def epoch_nanos(t: Tables):
    nanos = (F.lit(1_700_000_000) + F.col("event_id") * 61) * F.lit(1_000_000_000) + F.lit(987_654_321)
    return t("events").select("event_id", epoch_nanos_to_ts(nanos).alias("timestamp"))


_SEGMENTS = """
levels AS (
    SELECT id_participant_external, event_id, startTimeOffsetInSeconds,
        unnest(['awake', 'light', 'rem', 'deep']) AS sleep_type, CAST(sleepLevelsMap AS JSON) AS j FROM fx_garmin_sleep
), segs AS (
    SELECT id_participant_external, event_id, startTimeOffsetInSeconds, sleep_type,
        unnest(CAST(json_extract(j, '$.' || sleep_type) AS STRUCT(startTimeInSeconds BIGINT, endTimeInSeconds BIGINT)[])) AS s
    FROM levels WHERE json_extract(j, '$.' || sleep_type) IS NOT NULL
), segments AS (
    SELECT id_participant_external, event_id, startTimeOffsetInSeconds, sleep_type, s.startTimeInSeconds, s.endTimeInSeconds,
        CASE sleep_type WHEN 'light' THEN 1 WHEN 'deep' THEN 2 WHEN 'rem' THEN 2 WHEN 'awake' THEN 3 END AS sleep_classic
    FROM segs
)"""


@query(
    "p8_local_time_and_nights",
    sql(
        """SELECT id_participant_external, count(DISTINCT CAST(make_timestamp((endTimeInSeconds + startTimeOffsetInSeconds) * 1000000) AS DATE)) AS nights,
            CAST(min(make_timestamp((startTimeInSeconds + startTimeOffsetInSeconds) * 1000000)) AS VARCHAR) AS first_start
        FROM segments GROUP BY id_participant_external""",
        ["fx_garmin_sleep"], _SEGMENTS,
    ),
)
def local_time_and_nights(t: Tables):
    segments = flatten_sleep_levels(t("fx_garmin_sleep"))
    end = local_timestamp("endTimeInSeconds", "startTimeOffsetInSeconds")
    start = local_timestamp("startTimeInSeconds", "startTimeOffsetInSeconds")
    return segments.groupBy("id_participant_external").agg(
        F.count_distinct(day_of(end)).alias("nights"), F.min(start).alias("first_start")
    )


@query(
    "p9_last_token_timestamp",
    sql(
        """SELECT survey_id, CAST(d AS VARCHAR) AS date_completed FROM (
            SELECT survey_id, TRY_CAST(string_split(date_of_test_kit_completion, '|')[-1] AS TIMESTAMP) AS d FROM fx_weekly)
        WHERE d IS NOT NULL""",
        ["fx_weekly"],
    ),
)
def last_token(t: Tables):
    parsed = t("fx_weekly").select("survey_id", last_token_timestamp("date_of_test_kit_completion").alias("date_completed"))
    return P.drop_incomplete(parsed, ["date_completed"])


@query(
    "p10_value_remap",
    sql(
        "SELECT sleep_type, sleep_classic, count(*) AS n FROM segments GROUP BY sleep_type, sleep_classic",
        ["fx_garmin_sleep"], _SEGMENTS,
    ),
)
def value_remap(t: Tables):
    segments = flatten_sleep_levels(t("fx_garmin_sleep")).drop("sleep_classic")
    return (
        segments.withColumn("sleep_classic", remap("sleep_type", SLEEP_STAGE_CLASS))
        .groupBy("sleep_type", "sleep_classic").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p11_clause_predicate",
    sql(
        """SELECT response_id FROM fx_surveys
        WHERE coalesce((symptom_severity__cough_q_3 > 0 OR symptom_severity__cough_q_2 > 0)
            OR (daily_symptoms__cough = 'severe' AND have_flu > 0), false)""",
        ["fx_surveys"],
    ),
)
def clause_predicate(t: Tables):
    text = (
        "(symptom_severity__cough_q_3 > 0 | symptom_severity__cough_q_2 > 0)"
        ' | (daily_symptoms__cough == "severe" & have_flu > 0)'
    )
    return t("fx_surveys").where(clause(text)).select("response_id")


_LAST_SCREENER = """
last_screener AS (
    SELECT * FROM fx_screener QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY response_id DESC) = 1
)"""


@query(
    "p12_body_mass",
    sql(
        """SELECT participant_id, CAST(weight / ((12.0 * height__ft + height__in) * (12.0 * height__ft + height__in)) * 703.0 > 30.0 AS INT) AS is_obese
        FROM last_screener""",
        ["fx_screener"], _LAST_SCREENER,
    ),
)
def body_mass(t: Tables):
    last = keep_last(t("fx_screener"), ["participant_id"], ["response_id"])
    return last.select("participant_id", body_mass_over("weight", "height__ft", "height__in").alias("is_obese"))


@query(
    "p13_weekday_predicate",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, CAST(isodow(date) IN (6, 7) AS INT) AS is_weekend
        FROM fx_day_level""",
        ["fx_day_level"],
    ),
)
def weekday_predicate(t: Tables):
    return t("fx_day_level").select("participant_id", "date", weekday_in("date", [5, 6]).alias("is_weekend"))


@query(
    "p14_numeric_coercion",
    sql(
        """SELECT response_id, coalesce(TRY_CAST(symptom_severity__cough_q_3 AS DOUBLE), -1.0) AS cough,
            coalesce(TRY_CAST(daily_symptoms__cough AS DOUBLE), -1.0) AS text FROM fx_surveys""",
        ["fx_surveys"],
    ),
)
def numeric_coercion(t: Tables):
    return t("fx_surveys").select(
        "response_id", numeric_or("symptom_severity__cough_q_3").alias("cough"), numeric_or("daily_symptoms__cough").alias("text")
    )


@query(
    "p15_clip",
    """SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(least(value, 20.0), 0.001) END AS value FROM events""",
)
def clip_values(t: Tables):
    return t("events").select("event_id", clip("value", 0.001, 20.0).alias("value"))


@query(
    "p16_drop_null_rows",
    sql(
        "SELECT event_id, heart_rate, steps FROM fx_activity_raw WHERE heart_rate IS NOT NULL AND steps IS NOT NULL",
        RAW,
    ),
)
def drop_null_rows(t: Tables):
    return P.drop_incomplete(t("fx_activity_raw"), ["heart_rate", "steps"]).select("event_id", "heart_rate", "steps")


@query(
    "p17_missing_flags",
    sql(
        """SELECT participant_id, CAST(timestamp AS VARCHAR) AS timestamp, steps,
            CAST(missing_heart_rate AS INT) AS missing_heart_rate, CAST(missing_steps AS INT) AS missing_steps FROM flags""",
        RAW, FLAGS,
    ),
)
def missing_flags(t: Tables):
    return hourly_flags(t).select("participant_id", "timestamp", "steps", "missing_heart_rate", "missing_steps")


@query(
    "p18_sleep_one_hot",
    sql(
        """SELECT event_id, CAST(coalesce(sleep_classic, 0) = 0 AS INT) AS sleep_classic_0,
            CAST(coalesce(sleep_classic, 0) = 1 AS INT) AS sleep_classic_1, CAST(coalesce(sleep_classic, 0) = 2 AS INT) AS sleep_classic_2,
            CAST(coalesce(sleep_classic, 0) = 3 AS INT) AS sleep_classic_3 FROM fx_activity_raw""",
        RAW,
    ),
)
def sleep_flags(t: Tables):
    return t("fx_activity_raw").select("event_id", *[c.alias(n) for n, c in sleep_one_hot("sleep_classic").items()])


@query(
    "p19_type_narrowing",
    sql(
        """SELECT participant_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(coalesce(CAST(heart_rate AS SMALLINT), -1) AS INT) AS heart_rate,
            CAST(CAST(coalesce(steps, 0) AS SMALLINT) AS INT) AS steps FROM slots""",
        RAW, FLAGS,
    ),
)
def type_narrowing(t: Tables):
    rows = hourly_observations(t)
    return rows.select(
        "participant_id", "timestamp",
        F.coalesce(F.col("heart_rate").cast("smallint").cast("int"), F.lit(-1)).alias("heart_rate"),
        F.coalesce("steps", F.lit(0)).cast("smallint").cast("int").alias("steps"),
    )


@query(
    "p20_label_date",
    sql(
        """SELECT participant_id, CAST("end" AS VARCHAR) AS "end", CAST(CAST("end" - INTERVAL 1 MILLISECOND AS DATE) AS VARCHAR) AS label_date
        FROM windows""",
        RAW, WINDOWS,
    ),
)
def window_label_date(t: Tables):
    return window_keys(t).select("participant_id", "end", label_date("end").alias("label_date"))


@query(
    "p21_report_columns",
    sql(
        """SELECT classifier_name, dataset_name, CAST(contains(dataset_name, 'A') AS INT) AS is_a,
            CASE WHEN contains(dataset_name, 'A') THEN concat(classifier_name, '-A') ELSE classifier_name END AS display_name,
            accuracy * 1.1 - accuracy AS ci_high_width, greatest(accuracy, 0.001) AS bar_height
        FROM fx_metrics""",
        ["fx_metrics"],
    ),
)
def report_columns(t: Tables):
    is_a = F.col("dataset_name").contains("A")
    return t("fx_metrics").select(
        "classifier_name", "dataset_name", is_a.alias("is_a"),
        F.when(is_a, F.concat("classifier_name", F.lit("-A"))).otherwise(F.col("classifier_name")).alias("display_name"),
        (F.col("accuracy") * 1.1 - F.col("accuracy")).alias("ci_high_width"), clip("accuracy", lower=0.001).alias("bar_height"),
    )


@query(
    "p22_cell_overrides",
    sql(
        """SELECT m.classifier_name, m.dataset_name, coalesce(CASE WHEN r.r_regionkey IS NOT NULL THEN 0.5 END, m.accuracy) AS accuracy
        FROM fx_metrics m LEFT JOIN region r ON m.classifier_name = concat('model_', CAST(r.r_regionkey AS VARCHAR))""",
        ["fx_metrics"],
    ),
)
def cell_overrides(t: Tables):
    overrides = t("region").select(
        F.concat(F.lit("model_"), F.col("r_regionkey").cast("string")).alias("classifier_name"), F.lit(0.5).alias("accuracy")
    )
    return P.override_cells(t("fx_metrics"), overrides, "classifier_name")


@query(
    "p23_softmax",
    sql(
        """SELECT id, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS pos_prob FROM (
            SELECT id, ln(1 - p) AS a, ln(p) AS b FROM (
                SELECT id, greatest(least(pred_a, 0.999), 0.001) AS p FROM fx_predictions))""",
        ["fx_predictions"],
    ),
)
def softmax(t: Tables):
    p = clip("pred_a", 0.001, 0.999)
    logits = t("fx_predictions").select("id", F.array(F.ln(1 - p), F.ln(p)).alias("logits"))
    return logits.select("id", softmax_last("logits").alias("pos_prob"))


@query(
    "l13_lab_reader",
    sql(
        """SELECT DISTINCT participant_id FROM fx_lab_results
        WHERE trigger_datetime >= TIMESTAMP '2024-01-08' AND trigger_datetime < TIMESTAMP '2024-01-22' AND result = 'Detected'""",
        ["fx_lab_results"],
    ),
)
def lab_reader(t: Tables):
    labs = read_labs(t("fx_lab_results"), "2024-01-08", "2024-01-22", positive_only=True, ts_col="trigger_datetime")
    return labs.select("participant_id").distinct()
