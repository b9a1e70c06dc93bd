"""Labelers and task datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.columns import label_date
from pulsegrid.operators import joins as J
from pulsegrid.operators import labels as L
from pulsegrid.operators import tasks as T
from pulsegrid.plans.q_joins import _FLU, _WEEKLY
from pulsegrid.plans.q_rows import _LAST_SCREENER
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.shared import CHANNELS, RAW, WINDOWS, week_windows, window_keys


@query(
    "l1_flu_positive",
    sql("SELECT participant_id, CAST(date AS VARCHAR) AS date, 1 AS label FROM flu", ["fx_lab_results"], _FLU),
)
def flu_positive(t: Tables):
    return L.flu_positive(t("fx_lab_results"), 0, 2)


@query(
    "l2_survey_clause",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, 1 AS label FROM (
            SELECT *, CAST(timestamp AS DATE) AS date FROM fx_surveys
            QUALIFY row_number() OVER (PARTITION BY participant_id, CAST(timestamp AS DATE) ORDER BY response_id DESC) = 1)
        WHERE symptom_severity__cough_q_3 > 0 OR symptom_severity__cough_q_2 > 0""",
        ["fx_surveys"],
    ),
)
def survey_clause(t: Tables):
    return T.task_labels("cough", {"surveys": t("fx_surveys")})


@query(
    "l3_ili_window",
    sql(
        """SELECT DISTINCT participant_id, CAST(date AS VARCHAR) AS date, 1 AS label FROM fx_ili
        WHERE "ILI_type" IN (1, 2) AND days_since_onset_v43 BETWEEN -1 AND 5""",
        ["fx_ili"],
    ),
)
def ili_window(t: Tables):
    return L.ili_window(t("fx_ili"), types=(1, 2), onset_min=-1, onset_max=5)


@query(
    "l4_diagnosis_date",
    """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS participant_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 1 AS label
    FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def diagnosis_date(t: Tables):
    diagnoses = t("orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("participant_id"), F.col("o_orderdate").alias("covid_diagnosis_dates")
    )
    return L.diagnosis_date(diagnoses)


@query(
    "l5_lab_survey_positive",
    sql(
        """SELECT DISTINCT id_participant_external AS participant_id,
            CAST(CAST(unnest(generate_series(CAST(date_completed AS DATE) - 1, CAST(date_completed AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date, 1 AS label
        FROM matched WHERE within AND result = 'Positive'""",
        ["fx_labs_asof", "fx_weekly"], _WEEKLY,
    ),
)
def lab_survey_positive(t: Tables):
    return L.lab_survey_positive(t("fx_labs_asof"), t("fx_weekly"), 1, 1)


@query(
    "l7_obesity",
    sql(
        """SELECT w.id, coalesce(CAST(s.weight / ((12.0 * s.height__ft + s.height__in) * (12.0 * s.height__ft + s.height__in)) * 703.0 > 30.0 AS INT), 0) AS label
        FROM windows w LEFT JOIN last_screener s ON w.participant_id = s.participant_id""",
        [*RAW, "fx_screener"], WINDOWS + ", " + _LAST_SCREENER,
    ),
)
def obesity(t: Tables):
    return J.lookup_labels(window_keys(t), L.obesity(t("fx_screener")), keys=["participant_id"]).select("id", "label")


@query(
    "l8_daily_feature_vector",
    sql(
        """SELECT w.id, coalesce(v.features, '0,1,0,1') AS features FROM windows w LEFT JOIN (
            SELECT a.participant_id, a.date,
                string_agg(CAST(CAST(b.nap_count AS BIGINT) AS VARCHAR) || ',' || CAST(b.missing_hr AS VARCHAR), ',' ORDER BY b.date) AS features
            FROM fx_day_level a JOIN fx_day_level b ON a.participant_id = b.participant_id AND b.date BETWEEN a.date - 1 AND a.date
            GROUP BY a.participant_id, a.date HAVING count(*) = 2) v
        ON w.participant_id = v.participant_id AND w.date = v.date""",
        [*RAW, "fx_day_level"], WINDOWS,
    ),
)
def daily_feature_vector(t: Tables):
    columns = ["nap_count", "missing_hr"]
    vectors = L.rolling_day_vectors(t("fx_day_level"), columns, days=2)
    default = F.array(*[F.lit(x) for x in L.default_day_vector(columns, 2)])
    windows = window_keys(t).withColumn("date", label_date("end"))
    looked_up = J.lookup_labels(windows, vectors, label_col="features", default=default, alias="features")
    return looked_up.select("id", F.col("features").cast("array<bigint>").alias("features"))


@query(
    "l9_clean_annotation",
    sql(
        """SELECT DISTINCT participant_id, CAST(date AS VARCHAR) AS date, 0 AS label FROM spread
        WHERE NOT coalesce((have_flu = 1 AND run_pos IS NOT NULL) OR have_flu = 0, false)""",
        ["fx_surveys", "fx_lab_results"],
        """s AS (SELECT participant_id, CAST(timestamp AS DATE) AS date, first_report_yn, have_flu FROM fx_surveys),
        islands AS (SELECT participant_id, date, date - CAST(row_number() OVER (PARTITION BY participant_id ORDER BY date) AS INT) AS g
            FROM (SELECT DISTINCT participant_id, date FROM s)),
        merged AS (SELECT s.participant_id, s.date, s.have_flu, i.g,
                CAST(l.result = 'Detected' AND l.test_name IN ('Influenza A (Flu A)', 'Influenza B (Flu B)') AS INT) AS is_pos
            FROM s JOIN islands i ON s.participant_id = i.participant_id AND s.date = i.date
            LEFT JOIN fx_lab_results l ON s.participant_id = l.participant_id AND s.date = CAST(l.trigger_datetime AS DATE) AND s.first_report_yn = l.first_report_yn),
        spread AS (SELECT *, max(is_pos) OVER (PARTITION BY participant_id, g) AS run_pos FROM merged)""",
    ),
)
def clean_annotation(t: Tables):
    return L.clean_annotation(t("fx_surveys"), t("fx_lab_results"))


@query(
    "t1_flu_positive_windows",
    sql(
        """SELECT w.participant_id, count(*) AS n_windows, CAST(sum(CAST(f.date IS NOT NULL AS INT)) AS BIGINT) AS n_flu_positive
        FROM windows w LEFT JOIN flu f ON w.participant_id = f.participant_id AND w.date = f.date
        GROUP BY w.participant_id""",
        ["fx_lab_results", *RAW], WINDOWS + ", " + _FLU.replace(" + 2,", ","),
    ),
)
def flu_positive_windows(t: Tables):
    """How many complete 7-day windows end on a flu-positive day, per participant."""
    windows = window_keys(t)
    labelled = T.labelled_windows(windows, T.task_labels("flu_positive", {"labs": t("fx_lab_results")}), fields=[])
    return labelled.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("label").cast("bigint").alias("n_flu_positive")
    )


@query(
    "t2_task_dataset",
    sql(
        """SELECT w.participant_id, CAST(w.date AS VARCHAR) AS date, strftime(w."end" - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS end_date_str,
            CAST(f.date IS NOT NULL AS INT) AS label, CAST(isodow(w.date) IN (6, 7) AS INT) AS weekend, x.steps_sum, x.sleep_0
        FROM windows w LEFT JOIN flu f ON w.participant_id = f.participant_id AND w.date = f.date
        JOIN (SELECT v.id, CAST(sum(s.steps) AS BIGINT) AS steps_sum, CAST(sum(CAST(s.sleep_classic_0 AS INT)) AS BIGINT) AS sleep_0
            FROM windows v JOIN series s ON v.participant_id = s.participant_id AND s.date BETWEEN v.date - 6 AND v.date GROUP BY v.id) x ON x.id = w.id""",
        ["fx_lab_results", *RAW], WINDOWS + ", " + _FLU,
    ),
)
def task_dataset(t: Tables):
    windows = week_windows(t, CHANNELS)
    flu = L.flu_positive(t("fx_lab_results"), 0, 2)
    weekend = T.task_labels("weekend", {"windows": windows})
    rows = T.labelled_windows(windows, flu, ["steps", "sleep_classic_0"], metadata={"weekend": weekend})
    total = lambda c: F.aggregate(F.col(c).cast("array<int>").cast("array<bigint>"), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return rows.select(
        "participant_id", "date", "end_date_str", "label", "weekend", total("steps").alias("steps_sum"),
        total("sleep_classic_0").alias("sleep_0"),
    )


def _scaled_sql(column: str) -> str:
    """A day column as the task takes it: values z-scored over the whole table, flags as they are."""
    if "missing" in column:
        return f"CAST({column} AS DOUBLE)"
    return f"({column} - (SELECT avg({column}) FROM fx_day_features)) / (SELECT stddev_samp({column}) FROM fx_day_features)"


_DAYS, _WIDTH = 7, len(L.DAY_FEATURE_COLUMNS)
_DEFAULT = [float("missing" in c) for c in L.DAY_FEATURE_COLUMNS] * _DAYS


@query(
    "t3_daily_features_task",
    sql(
        f"""SELECT w.id, CAST(f.v IS NOT NULL AS INT) AS found, len(coalesce(f.v, d.v)) AS width,
            round(list_sum([coalesce(f.v, d.v)[i] * i for i in range(1, {_DAYS * _WIDTH + 1})]), 5) AS weighted_sum,
            round(coalesce(f.v, d.v)[1], 6) AS first, round(coalesce(f.v, d.v)[{(_DAYS - 1) * _WIDTH + 1}], 6) AS last_day_first, coalesce(f.v, d.v)[{_DAYS * _WIDTH}] AS last
        FROM windows w LEFT JOIN frames f ON w.participant_id = f.participant_id AND w.date = f.date
            CROSS JOIN (SELECT CAST({_DEFAULT} AS DOUBLE[]) AS v) d""",
        ["fx_day_features", *RAW],
        WINDOWS + f""", scaled AS (SELECT participant_id, date, [{", ".join(map(_scaled_sql, L.DAY_FEATURE_COLUMNS))}] AS v FROM fx_day_features),
        frames AS (SELECT a.participant_id, a.date, flatten(list(b.v ORDER BY b.date)) AS v FROM scaled a
            JOIN scaled b ON a.participant_id = b.participant_id AND b.date BETWEEN a.date - {_DAYS - 1} AND a.date GROUP BY a.participant_id, a.date HAVING count(*) = {_DAYS})""",
    ),
)
def daily_features_task(t: Tables):
    """The regression task with its own defaults: all day columns over seven days, zeros and set flags where the days are not complete."""
    tables = {"day_level": t("fx_day_features")}
    rows = T.task_windows("daily_features", window_keys(t), tables, [])
    listed = T.task_labels("daily_features", tables)
    flagged = J.lookup_labels(rows, listed.withColumn("one", F.lit(1)), label_col="one", alias="found")
    return flagged.selectExpr(
        "id", "found", "size(label) AS width", "round(aggregate(transform(label, (x, i) -> x * (i + 1)), 0D, (s, x) -> s + x), 5) AS weighted_sum",
        "round(label[0], 6) AS first", f"round(label[{(_DAYS - 1) * _WIDTH}], 6) AS last_day_first", f"label[{_DAYS * _WIDTH - 1}] AS last",
    )


@query(
    "t5_fields_without_flags",
    sql(
        """SELECT w.participant_id, CAST(w.date AS VARCHAR) AS date, CAST(sum(s.steps) AS BIGINT) AS steps_sum,
            CAST(sum(CAST(s.sleep_classic_1 AS INT)) AS BIGINT) AS sleep_1, 5 AS n_channels
        FROM windows w JOIN series s ON w.participant_id = s.participant_id AND s.date BETWEEN w.date - 6 AND w.date
        GROUP BY w.participant_id, w.date""",
        RAW, WINDOWS,
    ),
)
def fields_without_flags(t: Tables):
    rows = T.labelled_windows(week_windows(t, T.NO_MISSING_FLAG_FIELDS), None, T.NO_MISSING_FLAG_FIELDS, autoencoder=True)
    total = lambda c: F.aggregate(F.col(c).cast("array<int>").cast("array<bigint>"), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    channels = [f for f in rows.columns if f in T.NO_MISSING_FLAG_FIELDS]
    return rows.select(
        "participant_id", "date", total("steps").alias("steps_sum"), total("sleep_classic_1").alias("sleep_1"), F.lit(len(channels)).alias("n_channels")
    )


@query(
    "t4_channel_length",
    sql(
        """SELECT CAST(CASE WHEN min(n) = max(n) THEN max(n) END AS INT) AS length, 8 AS n_channels FROM (
            SELECT w.id, count(*) AS n FROM windows w JOIN series s ON w.participant_id = s.participant_id AND s.date BETWEEN w.date - 6 AND w.date
            GROUP BY w.id)""",
        RAW, WINDOWS,
    ),
)
def channel_length(t: Tables):
    return T.channel_length(week_windows(t, CHANNELS), CHANNELS)
