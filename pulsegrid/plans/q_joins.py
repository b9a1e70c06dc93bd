"""Joins, pairs and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import day_of, label_date, last_token_timestamp
from pulsegrid.functions.hashing import hash_below
from pulsegrid.functions.permute import sql_permute
from pulsegrid.operators import joins as J
from pulsegrid.operators import labels as L
from pulsegrid.operators.aggregate import participant_dates, zscore_columns
from pulsegrid.operators.reshape import last_per_slot
from pulsegrid.operators.setops import concat_tables
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.shared import HOUR, RAW, WINDOWS, window_keys


def _channel(t: Tables, name: str, event_types: tuple[str, ...]) -> DataFrame:
    rows = t("events").where(F.col("event_type").isin(*event_types)).select(
        F.col("user_id").cast("string").alias("participant_id"), F.col("ts").alias("timestamp"), "event_id",
        (F.col("event_id") % 120).alias(name),
    )
    return last_per_slot(rows, [name], ["timestamp", "event_id"], step_seconds=HOUR)


def _channel_sql(name: str, event_types: str) -> str:
    return f"""c_{name} AS (
        SELECT CAST(user_id AS VARCHAR) AS participant_id, date_trunc('hour', ts) AS timestamp, event_id % 120 AS {name}
        FROM events WHERE event_type IN ({event_types})
        QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1)"""


@query(
    "j1_channel_alignment",
    sql(
        """SELECT s.participant_id, CAST(s.timestamp AS VARCHAR) AS timestamp, s.steps, coalesce(h.heart_rate, -1) AS heart_rate,
            coalesce(z.sleep_classic, -1) AS sleep_classic
        FROM c_steps s LEFT JOIN c_heart_rate h ON s.participant_id = h.participant_id AND s.timestamp = h.timestamp
            LEFT JOIN c_sleep_classic z ON s.participant_id = z.participant_id AND s.timestamp = z.timestamp""",
        ctes=", ".join(
            [
                _channel_sql("steps", "'click', 'view', 'purchase'"), _channel_sql("heart_rate", "'signup', 'error', 'click'"),
                _channel_sql("sleep_classic", "'signup', 'view'"),
            ]
        ),
    ),
)
def channel_alignment(t: Tables):
    aligned = J.align_channels(
        _channel(t, "steps", ("click", "view", "purchase")), _channel(t, "heart_rate", ("signup", "error", "click")),
        _channel(t, "sleep_classic", ("signup", "view")), ["participant_id", "timestamp"],
    )
    return aligned.fillna(-1)


@query(
    "j2_survey_labs_activity",
    sql(
        """SELECT s.response_id, s.participant_id, coalesce(l.result, 'none') AS result, coalesce(a.nap_count, -1.0) AS nap_count
        FROM fx_surveys s LEFT JOIN fx_lab_results l ON s.participant_id = l.participant_id
            AND CAST(s.timestamp AS DATE) = CAST(l.trigger_datetime AS DATE) AND s.first_report_yn = l.first_report_yn
        LEFT JOIN fx_day_level a ON s.participant_id = a.participant_id AND CAST(s.timestamp AS DATE) = a.date""",
        ["fx_surveys", "fx_lab_results", "fx_day_level"],
    ),
)
def survey_labs_activity(t: Tables):
    surveys = t("fx_surveys").withColumn("date", day_of("timestamp"))
    labs = t("fx_lab_results").withColumn("date", day_of("trigger_datetime"))
    merged = J.survey_labs_activity(surveys, labs, t("fx_day_level"))
    return merged.select(
        "response_id", "participant_id", F.coalesce("result", F.lit("none")).alias("result"),
        F.coalesce("nap_count", F.lit(-1.0)).alias("nap_count"),
    )


_WEEKLY = """
weekly AS (
    SELECT * FROM (SELECT survey_id, id_participant_external, TRY_CAST(string_split(date_of_test_kit_completion, '|')[-1] AS TIMESTAMP) AS date_completed FROM fx_weekly)
    WHERE date_completed IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id_participant_external, date_completed ORDER BY survey_id DESC) = 1
), matched AS (
    SELECT l.lab_id, l.id_participant_external, l.result, w.survey_id, w.date_completed,
        w.date_completed >= l.date_received - INTERVAL 7 DAY AS within
    FROM fx_labs_asof l ASOF LEFT JOIN weekly w
        ON l.id_participant_external = w.id_participant_external AND l.date_received >= w.date_completed
)"""


@query(
    "j3_asof_backward_7d",
    sql(
        """SELECT lab_id, id_participant_external, result, CASE WHEN within THEN survey_id ELSE -1 END AS survey_id,
            CASE WHEN within THEN CAST(date_completed AS VARCHAR) ELSE 'none' END AS date_completed FROM matched""",
        ["fx_labs_asof", "fx_weekly"], _WEEKLY,
    ),
)
def asof_backward(t: Tables):
    weekly = t("fx_weekly").withColumn("date_completed", last_token_timestamp("date_of_test_kit_completion"))
    matched = J.asof_backward(
        t("fx_labs_asof"), weekly, key="id_participant_external", left_ts="date_received", right_ts="date_completed",
        right_cols=["survey_id"], tie_col="survey_id", tolerance_days=7,
    )
    return matched.select(
        "lab_id", "id_participant_external", "result", F.coalesce("survey_id", F.lit(-1)).cast("bigint").alias("survey_id"),
        F.coalesce(F.col("date_completed").cast("string"), F.lit("none")).alias("date_completed"),
    )


@query(
    "j4_range_semi_join",
    sql(
        """SELECT participant_id, test_name, result, CAST(trigger_datetime AS VARCHAR) AS trigger_datetime FROM fx_lab_results r
        WHERE EXISTS (SELECT 1 FROM windows w WHERE w.participant_id = r.participant_id
            AND CAST(r.trigger_datetime AS DATE) BETWEEN CAST(w.start AS DATE) AND CAST(w."end" AS DATE))""",
        ["fx_lab_results", *RAW], WINDOWS,
    ),
)
def range_semi_join(t: Tables):
    intervals = window_keys(t).select("participant_id", F.col("start").cast("date"), F.col("end").cast("date"))
    labs = t("fx_lab_results").withColumn("date", day_of("trigger_datetime"))
    return J.in_any_interval(labs, intervals).select("participant_id", "test_name", "result", "trigger_datetime")


_FLU = """
flu AS (
    SELECT DISTINCT participant_id, CAST(unnest(generate_series(CAST(trigger_datetime AS DATE), CAST(trigger_datetime AS DATE) + 2, INTERVAL 1 DAY)) AS DATE) AS date
    FROM fx_lab_results WHERE result = 'Detected' AND test_name IN ('Influenza A (Flu A)', 'Influenza B (Flu B)')
)"""


@query(
    "j5_label_lookup",
    sql(
        """SELECT w.id, CAST(w.date AS VARCHAR) AS date, CAST(f.date IS NOT NULL AS INT) AS label
        FROM windows w LEFT JOIN flu f ON w.participant_id = f.participant_id AND w.date = f.date""",
        ["fx_lab_results", *RAW], WINDOWS + ", " + _FLU,
    ),
)
def label_lookup(t: Tables):
    windows = window_keys(t).withColumn("date", label_date("end"))
    return J.lookup_labels(windows, L.flu_positive(t("fx_lab_results"), 0, 2)).select("id", "date", "label")


@query(
    "j6_fold_restriction",
    sql(
        """SELECT event_id, participant_id FROM fx_activity_raw a WHERE EXISTS (SELECT 1 FROM fx_day_level d
            WHERE d.participant_id = a.participant_id AND d.date = CAST(a.timestamp AS DATE)
            AND substr(md5(concat('fold:', d.participant_id, ':', CAST(d.date AS VARCHAR))), 1, 8) < '0ccccccc')""",
        [*RAW, "fx_day_level"],
    ),
)
def fold_restriction(t: Tables):
    fold = participant_dates(t("fx_day_level")).where(hash_below(0.05, "fold", F.col("participant_id"), F.col("date")))
    rows = t("fx_activity_raw").withColumn("date", day_of("timestamp"))
    return J.restrict_to_dates(rows, fold).select("event_id", "participant_id")


PAIRS_PER_PARTICIPANT = 50

_PAIR = sql_permute("concat('same:pairs:', participant_id)", "(n * n)", "n", "n", "k")
_SAME = f"""
ranked AS (
    SELECT id, participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY md5(concat('same:', id)), id) AS pos,
        count(*) OVER (PARTITION BY participant_id) AS n FROM windows
), drawn AS (
    SELECT participant_id, n, unnest(range(least({PAIRS_PER_PARTICIPANT}, n * n))) AS k FROM (SELECT DISTINCT participant_id, n FROM ranked)
), placed AS (
    SELECT participant_id, n * n - least({PAIRS_PER_PARTICIPANT}, n * n) AS pairs_left_out, pair // n + 1 AS l, pair % n + 1 AS r
    FROM (SELECT *, {_PAIR} AS pair FROM drawn)
), same AS (
    SELECT a.id AS id_l, b.id AS id_r, p.pairs_left_out FROM placed p
        JOIN ranked a ON a.participant_id = p.participant_id AND a.pos = p.l
        JOIN ranked b ON b.participant_id = p.participant_id AND b.pos = p.r
)"""


@query("j8_same_participant_pairs", sql("SELECT id_l, id_r, pairs_left_out FROM same", RAW, WINDOWS + ", " + _SAME))
def same_participant_pairs(t: Tables):
    return J.sample_pairs(window_keys(t), PAIRS_PER_PARTICIPANT)


_SEQUENTIAL = """
sequential AS (
    SELECT l.id AS id_l, r.id AS id_r, l.participant_id AS participant_id_l, r.participant_id AS participant_id_r,
        l."end" AS end_l, r.start AS start_r
    FROM windows l JOIN windows r ON l.participant_id = r.participant_id AND l."end" = r."end" - INTERVAL 7 DAY
)"""


@query("j9_sequential_pairs", sql("SELECT id_l, id_r FROM sequential", RAW, WINDOWS + ", " + _SEQUENTIAL))
def sequential_pairs(t: Tables):
    return J.sequential_pairs(window_keys(t), offset_days=7).select("id_l", "id_r")


_PLACE = sql_permute("concat('pair:', CAST(turn AS VARCHAR))", "n", "side", "other", "(pos - 1)")
_RANDOM = f"""
turned AS (
    SELECT id, row_number() OVER (ORDER BY md5(concat('pair:', id)), id) AS pos, count(*) OVER () AS n FROM windows
), sides AS (
    SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS side, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS other, unnest(range(11)) AS turn FROM turned
), dealt AS (
    SELECT l.id AS id_l, r.id AS id_r FROM (SELECT id, {_PLACE} + 1 AS pos FROM sides) l JOIN turned r ON r.pos = l.pos
)"""


@query("j10_random_pairing", sql("SELECT id_l, id_r FROM dealt", RAW, WINDOWS + ", " + _RANDOM))
def random_pairing(t: Tables):
    return J.random_pair_rounds(window_keys(t), rounds=11)


@query(
    "j11_natural_merge",
    sql(
        """SELECT classifier_name, dataset_name, round(accuracy, 9) AS accuracy, n FROM fx_metrics JOIN (
            SELECT concat('model_', CAST(l_linenumber AS VARCHAR)) AS classifier_name, concat(l_returnflag, '-', l_linestatus) AS dataset_name,
                count(*) AS n FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus) USING (classifier_name, dataset_name)""",
        ["fx_metrics"],
    ),
)
def natural_merge(t: Tables):
    sizes = t("lineitem").groupBy(
        F.concat(F.lit("model_"), F.col("l_linenumber").cast("string")).alias("classifier_name"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("dataset_name"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return J.natural_join(t("fx_metrics").withColumn("accuracy", F.round("accuracy", 9)), sizes)


@query(
    "j12_append_day_features",
    sql(
        """SELECT w.id, CAST(f.date IS NOT NULL AS DOUBLE) AS label,
            round(coalesce((d.nap_count - s.m) / s.sd, 0.0), 6) AS nap_count, coalesce(CAST(d.missing_hr AS DOUBLE), 1.0) AS missing_hr
        FROM windows w LEFT JOIN flu f ON w.participant_id = f.participant_id AND w.date = f.date
            LEFT JOIN fx_day_level d ON w.participant_id = d.participant_id AND w.date = d.date
            CROSS JOIN (SELECT avg(nap_count) AS m, stddev_samp(nap_count) AS sd FROM fx_day_level) s""",
        ["fx_lab_results", "fx_day_level", *RAW], WINDOWS + ", " + _FLU,
    ),
)
def append_day_features(t: Tables):
    windows = window_keys(t).withColumn("date", label_date("end"))
    labelled = J.lookup_labels(windows, L.flu_positive(t("fx_lab_results"), 0, 2))
    columns = ["nap_count", "missing_hr"]
    daily = L.rolling_day_vectors(zscore_columns(t("fx_day_level"), ["nap_count"]), columns, days=1)
    joined = J.append_day_features(labelled, daily, L.default_day_vector(columns, 1))
    return joined.select(
        "id", F.get("label_vector", F.lit(0)).alias("label"), F.round(F.get("label_vector", F.lit(1)), 6).alias("nap_count"),
        F.get("label_vector", F.lit(2)).alias("missing_hr"),
    )


@query(
    "u1_pair_union",
    sql("SELECT id_l, id_r, NULL AS pairs_left_out FROM dealt UNION ALL SELECT id_l, id_r, pairs_left_out FROM same", RAW, WINDOWS + ", " + _SAME + ", " + _RANDOM),
)
def pair_union(t: Tables):
    windows = window_keys(t)
    return concat_tables([J.random_pair_rounds(windows, rounds=11), J.sample_pairs(windows, PAIRS_PER_PARTICIPANT)])


@query(
    "u2_concat_tables",
    sql(
        """SELECT participant_id, coalesce(result, 'none') AS result, coalesce(have_flu, -1) AS have_flu FROM (
            SELECT participant_id, result, NULL AS have_flu FROM fx_lab_results
            UNION ALL SELECT participant_id, NULL, have_flu FROM fx_surveys)""",
        ["fx_lab_results", "fx_surveys"],
    ),
)
def concat(t: Tables):
    tables = [t("fx_lab_results").select("participant_id", "result"), t("fx_surveys").select("participant_id", "have_flu")]
    return concat_tables(tables).fillna("none", ["result"]).fillna(-1, ["have_flu"])


@query(
    "l11_same_participant_label",
    sql(
        """SELECT id_l, id_r, CAST(string_split(id_l, ':')[1] = string_split(id_r, ':')[1] AS INT) AS label, pairs_left_out
        FROM (SELECT id_l, id_r, NULL AS pairs_left_out FROM dealt UNION ALL SELECT id_l, id_r, pairs_left_out FROM same)""",
        RAW, WINDOWS + ", " + _SAME + ", " + _RANDOM,
    ),
)
def same_participant_label(t: Tables):
    windows = window_keys(t)
    pairs = concat_tables([J.random_pair_rounds(windows, rounds=11), J.sample_pairs(windows, PAIRS_PER_PARTICIPANT)])
    return J.attach_sides(pairs, windows).select("id_l", "id_r", L.same_participant().alias("label"), "pairs_left_out")


@query(
    "l12_sequential_label",
    sql(
        """SELECT id_l, id_r, CAST(participant_id_l = participant_id_r AND start_r >= end_l AND start_r < end_l + INTERVAL 1 DAY AS INT) AS label
        FROM pairs""",
        RAW, WINDOWS + ", " + _SEQUENTIAL + """, kept AS (
            SELECT *, substr(md5(concat('seq:', id_l, ':', id_r)), 1, 8) < '80000000' AS k FROM sequential
        ), broken_l AS (
            SELECT id_l, participant_id_l, end_l, row_number() OVER (ORDER BY md5(concat('seq:l:', id_l)), id_l) AS n FROM kept WHERE NOT k
        ), broken_r AS (
            SELECT id_r, participant_id_r, start_r, row_number() OVER (ORDER BY md5(concat('seq:r:', id_r)), id_r) AS n FROM kept WHERE NOT k
        ), pairs AS (
            SELECT id_l, id_r, participant_id_l, participant_id_r, end_l, start_r FROM kept WHERE k
            UNION ALL SELECT id_l, id_r, participant_id_l, participant_id_r, end_l, start_r FROM broken_l JOIN broken_r USING (n)
        )""",
    ),
)
def sequential_label(t: Tables):
    pairs = J.sequential_task_pairs(window_keys(t))
    return pairs.select("id_l", "id_r", L.sequential().alias("label"))
