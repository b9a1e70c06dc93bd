"""Window functions, sorting, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.functions.columns import day_of, label_date
from pulsegrid.operators import joins as J
from pulsegrid.operators import labels as L
from pulsegrid.operators import ordered as O
from pulsegrid.operators import split as S
from pulsegrid.plans.q_joins import _FLU
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.shared import RAW, WINDOWS, window_keys


@query(
    "w2_day_islands",
    sql(
        """SELECT participant_id, CAST(date AS VARCHAR) AS date, CAST(dense_rank() OVER (PARTITION BY participant_id ORDER BY g) AS BIGINT) AS island FROM (
            SELECT participant_id, date, date - CAST(row_number() OVER (PARTITION BY participant_id ORDER BY date) AS INT) AS g
            FROM (SELECT DISTINCT participant_id, CAST(timestamp AS DATE) AS date FROM fx_surveys))""",
        ["fx_surveys"],
    ),
)
def day_islands(t: Tables):
    return O.day_islands(t("fx_surveys").withColumn("date", day_of("timestamp")), "participant_id", "date")


@query(
    "w3_keep_last",
    sql(
        """SELECT participant_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, response_id, have_flu, daily_symptoms__cough FROM fx_surveys
        QUALIFY row_number() OVER (PARTITION BY participant_id, CAST(timestamp AS DATE) ORDER BY response_id DESC) = 1""",
        ["fx_surveys"],
    ),
)
def keep_last(t: Tables):
    dated = t("fx_surveys").select(
        "participant_id", day_of("timestamp").alias("date"), "response_id", "have_flu", "daily_symptoms__cough"
    )
    return O.keep_last(dated, ["participant_id", "date"], ["response_id"])


@query(
    "w4_rolling_day_frame",
    sql(
        """SELECT a.participant_id, CAST(a.date AS VARCHAR) AS date, round(sum(b."caloriesOut"), 6) AS calories_week
        FROM fx_day_level a JOIN fx_day_level b ON a.participant_id = b.participant_id AND b.date BETWEEN a.date - 6 AND a.date
        GROUP BY a.participant_id, a.date HAVING count(*) = 7""",
        ["fx_day_level"],
    ),
)
def rolling_day_frame(t: Tables):
    frames = O.rolling_days(t("fx_day_level"), "participant_id", "date", ["caloriesOut"], 7).where(F.size("frame") == 7)
    total = F.aggregate("frame.caloriesOut", F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return frames.select("participant_id", "date", F.round(total, 6).alias("calories_week"))


@query(
    "w5_midrank",
    sql(
        """SELECT id, rank() OVER (ORDER BY pred_b) + (count(*) OVER (PARTITION BY pred_b) - 1) / 2.0 AS midrank,
            rank() OVER (PARTITION BY label ORDER BY pred_b) + (count(*) OVER (PARTITION BY label, pred_b) - 1) / 2.0 AS class_midrank
        FROM fx_predictions""",
        ["fx_predictions"],
    ),
)
def midrank(t: Tables):
    ranks = {"midrank": ("pred_b", ()), "class_midrank": ("pred_b", ["label"])}
    return O.midranks(t("fx_predictions"), ranks).select("id", "midrank", "class_midrank")


@query(
    "w6_best_so_far",
    sql(
        """SELECT classifier_name, dataset_name, round(max(accuracy) OVER (PARTITION BY classifier_name ORDER BY dataset_name), 9) AS best_accuracy
        FROM fx_metrics""",
        ["fx_metrics"],
    ),
)
def best_so_far(t: Tables):
    best = O.best_so_far(t("fx_metrics"), "accuracy", "dataset_name", ["classifier_name"])
    return best.select("classifier_name", "dataset_name", F.round("best_accuracy", 9).alias("best_accuracy"))


_ORDER = ["purchase", "click", "error"]


@query(
    "o1_sort_by_list",
    """SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) AS position FROM (
        SELECT user_id, event_type, count(*) AS n, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS p
        FROM events GROUP BY user_id, event_type)""",
)
def sort_by_list(t: Tables):
    counts = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per event type and user in each window partition.
    place = F.row_number().over(W.partitionBy("user_id").orderBy(S.list_position("event_type", _ORDER), "event_type"))
    ranked = counts.withColumn("position", place.cast("bigint"))
    return S.order_by_list(ranked, "event_type", _ORDER, "user_id")


@query(
    "o2_row_cap",
    """SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY md5(concat('cap:', event_id)), event_id) <= 500""",
)
def row_cap(t: Tables):
    return S.row_cap(t("events").select("event_id"), 500, ["event_id"])


@query(
    "o3_temporal_participant_split",
    sql(
        """SELECT event_id, CASE WHEN timestamp < TIMESTAMP '2024-01-20' THEN 'train'
            WHEN substr(md5(concat('split:', participant_id)), 1, 8) < '80000000' THEN 'test' ELSE 'eval' END AS split
        FROM fx_activity_raw WHERE timestamp < TIMESTAMP '2024-01-29'""",
        RAW,
    ),
)
def temporal_participant_split(t: Tables):
    return S.temporal_participant_split(
        t("fx_activity_raw"), "2024-01-20 00:00:00", end_at="2024-01-29 00:00:00"
    ).select("event_id", "split")


def _ranked_sql(seed: str, source: str) -> str:
    return f"""members AS (SELECT DISTINCT participant_id FROM {source}), ranked AS (
        SELECT participant_id, row_number() OVER (ORDER BY md5(concat('{seed}:', participant_id)), participant_id) AS rank,
            count(*) OVER () AS total FROM members)"""


@query(
    "o4_exact_temporal_split",
    sql(
        """SELECT a.event_id, CASE WHEN a.timestamp >= TIMESTAMP '2024-01-20' THEN CASE WHEN r.rank <= floor(0.3 * r.total) THEN 'test' ELSE 'eval' END
            ELSE 'train' END AS split
        FROM fx_activity_raw a LEFT JOIN ranked r ON a.participant_id = r.participant_id""",
        RAW, _ranked_sql("exact", "(SELECT * FROM fx_activity_raw WHERE timestamp >= TIMESTAMP '2024-01-20')"),
    ),
)
def exact_temporal_split(t: Tables):
    return S.exact_temporal_split(
        t("fx_activity_raw"), "2024-01-20 00:00:00", test_frac=0.3, separate_train_and_eval=True
    ).select("event_id", "split")


@query(
    "o5_user_split",
    sql(
        """SELECT a.event_id, CASE WHEN r.rank <= floor(CAST(0.5 AS DOUBLE) * CAST(0.4 AS DOUBLE) * r.total) THEN 'test'
            WHEN r.rank <= floor(CAST(0.4 AS DOUBLE) * r.total) THEN 'eval' ELSE 'train' END AS split
        FROM fx_activity_raw a JOIN ranked r ON a.participant_id = r.participant_id""",
        RAW, _ranked_sql("user", "fx_activity_raw"),
    ),
)
def user_split(t: Tables):
    return S.user_split(t("fx_activity_raw"), eval_frac=0.4, test_frac=0.5).select("event_id", "split")


@query(
    "o6_two_way_split",
    sql(
        """SELECT a.event_id, CASE WHEN r.rank <= floor(CAST(0.7 AS DOUBLE) * r.total) THEN 'left' ELSE 'right' END AS side
        FROM fx_activity_raw a JOIN ranked r ON a.participant_id = r.participant_id""",
        RAW, _ranked_sql("two", "fx_activity_raw"),
    ),
)
def two_way_split(t: Tables):
    return S.two_way_split(t("fx_activity_raw"), 0.7).select("event_id", "side")


@query(
    "j7_split_membership",
    sql(
        """SELECT CASE WHEN substr(md5(concat('split:', participant_id)), 1, 8) < '40000000' THEN 'test' ELSE 'eval' END AS split,
            count(*) AS n_rows, count(DISTINCT participant_id) AS n_participants
        FROM fx_activity_raw WHERE timestamp >= TIMESTAMP '2024-01-15' GROUP BY 1""",
        RAW,
    ),
)
def split_membership(t: Tables):
    sides = S.temporal_participant_split(t("fx_activity_raw"), "2024-01-15 00:00:00", test_frac=0.25)
    return sides.where("split <> 'train'").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("participant_id").alias("n_participants")
    )


@query(
    "o7_negative_sampling",
    sql(
        """SELECT id, label FROM labelled WHERE label = 1 OR substr(md5(concat('neg:', id)), 1, 8) < '33333333'""",
        ["fx_lab_results", *RAW],
        WINDOWS + ", " + _FLU + """, labelled AS (
            SELECT w.id, CAST(f.date IS NOT NULL AS INT) AS label FROM windows w
            LEFT JOIN flu f ON w.participant_id = f.participant_id AND w.date = f.date)""",
    ),
)
def negative_sampling(t: Tables):
    windows = window_keys(t).withColumn("date", label_date("end"))
    labelled = J.lookup_labels(windows, L.flu_positive(t("fx_lab_results"), 0, 2))
    return S.keep_positives_sample_negatives(labelled, 0.2).select("id", "label")


@query(
    "o8_half_split_and_shuffle",
    """SELECT event_id, CASE WHEN substr(md5(concat('half:', event_id)), 1, 8) < '80000000' THEN 'a' ELSE 'b' END AS half FROM events""",
)
def half_split(t: Tables):
    return S.shuffle_rows(S.half_split(t("events").select("event_id"), ["event_id"]), ["event_id"])


@query(
    "o9_surrogate_id",
    """SELECT event_id, user_id, row_number() OVER (ORDER BY md5(concat('id:', CAST(event_id AS VARCHAR), ':', CAST(user_id AS VARCHAR))), event_id, user_id) AS id
    FROM events""",
)
def surrogate_id(t: Tables):
    return S.surrogate_id(t("events").select("event_id", "user_id"), ["event_id", "user_id"])


_K = [0.000001, 0.01, 0.1, 25]


@query(
    "o10_precision_at_k",
    sql(
        """SELECT CAST(k.name AS VARCHAR) AS k, CAST(k.n_top AS BIGINT) AS n_top, avg(CAST(r.label AS DOUBLE)) AS precision_at_k
        FROM cuts k LEFT JOIN ranked r ON r.rank <= k.n_top GROUP BY k.name, k.n_top""",
        ["fx_predictions"],
        """ranked AS (SELECT label, row_number() OVER (ORDER BY pred_b DESC, md5(concat('tie:', id))) AS rank FROM fx_predictions),
        cuts AS (SELECT '1e-06' AS name, floor(CAST(0.000001 AS DOUBLE) * count(*)) AS n_top FROM fx_predictions
            UNION ALL SELECT '0.01' AS name, floor(CAST(0.01 AS DOUBLE) * count(*)) AS n_top FROM fx_predictions
            UNION ALL SELECT '0.1', floor(CAST(0.1 AS DOUBLE) * count(*)) FROM fx_predictions
            UNION ALL SELECT '25', least(25, count(*)) FROM fx_predictions)""",
    ),
)
def precision_at_k(t: Tables):
    return S.precision_at_k(t("fx_predictions"), _K, score="pred_b")


@query(
    "l6_weekend",
    sql(
        "SELECT id, CAST(isodow(date) IN (6, 7) AS INT) AS label FROM windows",
        RAW, WINDOWS,
    ),
)
def weekend(t: Tables):
    windows = window_keys(t).withColumn("date", label_date("end"))
    return L.weekday_label(windows).select("id", "label")


