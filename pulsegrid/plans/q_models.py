"""Model jobs; fitted models have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.columns import label_date
from pulsegrid.functions.hashing import hash_below
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import joins as J
from pulsegrid.operators import labels as L
from pulsegrid.operators import mljobs as M
from pulsegrid.plans.registry import Tables, query, sql
from pulsegrid.plans.q_joins import _FLU as FLU
from pulsegrid.plans.shared import RAW, WINDOWS, week_windows

_SURVEY_FEATURES = ["have_flu", "symptom_severity__cough_q_2", "symptom_severity__cough_q_3"]
_ACTIVITY_FEATURES = ["resting_heart_rate", "nap_count", "caloriesOut", "missing_hr"]


def _labelled_surveys(t: Tables):
    results = t("fx_lab_results").groupBy(
        "participant_id", F.col("trigger_datetime").cast("date").alias("date")
    ).agg(F.bool_or(F.col("result") == L.POSITIVE).cast("int").alias("label"))
    surveys = t("fx_surveys").withColumn("date", F.col("timestamp").cast("date"))
    return surveys.join(results, ["participant_id", "date"]).join(t("fx_day_level"), ["participant_id", "date"], "left")


@query("m1_weak_label_model")
def weak_label_model(t: Tables):
    _, held_out = M.fit_label_model(_labelled_surveys(t), [*_SURVEY_FEATURES, *_ACTIVITY_FEATURES])
    return held_out


def _labelled_features(t: Tables):
    windows = week_windows(t, ["heart_rate", "steps"]).withColumn("date", label_date("end"))
    labelled = J.lookup_labels(windows, L.flu_positive(t("fx_lab_results"), 0, 2))
    vector = F.concat(F.col("heart_rate").cast("array<double>"), F.col("steps").cast("array<double>"))
    return labelled.select("participant_id", "date", "id", "label", vector.alias("features"))


def _calendar_days(t: Tables) -> int:
    """Days from each participant's first to last observation; no more windows end on them."""
    days = t("fx_activity_raw").groupBy("participant_id").agg((F.datediff(F.max("timestamp"), F.min("timestamp")) + 1).alias("days"))
    return days.agg(F.coalesce(F.sum("days"), F.lit(0)).alias("days")).first().days


def _scored_windows(t: Tables):
    """Predictions for the held-out participants' windows by trees fitted on the others'."""
    rows = _labelled_features(t)
    held_out = hash_below(0.3, "m2", F.col("participant_id"))
    model = M.fit_boosted_trees(rows.where(~held_out), rows=_calendar_days(t))
    return M.predictions_table(model, rows.where(held_out))


@query("m2_boosted_trees")
def boosted_trees(t: Tables):
    return E.rank_metrics(_scored_windows(t))


@query("m4_predictions_table")
def predictions_table(t: Tables):
    return _scored_windows(t)


@query(
    "m4_scored_rows",
    sql(
        """SELECT w.participant_id, CAST(w.date AS VARCHAR) AS date, CAST(f.date IS NOT NULL AS INT) AS label, 1 AS is_probability
        FROM windows w LEFT JOIN flu f ON w.participant_id = f.participant_id AND w.date = f.date
        WHERE substr(md5(concat('m2:', w.participant_id)), 1, 8) < '4ccccccc'""",
        ["fx_lab_results", *RAW], WINDOWS + ", " + FLU,
    ),
)
def scored_rows(t: Tables):
    """What can be checked of a scored table without the model: its rows, their labels and that every score is a probability."""
    scored = predictions_table(t)
    return scored.select("participant_id", "date", "label", F.col("pred").between(0, 1).cast("int").alias("is_probability"))


@query(
    "m3_random_reconstruction",
    sql(
        """SELECT round(corr(target, pred), 6) AS pearson, round(avg(abs(target - pred)), 6) AS mae FROM (
            SELECT e.target, t.pred FROM (
                SELECT l_id, target, CAST(concat('0x', substr(md5(concat('recon:draw:', l_id)), 1, 8)) AS BIGINT) % (SELECT count(*) FROM train) + 1 AS row FROM evaluation) e
            JOIN (SELECT pred, row_number() OVER (ORDER BY md5(concat('recon:', l_id)), l_id) AS row FROM train) t USING (row))""",
        ctes="""train AS (SELECT o_orderkey AS l_id, o_totalprice AS pred FROM orders WHERE o_orderstatus <> 'P'),
        evaluation AS (SELECT o_orderkey AS l_id, o_totalprice AS target FROM orders WHERE o_orderstatus = 'P')""",
    ),
)
def random_reconstruction(t: Tables):
    orders = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), "o_orderstatus")
    pairs = M.random_reconstructions(orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus = 'P'"), "x")
    return pairs.agg(
        F.round(F.corr("target", "pred"), 6).alias("pearson"), F.round(F.avg(F.abs(F.col("target") - F.col("pred"))), 6).alias("mae")
    )


@query("l10_weak_flu_probability")
def weak_flu_probability(t: Tables):
    return M.weak_flu_probability(
        t("fx_surveys"), t("fx_lab_results"), t("fx_day_level"), _SURVEY_FEATURES, _ACTIVITY_FEATURES, onset_max=1
    )
