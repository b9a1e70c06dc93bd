"""Projections of the base tables that stand in for wearable, lab and survey tables.

The same text runs on Spark and as a CTE of the checking SQL; ``[name]`` marks a
base table and ``<agg>`` the one function the two spell differently.
"""

from __future__ import annotations

from pulsegrid.operators.labels import DAY_FEATURE_COLUMNS

SPARK_AGG = "listagg(tok, ' ') WITHIN GROUP (ORDER BY event_id)"
SQL_AGG = "string_agg(tok, ' ' ORDER BY event_id)"

# name: (SQL, base tables)
FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_lab_results": (
        """
        SELECT CAST(user_id AS STRING) AS participant_id, ts AS trigger_datetime,
            CASE WHEN event_id % 3 = 0 THEN 'Detected' ELSE 'Not Detected' END AS result,
            CASE event_id % 4 WHEN 0 THEN 'Influenza A (Flu A)' WHEN 1 THEN 'Influenza B (Flu B)' WHEN 2 THEN 'RSV' ELSE 'SARS-CoV-2' END AS test_name, event_id % 2 = 0 AS first_report_yn
        FROM [events]
        WHERE event_type = 'error'
        """,
        ("events",),
    ),
    "fx_surveys": (
        """
        SELECT event_id AS response_id,
            CAST(user_id AS STRING) AS participant_id, ts AS timestamp, event_id % 2 = 0 AS first_report_yn,
            CASE WHEN value > 50 THEN 1 ELSE 0 END AS have_flu,
            CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS symptom_severity__cough_q_2,
            CASE WHEN event_id % 11 = 0 THEN 1 END AS symptom_severity__cough_q_3,
            CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE 'severe' END AS daily_symptoms__cough
        FROM [events]
        WHERE event_type IN ('signup','click')
        """,
        ("events",),
    ),
    "fx_screener": (
        """
        SELECT c_custkey AS response_id,
            CAST(c_custkey % 500 AS STRING) AS participant_id,
            CAST(110 + c_custkey % 190 AS DOUBLE) AS weight, 4 + c_custkey % 3 AS height__ft, c_custkey % 12 AS height__in
        FROM [customer]
        """,
        ("customer",),
    ),
    "fx_ili": (
        """
        SELECT CAST(o_custkey AS STRING) AS participant_id,
            CAST(o_orderdate AS DATE) AS date,
            CAST(o_orderkey % 43 - 28 AS DOUBLE) AS days_since_onset_v43,
            CAST(o_orderkey % 3 + 1 AS DOUBLE) AS ILI_type
        FROM [orders]
        """,
        ("orders",),
    ),
    "fx_predictions": (
        """
        SELECT CAST(l.doc_id % 50 AS STRING) AS participant_id, l.doc_id AS id, l.quality AS label,
            CAST(d.n_chars % 997 AS DOUBLE) / 997 AS pred_a,
            CAST((d.n_chars * 7 + l.doc_id * 13) % 101 AS DOUBLE) / 101 AS pred_b
        FROM [labels] l JOIN [documents] d ON l.doc_id = d.doc_id
        """,
        ("labels", "documents"),
    ),
    "fx_labs_asof": (
        """
        SELECT event_id AS lab_id,
            CAST(user_id AS STRING) AS id_participant_external, ts AS date_received,
            CASE WHEN event_id % 3 = 0 THEN 'Positive' ELSE 'Negative' END AS result
        FROM [events]
        WHERE event_type = 'purchase'
        """,
        ("events",),
    ),
    "fx_weekly": (
        """
        SELECT event_id AS survey_id,
            CAST(user_id AS STRING) AS id_participant_external, concat('n/a|',
            CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE CAST(CAST(ts AS DATE) AS STRING) END) AS date_of_test_kit_completion
        FROM [events]
        WHERE event_type = 'view'
        """,
        ("events",),
    ),
    "fx_day_level": (
        """
        SELECT CAST(user_id AS STRING) AS participant_id,
            CAST(ts AS DATE) AS date, min(value) AS resting_heart_rate,
            CAST(count(*) AS DOUBLE) AS nap_count, sum(value) AS caloriesOut, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS missing_hr
        FROM [events]
        GROUP BY user_id,
            CAST(ts AS DATE)
        """,
        ("events",),
    ),
    # A day table with every column of the regression task: one sum or flag of the event ids for each.
    "fx_day_features": (
        "SELECT CAST(user_id AS STRING) AS participant_id, CAST(ts AS DATE) AS date, "
        + ", ".join(f"CAST(sum(event_id * {i + 3} % {89 + 4 * i}) AS DOUBLE) AS {name}" for i, name in enumerate(DAY_FEATURE_COLUMNS) if "missing" not in name)
        + ", "
        + ", ".join(f"max(CASE WHEN event_id % {i} = 0 THEN 1 ELSE 0 END) AS {name}" for i, name in enumerate(DAY_FEATURE_COLUMNS) if "missing" in name)
        + " FROM [events] GROUP BY user_id, CAST(ts AS DATE)",
        ("events",),
    ),
    "fx_activity_raw": (
        """
        SELECT CAST(user_id AS STRING) AS participant_id, event_id, ts AS timestamp,
            CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(least(value, 200.0)) AS INT) END AS heart_rate,
            CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'view' THEN NULL ELSE CAST(event_id % 120 AS INT) END AS steps,
            CASE WHEN event_type = 'signup' THEN CAST(event_id % 4 AS INT) END AS sleep_classic
        FROM [events]
        """,
        ("events",),
    ),
    "fx_intraday": (
        """
        SELECT CAST(user_id AS STRING) AS participant_id,
            CAST(ts AS DATE) AS dt, <agg> AS hour_level_str
        FROM (SELECT user_id, ts, event_id,
            CAST(event_id % 260 AS STRING) AS tok
        FROM [events]) t
        GROUP BY user_id,
            CAST(ts AS DATE)
        """,
        ("events",),
    ),
    # Days of exactly 24 tokens: the last value of each hour, 0 where there is none.
    "fx_full_day": (
        "SELECT CAST(user_id AS STRING) AS participant_id, CAST(ts AS DATE) AS dt, concat_ws(' ', "
        + ", ".join(f"CAST(coalesce(max(CASE WHEN extract(hour FROM ts) = {h} THEN event_id % 260 END), 0) AS STRING)" for h in range(24))
        + ") AS hour_level_str FROM [events] GROUP BY user_id, CAST(ts AS DATE)",
        ("events",),
    ),
    "fx_garmin_sleep": (
        """
        SELECT CAST(user_id AS STRING) AS id_participant_external, event_id, 3600 AS startTimeOffsetInSeconds, concat('{"light":[{"startTimeInSeconds":',
            CAST(1700000000 + event_id * 600 AS STRING), ',"endTimeInSeconds":',
            CAST(1700000000 + event_id * 600 + 300 AS STRING), '}],"rem":[]',
            CASE WHEN event_id % 2 = 0 THEN concat(',"awake":[{"startTimeInSeconds":',
            CAST(1700000300 + event_id * 600 AS STRING), ',"endTimeInSeconds":',
            CAST(1700000420 + event_id * 600 AS STRING), '}]') ELSE '' END, '}') AS sleepLevelsMap
        FROM [events]
        WHERE event_type = 'view'
        """,
        ("events",),
    ),
    "fx_metrics": (
        """
        SELECT concat('model_',
            CAST(l_linenumber AS STRING)) AS classifier_name, concat(l_returnflag, '-', l_linestatus) AS dataset_name, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS accuracy
        FROM [lineitem]
        GROUP BY l_linenumber, l_returnflag, l_linestatus
        """,
        ("lineitem",),
    ),
}
