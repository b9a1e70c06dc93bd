"""Packed strings, gap filling, windows, day features and joins."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsegrid.functions.columns import minute_flags
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import joins as J
from pulsegrid.operators import labels as L
from pulsegrid.operators import ordered as O
from pulsegrid.operators import reshape as R
from pulsegrid.operators import tasks as T
from pulsegrid.operators.day_features import ALL_FEATURES, day_features
from pulsegrid.plans import shared
from pulsegrid.plans.registry import Tables
from pulsegrid.streaming import downsample_stream

TS = dt.datetime
FOLDER = "/root/testdata/sf0.001"


def test_day_string_strict_and_trim(rows):
    df = rows([("p", dt.date(2024, 1, 1), "1 300 3 4")], "participant_id string, dt date, s string")
    out = R.explode_day_string(df, "s", "v", step_seconds=21600).orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.v) for r in out] == [(0, 1.0), (6, 200.0), (12, 3.0), (18, 4.0)]
    short = rows([("p", dt.date(2024, 1, 1), "1 x 3")], "participant_id string, dt date, s string")
    with pytest.raises(PySparkException):
        R.explode_day_string(short, "s", "v", step_seconds=21600).collect()
    trimmed = R.explode_day_string(short, "s", "v", step_seconds=43200, mode="trim").orderBy("timestamp").collect()
    assert [r.v for r in trimmed] == [1.0, None]
    assert R.explode_day_string(df.where("false"), "s", "v").count() == 0


def test_session_start_rounds(rows):
    df = rows([("p", TS(2024, 1, 1, 22, 59, 45), 2, "1 2")], "participant_id string, at timestamp_ntz, n int, s string")
    out = R.explode_session_string(df, "s", "v", start_col="at", slots_col="n").orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [TS(2024, 1, 1, 23, 0), TS(2024, 1, 1, 23, 1)]


def test_constant_over_duration(rows):
    df = rows([("p", TS(2024, 1, 1), 121, 3), ("p", TS(2024, 1, 2), 0, 3)], "participant_id string, at timestamp_ntz, sec int, v int")
    out = R.explode_constant(df, "v", start_col="at", seconds_col="sec").collect()
    assert [r.timestamp.minute for r in sorted(out)] == [0, 1, 2]


def test_last_wins_with_ties(rows):
    df = rows(
        [("p", TS(2024, 1, 1, 0, 0, 5), 1, 10), ("p", TS(2024, 1, 1, 0, 0, 5), 2, 20), ("p", TS(2024, 1, 1, 0, 0, 1), 3, 30)],
        "participant_id string, timestamp timestamp_ntz, seq int, v int",
    )
    out = R.last_per_slot(df, ["v"], ["timestamp", "seq"]).collect()
    assert [(r.timestamp, r.v) for r in out] == [(TS(2024, 1, 1), 20)]


def test_gap_minutes_differ_from_quiet_minutes(rows):
    df = rows(
        [("p", TS(2024, 1, 1, 23, 58), 60, 5, None), ("p", TS(2024, 1, 2, 0, 1), None, None, 2)],
        "participant_id string, timestamp timestamp_ntz, heart_rate int, steps int, sleep_classic int",
    )
    flagged = df.select("participant_id", "timestamp", *[c.alias(n) for n, c in minute_flags().items()])
    pages = R.gap_filled_pages(flagged, R.spine_defaults())
    out = R.pages_to_rows(pages, list(R.spine_defaults())).orderBy("timestamp").collect()
    assert [r.timestamp.minute for r in out] == [58, 59, 0, 1]
    assert [r.sleep_classic_0 for r in out] == [True, False, False, False]
    assert [r.missing_steps for r in out] == [False, True, True, True]
    assert [r.steps for r in out] == [5, 0, 0, 0]


def test_whole_missing_day_is_filled(rows):
    df = rows(
        [("p", TS(2024, 1, 1, 12), 1), ("p", TS(2024, 1, 3, 6), 2), ("q", TS(2024, 1, 1), 3)],
        "participant_id string, timestamp timestamp_ntz, steps int",
    )
    pages = R.gap_filled_pages(df, {"steps": F.lit(0)}, step_seconds=21600)
    found = {(r.participant_id, r.date.day): (r.first_slot, r.steps) for r in pages.collect()}
    assert found == {("p", 1): (2, [1, 0]), ("p", 2): (0, [0, 0, 0, 0]), ("p", 3): (0, [0, 2]), ("q", 1): (0, [3])}


def test_two_step_windows_equal_direct_windows(spark):
    series = shared.series_rows(Tables(spark, FOLDER), ["heart_rate", "steps"]).cache()
    channels = ["heart_rate", "steps"]
    paged = A.windows_from_series(series, channels, 3, shared.HOUR)
    direct = A.sliding_windows_direct(series, channels, 3, 72)
    assert paged.count() > 100
    assert paged.exceptAll(direct).count() == 0 and direct.exceptAll(paged).count() == 0


def test_windows_drop_nulls_in_the_counted_channel(rows):
    day = [("p", TS(2024, 1, 1, h), h if h else None, h) for h in range(0, 24, 12)]
    df = rows(day, "participant_id string, timestamp timestamp_ntz, a int, b int")
    assert A.windows_from_series(df, ["a", "b"], 1, 43200).count() == 0
    assert A.windows_from_series(df, ["b", "a"], 1, 43200).count() == 1


def test_rolling_days_across_blocks(spark):
    days = spark.range(100).select(F.lit("p").alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), "id")
    out = O.rolling_days(days, "k", "d", ["id"], 7, block_days=7).select(F.col("frame.id").alias("f"), "d").orderBy("d").collect()
    assert len(out) == 100
    assert all(r.f == list(range(max(0, i - 6), i + 1)) for i, r in enumerate(out))
    with pytest.raises(ValueError):
        O.rolling_days(days, "k", "d", ["id"], 7, block_days=3)


def test_day_features_on_one_day(rows):
    flags = [(True, 0), (True, 0), (False, 3), (False, 4), (False, 5), (True, 0)]
    data = [("p", dt.date(2024, 1, 1), TS(2024, 1, 1, i), 60 + i, s, False, False, i < 3, False, i >= 3, False) for i, (_, s) in enumerate(flags)]
    series = rows(
        data,
        "participant_id string, date date, timestamp timestamp_ntz, heart_rate int, steps int, missing_heart_rate boolean, "
        "missing_steps boolean, sleep_classic_0 boolean, sleep_classic_1 boolean, sleep_classic_2 boolean, sleep_classic_3 boolean",
    )
    sizes = O.streak_sizes(series, ["participant_id", "date"], "timestamp", F.col("steps") == 0).orderBy("streak").collect()
    # Runs of 2, 3 and 1 rows: the first run loses a row, the last row stands alone.
    assert [r.streak_size for r in sizes] == [1, 3, 1, 1]
    assert sum(r.streak_size for r in sizes) == 6
    row = day_features(series, ALL_FEATURES).first()
    assert row.total_steps == 12 and row.sleep_minutes == 3 and row.missing_hr == 0
    assert row.resting_hr_50th_percentile == 61
    with pytest.raises(NameError):
        day_features(series, ["nope"])


def test_streak_sizes_written_out(rows):
    # still, still | moving x3 | still x3 | moving: the first run loses its last row to the second,
    # every later run passes its last row on, and the last row of the day stands alone.
    cases = {(0, 0, 3, 4, 5, 0, 0, 0, 2): [1, 1, 1, 3, 3], (7,): [1], (0, 0, 0): [1, 2], (0, 1, 0): [1, 1, 1]}
    for steps, expected in cases.items():
        df = rows([("p", i, s) for i, s in enumerate(steps)], "p string, i int, steps int")
        assert sorted(r.streak_size for r in O.streak_sizes(df, ["p"], "i", F.col("steps") == 0).collect()) == expected


def test_event_expansion_sign(rows):
    df = rows([(dt.date(2024, 1, 10),)], "d date")
    days = [r.date.day for r in R.expand_event_dates(df, F.col("d"), -1, 5).collect()]
    assert days == [11, 12, 13, 14, 15]
    assert R.expand_event_dates(df, F.col("d"), -3, 1).count() == 0


# --- joins -------------------------------------------------------------------


def _asof(rows, left, right, **options):
    l = rows(left, "k string, lt timestamp_ntz, lid int")
    r = rows(right, "k string, rt timestamp_ntz, rid int")
    out = J.asof_backward(l, r, key="k", left_ts="lt", right_ts="rt", right_cols=["rid"], tie_col="rid", **options)
    return {x.lid: x.rid for x in out.collect()}


def test_asof_edges(rows):
    left = [("a", TS(2024, 1, 8), 1), ("a", TS(2024, 1, 8, 0, 0, 1), 2), ("a", TS(2024, 1, 1), 3), ("a", TS(2023, 12, 31), 4), ("b", TS(2024, 1, 1), 5), ("a", None, 6)]
    right = [("a", TS(2024, 1, 1), 10), ("a", TS(2024, 1, 1), 11), ("c", TS(2024, 1, 1), 12)]
    assert _asof(rows, left, right) == {1: 11, 2: None, 3: 11, 4: None, 5: None, 6: None}


def test_asof_matches_brute_force_with_a_heavy_key(rows):
    import random

    rng = random.Random(3)
    start = TS(2024, 1, 1)
    draw = lambda n, base: [
        ("hot" if rng.random() < 0.5 else rng.choice("abc"), start + dt.timedelta(minutes=rng.randrange(0, 40 * 1440, 7)), base + i)
        for i in range(n)
    ]
    left, right = draw(300, 0), draw(200, 1000)
    expected = {}
    for k, t, i in left:
        near = [(rt, ri) for rk, rt, ri in right if rk == k and rt <= t and rt >= t - dt.timedelta(days=7)]
        expected[i] = max(near)[1] if near else None
    assert _asof(rows, left, right) == expected
    assert _asof(rows, left, right, bucket_seconds=86400 * 5) == expected


def test_interval_semi_join(rows):
    results = rows([("a", dt.date(2024, 1, 5), 1), ("a", dt.date(2024, 3, 5), 2), ("b", dt.date(2024, 1, 5), 3)], "participant_id string, date date, i int")
    intervals = rows(
        [("a", dt.date(2024, 1, 5), dt.date(2024, 1, 6)), ("a", dt.date(2024, 1, 1), dt.date(2024, 12, 1)), ("b", dt.date(2024, 1, 6), dt.date(2024, 1, 1))],
        "participant_id string, start date, end date",
    )
    assert sorted(r.i for r in J.in_any_interval(results, intervals).collect()) == [1, 2]


def test_natural_join_needs_shared_columns(rows):
    with pytest.raises(ValueError):
        J.natural_join(rows([(1,)], "a int"), rows([(1,)], "b int"))


def test_spread_any_is_three_valued(rows):
    df = rows([("g", True), ("g", None), ("h", None), ("i", False)], "g string, f boolean")
    out = {(r.g, r.f): r.any for r in A.spread_any(df, "f", ["g"], "any").collect()}
    assert out == {("g", True): True, ("g", None): True, ("h", None): None, ("i", False): False}


def test_unit_variance_of_a_constant(rows):
    df = rows([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = A.unit_variance(df).orderBy("x").collect()
    assert [r.c for r in out] == [0.0, 0.0]
    assert out[1].x == pytest.approx(3 / 2**0.5)


# --- labels and tasks --------------------------------------------------------


def test_sequential_label_edges(rows):
    end = TS(2024, 1, 8)
    df = rows(
        [("a", end, "a", end, 1), ("a", end, "a", end + dt.timedelta(hours=23, minutes=59), 2), ("a", end, "a", end + dt.timedelta(days=1), 3),
         ("a", end, "a", end - dt.timedelta(seconds=1), 4), ("a", end, "b", end, 5)],
        "participant_id_l string, end_l timestamp_ntz, participant_id_r string, start_r timestamp_ntz, i int",
    )
    assert [r.v for r in df.orderBy("i").select(L.sequential().alias("v")).collect()] == [1, 1, 0, 0, 0]


def test_rolling_vectors_default():
    assert L.default_day_vector(["x", "missing_y", "z"], 2) == [0.0, 1.0, 0.0, 0.0, 1.0, 0.0]


def test_task_registry_and_autoencoder(spark):
    tables = Tables(spark, FOLDER)
    with pytest.raises(NameError):
        T.task_labels("nope", {})
    windows = shared.week_windows(tables, shared.CHANNELS)
    plain = T.labelled_windows(windows, L.flu_positive(tables("fx_lab_results")), T.NO_MISSING_FLAG_FIELDS, normalize=True)
    row = plain.first()
    assert set(T.NO_MISSING_FLAG_FIELDS) < set(plain.columns) and row.end_date_str.endswith("23:59:59.999")
    assert abs(sum(row.steps)) < 1e-6
    target = T.labelled_windows(windows, None, ["steps"], autoencoder=True)
    assert "label" not in target.columns
    vectors = T.task_labels("daily_features", {"day_level": tables("fx_day_level")}, columns=["nap_count"], days=1)
    daily = T.labelled_windows(windows, vectors, [], default=F.array(F.lit(0.0)))
    assert daily.schema["label"].dataType.simpleString() == "array<double>"


def test_channel_length_mismatch(rows):
    bad = rows([([1, 2], [1])], "a array<int>, b array<int>")
    with pytest.raises(PySparkException):
        T.channel_length(bad).collect()
    with pytest.raises(ValueError):
        T.channel_length(bad, ["zzz"])


def test_stack_and_flatten(rows):
    df = rows([([1, 2], [3, 4])], "b array<int>, a array<int>")
    flat = R.flatten_matrix(R.stack_channels(df, ["b", "a"])).first()
    assert flat.inputs == [[1.0, 3.0], [2.0, 4.0]] and flat.features == [1.0, 3.0, 2.0, 4.0]
    assert R.stack_channels(df).first().inputs == [[3.0, 1.0], [4.0, 2.0]]


def test_downsample_on_a_stream(spark, rows, tmp_path):
    df = rows(
        [("p", TS(2024, 1, 1, 0, m), m, m == 3) for m in range(10)], "participant_id string, timestamp timestamp_ntz, steps int, flag boolean"
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        downsample_stream(stream, "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory")
        .queryName("pulse_down").option("checkpointLocation", str(tmp_path / "check")).start()
    )
    query.processAllAvailable()
    query.stop()
    out = spark.sql("SELECT steps, flag FROM pulse_down ORDER BY timestamp").collect()
    assert [tuple(r) for r in out] == [(2, True), (7, False)]
