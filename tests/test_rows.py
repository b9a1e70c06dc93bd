"""Row expressions, filters, sources and schemas on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.functions.clause import clause
from pulsegrid.functions.hashing import fraction_threshold, hash_below, hash_prefix, poisson_weight
from pulsegrid.functions.tails import chi2_upper, normal_log10_two_sided, normal_two_sided
from pulsegrid.operators import filters as P
from pulsegrid.sources import readers, schemas, sinks
from pulsegrid.sources.catalog import Catalog, TableSpec

TS = dt.datetime


def values(df, column="v"):
    return [row[column] for row in df.collect()]


def test_clip_keeps_null(rows):
    df = rows([(None,), (250.0,), (-1.0,)], "x double")
    assert values(df.select(C.clip("x", 0, 200).alias("v"))) == [None, 200.0, 0.0]


def test_clause_operators_and_quotes(rows):
    df = rows([(1, 0, "a|b"), (0, 0, "x"), (None, 1, None), (None, 0, None)], "a int, b int, s string")
    assert values(df.select(clause("a > 0 | b > 0").alias("v"))) == [True, False, True, False]
    assert values(df.select(clause("(s == 'a|b') & (a > 0)").alias("v"))) == [True, False, False, False]
    assert values(df.select(clause('s == "a|b"').alias("v"))) == [True, False, False, False]


def test_label_date_of_exclusive_midnight(rows):
    df = rows([(TS(2024, 1, 8),), (TS(2024, 1, 8, 0, 0, 1),)], "e timestamp_ntz")
    assert values(df.select(C.label_date("e").alias("v"))) == [dt.date(2024, 1, 7), dt.date(2024, 1, 8)]


def test_rounding_is_half_to_even(rows):
    df = rows([(TS(2024, 1, 1, 0, 0, 30),), (TS(2024, 1, 1, 0, 1, 30),), (TS(2024, 1, 1, 0, 0, 30, 1),)], "t timestamp_ntz")
    minutes = [v.minute for v in values(df.select(C.round_to_step("t").alias("v")))]
    assert minutes == [0, 2, 1]


def test_epoch_nanos_ignore_host_zone(rows, spark):
    df = rows([(1_700_000_000_999_999_999,)], "n bigint")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert values(df.select(C.epoch_nanos_to_ts("n").alias("v"))) == [TS(2023, 11, 14, 22, 13, 20)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numeric_or_and_last_token(rows):
    df = rows([("3.5", "a|2024-01-02"), ("x", "a|bad"), (None, None)], "n string, t string")
    assert values(df.select(C.numeric_or("n").alias("v"))) == [3.5, -1.0, -1.0]
    assert values(df.select(C.last_token_timestamp("t").alias("v"))) == [TS(2024, 1, 2), None, None]


def test_flags_and_one_hot(rows):
    df = rows([(None, None, None), (0, 3, 2), (60, 0, 0)], "heart_rate int, steps int, sleep_classic int")
    out = df.select(*[c.alias(n) for n, c in C.minute_flags().items()]).collect()
    assert [r.missing_heart_rate for r in out] == [True, True, False]
    assert [r.missing_steps for r in out] == [True, False, False]
    assert [r.steps for r in out] == [0, 3, 0]
    assert [(r.sleep_classic_0, r.sleep_classic_2) for r in out] == [(True, False), (False, True), (True, False)]


def test_zscore_with_constant_channel(rows):
    df = rows([([1, 1, 1],), ([1, 2, 3],)], "x array<int>")
    flat, scaled = values(df.select(C.window_zscore("x").alias("v")))
    assert flat == [1.0, 1.0, 1.0]
    assert scaled == pytest.approx([-1.224744871, 0.0, 1.224744871])


def test_softmax_is_stable(rows):
    df = rows([([1000.0, 1000.0],), ([0.0, 1.0],)], "x array<double>")
    assert values(df.select(C.softmax_last("x").alias("v"))) == pytest.approx([0.5, 0.731058578])


def test_hash_fractions(spark):
    assert fraction_threshold(0.5) == "80000000"
    with pytest.raises(ValueError):
        fraction_threshold(1.5)
    share = spark.range(20000).where(hash_below(0.3, "s", F.col("id"))).count() / 20000
    assert share == pytest.approx(0.3, abs=0.02)
    stats = (
        spark.range(20000).withColumn("h", hash_prefix("b", F.col("id"))).select(poisson_weight(F.col("h")).alias("w"))
        .agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    )
    assert stats.m == pytest.approx(1, abs=0.03) and stats.v == pytest.approx(1, abs=0.05)


def test_tails(rows):
    zs = rows([(0.0,), (0.3,), (1.959963985,), (2.8284,), (2.829,), (8.0,), (50.0,), (None,)], "z double")
    for r in zs.select("z", normal_two_sided("z").alias("p"), normal_log10_two_sided("z").alias("log_p")).collect():
        if r.z is None:
            assert r.p is None and r.log_p is None
        elif r.z < 30:
            assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-12)
            assert r.log_p == pytest.approx(math.log10(r.p), abs=1e-12)
        else:
            assert r.log_p == pytest.approx(-544.666, abs=0.01)
    xs = rows([(3.841458821, 1, 0.05), (30.0, 6, 3.930849e-05), (7.814727903, 3, 0.05), (-1.0, 2, 1.0), (None, 3, None)], "x double, k int, p double")
    for r in xs.select("p", chi2_upper("x", F.col("k")).alias("q")).collect():
        assert r.q is None if r.p is None else r.q == pytest.approx(r.p, rel=1e-5)


def test_rename_and_lists(rows):
    df = rows([("1", 1), ("2", 2)], "id string, x int")
    assert P.rename_columns(df, P.parse_rename_list(["x:y"])).columns == ["id", "y"]
    with pytest.raises(ValueError):
        P.rename_columns(df, ["x"])
    listed = rows([("1",), ("1",)], "id string")
    assert P.keep_listed(df, listed, "id").count() == 1
    assert values(P.drop_listed(df, listed, "id"), "id") == ["2"]


def test_consent_skips_unparsable_ids(rows):
    df = rows([("7",), ("abc",)], "id string")
    assert values(P.keep_consented(df, rows([(7,)], "consent_id bigint"), "id"), "id") == ["7"]


def test_single_date_bound(rows):
    df = rows([(dt.date(2024, 1, d),) for d in (1, 2, 3)], "date date")
    assert P.between_dates(df, "date", max_date="2024-01-02").count() == 2
    assert P.cut_dates(df, "date", "2024-01-02", "2024-01-03").count() == 1


def test_overrides(rows):
    df = rows([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    out = P.override_cells(df, rows([("b", 9)], "k string, n int"), "k").orderBy("k").collect()
    assert [tuple(r) for r in out] == [("a", 1, "x"), ("b", 9, "y")]


# --- sources -----------------------------------------------------------------


def test_csv_date_sniffing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("participant_id,test_date,sometimes,n\n007,2024-01-02,2024-01-01,1\n8,2024-01-03,maybe,2\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"participant_id": "string", "test_date": "timestamp_ntz", "sometimes": "string", "n": "int"}
    assert df.first().participant_id == "007"


def test_csv_types_from_one_pass(spark, tmp_path):
    header = "participant_id,i,l,d,b,t,none,mixed,some_time,odd x"
    (tmp_path / "t.csv").write_text(header + "\n1,1,1,1,true,a,,1,2024-01-01 10:00:00,5\n2,-5,3000000000,1.5,FALSE,1,,x,,6\n3,,,NaN,,,,2.5,2024-01-01,7\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {
        "participant_id": "string", "i": "int", "l": "bigint", "d": "double", "b": "boolean", "t": "string", "none": "string",
        "mixed": "string", "some_time": "timestamp_ntz", "odd x": "int",
    }
    assert [r.l for r in df.collect()] == [1, 3000000000, None] and df.first().some_time == dt.datetime(2024, 1, 1, 10)
    (tmp_path / "empty.csv").write_text("participant_id,a_date,n\n")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).collect() == []
    (tmp_path / "ids.csv").write_text("participant_id\n007\n")
    assert readers.read_csv(spark, str(tmp_path / "ids.csv")).first()[0] == "007"


def test_round_trips(spark, tmp_path, rows):
    df = rows([("1", dt.date(2024, 1, 1), 1.5), ("2", dt.date(2024, 1, 2), None)], "participant_id string, date date, x double")
    sinks.write_parquet(df, str(tmp_path / "p"), ["date"], files_per_partition=2, spread_by=["participant_id"])
    back = readers.read_parquet(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert "PartitionFilters: [isnotnull(date" in _plan(back.where("date = '2024-01-01'"))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert readers.read_json_lines(spark, str(tmp_path / "j"), df.schema).count() == 2
    sinks.write_csv(df.select("participant_id", "date"), str(tmp_path / "c"))
    assert readers.read_participant_dates(spark, str(tmp_path / "c")).orderBy("date").first().date == dt.date(2024, 1, 1)
    sinks.write_parquet(df.drop("x"), str(tmp_path / "g" / "one"))
    sinks.write_parquet(df, str(tmp_path / "g" / "two"))
    merged = readers.read_parquet(spark, str(tmp_path / "g" / "*"), merge_schema=True)
    assert merged.count() == 4 and "x" in merged.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_participant_pairs(spark):
    df = readers.participant_dates_from_pairs(spark, [(1, "2024-01-01"), ("2", "2024-01-02")])
    assert df.orderBy("participant_id").first().date == dt.date(2024, 1, 1)


def test_catalog(spark, tmp_path, rows, monkeypatch):
    rows([("1",)], "participant_id string").write.parquet(str(tmp_path / "real" / "t"))
    rows([("1",), ("2",)], "participant_id string").write.parquet(str(tmp_path / "debug" / "t"))
    specs = {"t": TableSpec("t")}
    assert Catalog(spark, str(tmp_path / "real"), str(tmp_path / "debug"), specs).table("t").count() == 1
    monkeypatch.setenv("DEBUG_DATA", "1")
    catalog = Catalog(spark, str(tmp_path / "real"), str(tmp_path / "debug"), specs)
    catalog.register("t")
    assert spark.sql("SELECT count(*) AS n FROM t").first().n == 2
    with pytest.raises(ValueError):
        catalog.table("nope")


def test_window_schema(rows):
    schema = schemas.window_schema(schemas.MINUTE_ACTIVITY, 3, {"heart_rate": "hr"})
    assert "date" not in schema.names and schema["hr"].metadata == {"length": 3}
    pair = schemas.pair_schema(schema)
    assert len(pair) == 2 * len(schema) and pair["hr_l"].metadata == {"length": 3}
    short = rows([([1, 2],)], "hr array<smallint>")
    wanted = schemas.T.StructType([schema["hr"]])
    with pytest.raises(PySparkException):
        schemas.check_lengths(short, wanted).collect()
    assert schemas.narrow_doubles(rows([([1.0], 2.0)], "a array<double>, b double")).dtypes == [("a", "array<float>"), ("b", "float")]


def test_conform_rejects_out_of_range(rows):
    schema = schemas._struct("steps smallint")
    with pytest.raises(PySparkException):
        schemas.conform(rows([(70000,)], "steps int"), schema).collect()
    with pytest.raises(ValueError):
        schemas.conform(rows([(1,)], "x int"), schema)
