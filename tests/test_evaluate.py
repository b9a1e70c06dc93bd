"""Metrics, resampling, rank tests, splits and plan checks."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import evaluate as E
from pulsegrid.operators import mljobs as M
from pulsegrid.operators import ordered as O
from pulsegrid.operators import ranktests as K
from pulsegrid.operators import resampling as B
from pulsegrid.operators import split as S
from pulsegrid.plans import all_queries, shared
from pulsegrid.plans.registry import Tables


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        label = int(rng.random() < 0.3)
        data.append((i, label, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * label, 0.2))), 2)))
    return spark.createDataFrame(data, "id int, label int, pred double").cache()


def pairwise_auc(data):
    wins = [(p > n) + 0.5 * (p == n) for (_, a, p), (_, b, n) in itertools.product(data, data) if a == 1 and b == 0]
    return sum(wins) / len(wins)


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 1_000_000])
def test_prefix_sums_any_bucketing(spark, rows_per_bucket):
    rng = random.Random(1)
    # Most values crowd into a millionth of the range.
    values = sorted({rng.random() * 1e-6 for _ in range(300)} | {rng.random() for _ in range(20)} | {1000.0})
    df = spark.createDataFrame([(g, v, i % 7) for g in "ab" for i, v in enumerate(values)], "g string, v double, n int")
    out = O.prefix_sums(df, "v", ["n"], by=["g"], rows_per_bucket=rows_per_bucket).where("g = 'b'").orderBy("v").collect()
    running = 0
    for row in out:
        assert row.n_before == running
        running += row.n
    assert running == out[0].n_total and len(out) == len(values)


def _bucket_sizes(df, target):
    """Rows per bucket of a prefix-sum plan: rows that share a window partition."""
    sized = df.withColumn("_g", df.agg(F.struct(F.count(F.lit(1)).alias("n"))).scalar())
    sample = df.where(F.pmod(F.xxhash64("v"), F.lit(1 << 32)) * df.count() < float(O.SAMPLE_ROWS << 32))
    cuts = O._splitters(F.array(*[F.lit(r.v) for r in sample.orderBy("v").collect()][:: 16]), F.lit(-(-df.count() // target)))
    return [r["count"] for r in sized.select(O._bucket(F.col("v"), cuts).alias("b")).groupBy("b").count().collect()]


@pytest.mark.parametrize("shape", ["pow(10, rand(1) * 12)", "if(rand(2) < 0.9, 1 + rand(3) * 1e-9, rand(4) * 1e6)"])
def test_buckets_are_even_for_heavy_tails(spark, shape):
    df = spark.range(60_000).select(F.expr(shape).alias("v")).distinct().persist()
    assert max(_bucket_sizes(df, 2000)) <= 4000
    total = O.prefix_sums(df.withColumn("n", F.lit(1)), "v", ["n"], rows_per_bucket=2000)
    ranked = total.orderBy("v").select("n_before", "n_total").collect()
    assert [r.n_before for r in ranked] == list(range(len(ranked))) and ranked[0].n_total == len(ranked)


def test_prefix_sums_of_integers_beyond_doubles(rows):
    values = [2**53 + i for i in range(5)]
    out = O.prefix_sums(rows([(v, 1) for v in values], "v long, n int"), "v", ["n"], rows_per_bucket=2).orderBy("v").collect()
    assert [(r.v, r.n_before) for r in out] == [(v, i) for i, v in enumerate(values)]


def test_prefix_sums_single_value(rows):
    assert O.prefix_sums(rows([(2.0, 5)], "v double, n int"), "v", ["n"]).first().n_before == 0


def test_midrank_ties_and_nulls(rows):
    df = rows([(3.0,), (1.0,), (3.0,), (None,)], "v double")
    assert sorted((r.v or 0, r.midrank) for r in O.midrank(df, "v").collect() if r.v) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5)]
    assert O.midrank(df, "v").where("v IS NULL").first().midrank is None


def test_exact_quantile_equals_percentile(spark):
    df = spark.range(101).select((F.col("id") % 3).alias("g"), F.pow(F.col("id"), F.lit(2)).alias("v"))
    for q in (0.0, 0.31, 0.5, 0.95, 1.0):
        ours = {r.g: r["quantile"] for r in O.exact_quantile(df, "v", q, ["g"]).collect()}
        for row in df.groupBy("g").agg(F.percentile("v", q).alias("p")).collect():
            assert ours[row.g] == pytest.approx(row.p)


def test_hash_rank_is_dense(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    ranks = [r.hash_rank for r in O.hash_rank(df, ["id"], "s", by=["g"]).where("g = 1").collect()]
    assert sorted(ranks) == list(range(1, 501))


def test_roc_auc_and_its_mirror(preds):
    expected = pairwise_auc([tuple(r) for r in preds.collect()])
    assert E.rank_metrics(preds).first().roc_auc == pytest.approx(expected)
    flipped = preds.withColumn("pred", -F.col("pred"))
    assert E.rank_metrics(flipped).first().roc_auc == pytest.approx(1 - expected)


def test_one_class_is_undefined(rows):
    row = E.rank_metrics(rows([(1, 0.2), (1, 0.8)], "label int, pred double")).first()
    assert row.roc_auc is None and row.pr_auc == pytest.approx(1.0)
    none = E.rank_metrics(rows([(0, 0.2), (0, 0.8)], "label int, pred double")).first()
    assert none.roc_auc is None and none.pr_auc is None


def test_pr_points_end_at_prevalence(preds):
    last = E.pr_points(preds).orderBy("threshold").first()
    share = preds.agg(F.avg("label")).first()[0]
    assert last.recall == 1.0 and last.precision == pytest.approx(share)


def test_det_curve_is_trimmed(rows):
    df = rows([(0, 0.1), (0, 0.2), (1, 0.3), (0, 0.4), (1, 0.8), (1, 0.9)], "label int, pred double")
    points = {r.threshold: (r.fpr, r.fnr) for r in E.det_points(df).collect()}
    # 0.9 has no false positive and neither has 0.8; 0.3 is the first to find all positives.
    assert set(points) == {0.8, 0.4, 0.3}
    assert points[0.3] == (pytest.approx(1 / 3), 0.0)


def test_bootstrap_centres_on_the_estimate(preds):
    estimate = E.rank_metrics(preds).first()
    replicates = B.bootstrap_metrics(preds, 60).cache()
    ci = {r.metric: r for r in B.interval(replicates, ["roc_auc", "pr_auc"]).collect()}
    for metric in ("roc_auc", "pr_auc"):
        assert ci[metric].mean == pytest.approx(estimate[metric], abs=0.02)
        assert ci[metric].ci_low < estimate[metric] < ci[metric].ci_high


def test_hierarchical_draws_all_positions(preds):
    models = preds.withColumn("model", F.lit("a")).unionByName(preds.withColumn("model", F.lit("b")))
    draws = B.model_draws(models, 50).groupBy("replicate").agg(F.sum("draws").alias("n")).collect()
    assert all(r.n == 2 for r in draws)
    same = B.hierarchical_bootstrap(models, 4).orderBy("replicate").collect()
    single = B.bootstrap_metrics(preds, 4, metrics=["roc_auc"]).orderBy("replicate").collect()
    assert [r.roc_auc for r in same] == pytest.approx([r.roc_auc for r in single])


def _resample(preds, replicate):
    """The rows of one replicate, each as often as it is drawn."""
    drawn = B.replicate_weights(preds, replicate, replicate).withColumn("w", F.col("weights")[0])
    return drawn.withColumn("_", F.explode(F.when(F.col("w") > 0, F.sequence(F.lit(1), "w"))))


def test_regression_interval(preds):
    statistics = {"mean": "sum({w} * pred) / sum({w})", "variance": E.weighted_explained_variance()}
    rows = {r.metric: r for r in B.regression_interval(preds, 40, statistics).collect()}
    for name, value in (("mean", F.avg("pred")), ("variance", E.explained_variance())):
        assert rows[name].ci_low < preds.agg(value).first()[0] < rows[name].ci_high
        replicates = [_resample(preds, r).agg(value).first()[0] for r in (1, 2)]
        two = {r.metric: r for r in B.regression_interval(preds, 2, statistics).collect()}[name]
        assert two.mean == pytest.approx(sum(replicates) / 2)
        assert two.ci_high - two.mean == pytest.approx(abs(replicates[0] - replicates[1]) * math.sqrt(2))


def test_every_replicate_is_the_metric_of_its_resample(preds, monkeypatch):
    """Across chunk borders: each replicate equals the plain metric over the rows drawn in it."""
    monkeypatch.setattr(B, "CHUNK", 4)
    grouped = preds.withColumn("g", F.col("id") % 2)
    metrics = ["roc_auc", "pr_auc", "average_precision"]
    found = {(r.g, r.replicate): r for r in B.bootstrap_metrics(grouped, 6, metrics=metrics, by=["g"]).collect()}
    assert set(found) == {(g, r) for g in (0, 1) for r in range(1, 7)}
    for r in (1, 4, 6):
        for row in E.rank_metrics(_resample(grouped, r), metrics, by=["g"]).collect():
            assert [found[row.g, r][m] for m in metrics] == pytest.approx([row[m] for m in metrics])


def test_prefix_vectors_any_bucketing(spark):
    df = spark.createDataFrame([(g, float(v), [float(v % 3), 1.0]) for g in "ab" for v in range(40)], "g string, v double, c array<double>")
    for size in (3, 1000):
        for row in O.prefix_vectors(df, "v", "c", ["g"], size).collect():
            assert row.c_before == [float(sum(x % 3 for x in range(int(row.v)))), row.v] and row.c_total == [39.0, 40.0]


def _shuffled_rows(spark, df):
    """Rows that the stages of a run write for shuffles."""
    sc = spark.sparkContext
    group = f"count-{id(df)}"
    sc.setJobGroup(group, "shuffled rows")
    df.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    store = sc._jsc.sc().statusStore()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    total = 0
    for s in stages:
        if sc.statusTracker().getStageInfo(s) is not None:
            total += store.lastStageAttempt(s).shuffleWriteRecords()
    return total


def test_shuffled_rows_do_not_grow_with_the_replicates(spark, preds):
    few, many = (_shuffled_rows(spark, B.bootstrap_metrics(preds, n, metrics=["roc_auc"])) for n in (2, 100))
    assert 0 < many <= few


def test_delong_against_itself(preds):
    both = preds.withColumn("other", F.col("pred"))
    row = E.delong(both, "pred", "other").first()
    assert row.var_a == pytest.approx(row.cov_ab)
    assert row.auc_a == pytest.approx(E.rank_metrics(preds).first().roc_auc)


def test_delong_p_value(preds):
    noisy = preds.withColumn("other", F.abs(F.sin(F.col("id"))))
    row = E.delong_test(noisy, "pred", "other").first()
    assert row.log10_p == pytest.approx(math.log10(math.erfc(row.z / math.sqrt(2))))
    assert row.log10_p < -2


def test_losses(rows):
    row = E.loss_metrics(rows([(1, 0.8), (0, 0.4)], "label int, pred double")).first()
    assert row.cross_entropy == pytest.approx(-(math.log(0.8) + math.log(0.6)) / 2)
    assert row.mse == pytest.approx((0.04 + 0.16) / 2)


def test_precision_at_k_with_ties(rows):
    df = rows([(i, int(i < 3), 0.5 if i else 0.9) for i in range(10)], "id int, label int, pred double")
    out = {r.k: r for r in S.precision_at_k(df, [1, 0.5, 20]).collect()}
    assert out["1"].precision_at_k == 1.0
    assert out["0.5"].n_top == 5 and 0.2 <= out["0.5"].precision_at_k <= 0.6
    assert out["20"].precision_at_k == pytest.approx(0.3)


# --- rank tests --------------------------------------------------------------


def _benchmark(rows, table):
    return rows([(m, f"d{j}", float(v)) for m, vs in table.items() for j, v in enumerate(vs)], "classifier_name string, dataset_name string, accuracy double")


def test_friedman_known_value(rows):
    # Ranks 1, 2, 3 in each of four datasets: statistic = n * (k - 1) = 8.
    df = _benchmark(rows, {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8], "c": [9, 10, 11, 12]})
    row = K.friedman(df).first()
    assert row.statistic == pytest.approx(8.0) and row.p_value == pytest.approx(math.exp(-4))
    partial = _benchmark(rows, {"a": [1, 2, 3, 4, 9], "b": [5, 6, 7, 8], "c": [9, 10, 11, 12, 1]})
    assert K.friedman(partial).first() == row  # the fifth dataset lacks a model


def test_wilcoxon_pratt_and_holm(rows):
    n = 12
    df = _benchmark(rows, {"a": [i for i in range(n)], "b": [i + 1 + i / 10 for i in range(n)], "c": [i for i in range(n)]})
    out = {(r.model_a, r.model_b): r for r in K.wilcoxon_pairs(df).collect()}
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    assert out["a", "b"].statistic == 0 and out["a", "b"].z == pytest.approx(-mean / math.sqrt(var))
    assert out["a", "b"].significant and out["b", "c"].significant
    assert out["a", "c"].p_value is None and not out["a", "c"].significant
    groups = [tuple(r.members) for r in K.inseparable_groups(K.wilcoxon_pairs(df)).collect()]
    assert groups == [("a", "c"), ("b",)]


def test_legacy_holm_is_laxer(rows):
    df = _benchmark(rows, {m: [random.Random(ord(m) * 31 + j).random() + (j % 3) * 0.1 * ord(m) for j in range(9)] for m in "abcd"})
    strict = K.wilcoxon_pairs(df).where("significant").count()
    assert strict <= K.wilcoxon_pairs(df, legacy=True).where("significant").count()


# --- splits ------------------------------------------------------------------


def test_splits_are_disjoint_and_exhaustive(spark):
    df = spark.range(3000).select((F.col("id") % 101).cast("string").alias("participant_id"), "id")
    out = S.user_split(df, eval_frac=0.4, test_frac=0.5)
    assert out.count() == 3000
    assert out.select("participant_id", "split").distinct().count() == 101
    sides = {r.split: r.n for r in out.groupBy("split").agg(F.count_distinct("participant_id").alias("n")).collect()}
    assert sides == {"test": 20, "eval": 20, "train": 61}
    two = S.two_way_split(df, 0.25).groupBy("side").agg(F.count_distinct("participant_id").alias("n")).collect()
    assert {r.side: r.n for r in two} == {"left": 25, "right": 76}


def test_caps_and_ids_are_repeatable(spark):
    df = spark.range(500)
    first = sorted(r.id for r in S.row_cap(df, 40, ["id"]).collect())
    assert len(first) == 40 and first == sorted(r.id for r in S.row_cap(df.repartition(7), 40, ["id"]).collect())
    ids = S.surrogate_id(df.withColumnRenamed("id", "k"), ["k"])
    assert ids.select("id").distinct().count() == 500


def test_random_reconstruction_draws_training_rows(spark):
    train = spark.range(50).select("id", (F.col("id") * 10).alias("x"))
    evaluation = spark.range(200).select("id", F.lit(-1).cast("bigint").alias("x"))
    out = M.random_reconstructions(train, evaluation, "x").collect()
    assert len(out) == 200 and all(r.pred % 10 == 0 and r.target == -1 for r in out)


# --- plans -------------------------------------------------------------------

FOLDER = "/root/testdata/sf0.001"
SCALE_CHECKED = [
    "a2_tumbling_downsample", "a3_sliding_windows", "r1_explode_day_string", "r5_gap_filled_spine", "j1_channel_alignment",
    "j3_asof_backward_7d", "j4_range_semi_join", "j8_same_participant_pairs", "l9_clean_annotation", "t1_flu_positive_windows", "f5_steps_moving_streak_95th_percentile",
]


@pytest.mark.parametrize("name", SCALE_CHECKED)
def test_no_single_task_step_and_no_python(name, spark):
    plan = all_queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for banned in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = shared.week_windows(Tables(spark, FOLDER), ["steps"])._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_date_filter_reaches_the_scan(spark):
    plan = all_queries.QUERIES["p3_half_open_cut"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
