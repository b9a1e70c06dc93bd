"""Rank tests over a table of (model, dataset, accuracy).

Such tables have one row per benchmark run, thousands at most; they stay
DataFrames so a test can follow the evaluation in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.tails import chi2_upper, normal_two_sided
from pulsegrid.operators.ordered import prefix_sums

MODEL, DATASET, VALUE = "classifier_name", "dataset_name", "accuracy"


def _ranks(df: DataFrame, descending: bool) -> DataFrame:
    """Midrank of each model within each dataset (a dataset holds one row per model)."""
    order = F.col(VALUE).desc() if descending else F.col(VALUE).asc()
    rank = F.rank().over(W.partitionBy(DATASET).orderBy(order))
    ties = F.count(F.lit(1)).over(W.partitionBy(DATASET, VALUE))
    return df.withColumn("_ties", ties).withColumn("rank", rank + (F.col("_ties") - 1) / F.lit(2.0))


def average_ranks(df: DataFrame) -> DataFrame:
    """Mean rank and number of outright wins per model, best accuracy = rank 1."""
    return _ranks(df, descending=True).groupBy(MODEL).agg(
        F.avg("rank").alias("average_rank"), F.count_if(F.col("rank") == 1.0).alias("wins")
    )


def friedman(df: DataFrame) -> DataFrame:
    """Friedman statistic with tie correction and its chi-square p-value (one row).

    The test compares ranks within blocks that hold every model; datasets that
    some model was not run on are left out.
    """
    models = df.agg(F.count_distinct(MODEL)).scalar()
    whole = df.groupBy(DATASET).agg(F.count_distinct(MODEL).alias("_k")).where(F.col("_k") == models)
    ranked = _ranks(df.join(whole.select(DATASET), DATASET, "left_semi"), descending=False)
    per_model = ranked.groupBy(MODEL).agg(F.sum("rank").alias("rank_sum"))
    tie_groups = ranked.groupBy(DATASET, VALUE).agg(F.count(F.lit(1)).alias("t"))
    ties = tie_groups.agg(F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).cast("double")).scalar()
    n = ranked.agg(F.count_distinct(DATASET).cast("double")).scalar()
    stats = per_model.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"))
    k = F.col("k")
    raw = F.lit(12.0) / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    correction = F.lit(1.0) - F.try_divide(ties, k * (k * k - 1) * n)
    return stats.withColumn("statistic", F.try_divide(raw, correction)).select(
        "statistic", chi2_upper("statistic", (k - 1).cast("int")).alias("p_value")
    )


def wilcoxon_pairs(df: DataFrame, alpha: float = 0.05, legacy: bool = False) -> DataFrame:
    """Signed-rank test of every two models, zeros ranked but not counted (Pratt), normal tail.

    ``significant`` follows Holm: p-values in ascending order are compared with
    alpha / (pairs left) until the first failure; ``legacy`` compares each with
    alpha itself.
    """
    left = df.select(F.col(MODEL).alias("model_a"), DATASET, F.col(VALUE).alias("_a"))
    right = df.select(F.col(MODEL).alias("model_b"), DATASET, F.col(VALUE).alias("_b"))
    diffs = left.join(right, DATASET).where("model_a < model_b").withColumn("_d", F.col("_a") - F.col("_b"))
    pair = ["model_a", "model_b"]
    size = F.abs("_d")
    ranked = (
        diffs.withColumn("_ties", F.count(F.lit(1)).over(W.partitionBy(*pair, size)))
        .withColumn("_rank", F.rank().over(W.partitionBy(*pair).orderBy(size)) + (F.col("_ties") - 1) / F.lit(2.0))
    )
    n, zeros = F.col("n").cast("double"), F.col("zeros").cast("double")
    sums = ranked.groupBy(*pair).agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("r_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("r_minus"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_d") == 0).alias("zeros"),
        # Per row (t*t - 1) adds up to t**3 - t per group of t tied non-zero sizes.
        F.sum(F.when(F.col("_d") != 0, F.col("_ties") * F.col("_ties") - 1).otherwise(0)).alias("tie_sum"),
    )
    mean = (n * (n + 1) - zeros * (zeros + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - zeros * (zeros + 1) * (2 * zeros + 1) - F.col("tie_sum") / 2) / 24
    scored = sums.withColumn("statistic", F.least("r_plus", "r_minus")).withColumn(
        "z", F.try_divide(F.col("statistic") - mean, F.sqrt(var))
    ).withColumn("p_value", normal_two_sided("z"))
    # One row per pair of models: a few hundred at most.
    by_p = W.orderBy(F.col("p_value").asc_nulls_last(), *pair)
    step = F.row_number().over(by_p) - 1
    pairs = F.count(F.lit(1)).over(W.partitionBy())
    limit = F.lit(alpha) if legacy else F.lit(alpha) / (pairs - step)
    # Two models without any difference have no p-value and are not separated.
    passed = scored.withColumn("_ok", F.coalesce(F.col("p_value") <= limit, F.lit(False)))
    return passed.withColumn(
        "significant", F.min(F.col("_ok").cast("int")).over(by_p.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1
    ).select(*pair, "statistic", "z", "p_value", "significant")


def inseparable_groups(pairs: DataFrame) -> DataFrame:
    """Maximal sets of models none of which differ significantly, as (group, members).

    The maximal cliques of the models that go together, searched with a pivot:
    a row is a set with the models that may still join it and those that were
    tried before. It grows only by models that do not go with the pivot, the
    one most candidates go with, since every maximal set holds the pivot or one
    of them. Models that all tie are thus one row from start to end, where
    growing every set would take 2**n. Rounds are projections of the rows of the
    round before; ``ROUNDS_AT_ONCE`` of them make a job.
    """
    alike = pairs.where(~F.col("significant")).select("model_a", "model_b")
    both = alike.union(alike.select(F.col("model_b"), F.col("model_a"))).toDF("m", "o")
    names = pairs.select(F.col("model_a").alias("m")).union(pairs.select("model_b")).distinct()
    friends = names.join(both.groupBy("m").agg(F.collect_set("o").alias("o")), "m", "left").selectExpr("m", "coalesce(o, array()) AS o")
    # One row: the models and who goes with whom.
    start = friends.agg(F.map_from_entries(F.collect_list(F.struct("m", "o"))).alias("goes"), F.array_sort(F.collect_list("m")).alias("open"))
    sets = start.where("size(open) > 0").selectExpr("goes", "slice(open, 1, 0) AS members", "open", "slice(open, 1, 0) AS tried").persist()
    while sets.where("size(open) > 0").limit(1).count():
        grown = sets
        for _ in range(ROUNDS_AT_ONCE):
            grown = _grown(grown)
        grown = grown.persist()
        grown.count()
        sets.unpersist()
        sets = grown
    found = sets.selectExpr("array_sort(members) AS members", "array_join(array_sort(members), chr(1)) AS _key", "1L AS _one")
    return prefix_sums(found, "_key", ["_one"]).select(F.col("_one_before").alias("group"), "members")


#: Steps of the clique search that run as one job.
ROUNDS_AT_ONCE = 4


def _grown(sets: DataFrame) -> DataFrame:
    """The sets of the next round; complete ones stay, and those that only a tried model could complete go."""
    pivot = "array_max(transform(concat(open, tried), u -> struct(size(array_intersect(open, goes[u])) AS n, u))).u"
    ahead = sets.selectExpr("*", f"explode(array({pivot})) AS pivot").selectExpr("*", "array_sort(array_except(open, coalesce(goes[pivot], array()))) AS grow")
    child = """struct(array_append(members, m) AS members, array_intersect(array_except(open, slice(grow, 1, i)), goes[m]) AS open,
        array_intersect(array_union(tried, slice(grow, 1, i)), goes[m]) AS tried)"""
    children = f"""CASE WHEN size(open) > 0 THEN transform(grow, (m, i) -> {child})
        WHEN size(tried) = 0 THEN array(struct(members, open, tried)) ELSE slice(array(struct(members, open, tried)), 1, 0) END"""
    return ahead.selectExpr("goes", f"inline({children})")
