"""Metrics over prediction tables.

Rank metrics start from one row per distinct score with its positive and
negative counts, then use parallel prefix sums (``ordered.prefix_sums``). Every
term of a curve or an area is an expression on one such row, because the point
before it has the same counts without the row's own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.tails import normal_log10_two_sided
from pulsegrid.operators.ordered import prefix_sums


def score_counts(
    preds: DataFrame, *, label: str = "label", score: str = "pred", by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """(by, score, pos, neg): the table every rank metric starts from."""
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    is_pos = F.col(label) == 1
    return (
        preds.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(is_pos, weight).otherwise(0)).cast("bigint").alias("pos"),
            F.sum(F.when(is_pos, 0).otherwise(weight)).cast("bigint").alias("neg"),
        )
    )


def curve(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``tp``, ``fp`` at ``score >= s``, the class totals and the counts below s."""
    below = prefix_sums(counts, "score", ["pos", "neg"], by)
    return below.withColumnsRenamed({"pos_total": "n_pos", "neg_total": "n_neg"}).withColumns(
        {"tp": F.col("n_pos") - F.col("pos_before"), "fp": F.col("n_neg") - F.col("neg_before")}
    )


def _precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp == 0, F.lit(1.0)).otherwise(F.try_divide(tp, tp + fp))


def _previous() -> tuple[Column, Column]:
    """Counts at the next higher threshold."""
    return F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")


def _areas() -> dict[str, Column]:
    """Aggregates over curve rows. Undefined (null) when a class is empty."""
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    step = F.col("pos").cast("double")
    # Pairs counted from the positive and from the negative side, then halved: the
    # same number, but the plan's branches read the same columns and share a shuffle.
    beaten = F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    beating = F.col("neg") * (F.col("n_pos") - F.col("pos_before") - F.col("pos") / F.lit(2.0))
    here = _precision(F.col("tp"), F.col("fp"))
    before = _precision(*_previous())
    return {
        "roc_auc": F.try_divide(
            F.sum(beaten + beating), n_pos.cast("double") * n_neg * 2
        ),
        "pr_auc": F.try_divide(F.sum(step * (here + before) / 2), n_pos),
        "average_precision": F.try_divide(F.sum(step * here), n_pos),
    }


def rank_metrics(
    preds: DataFrame, metrics: Sequence[str] = ("roc_auc", "pr_auc", "average_precision"), *, label: str = "label",
    score: str = "pred", by: Sequence[str] = (), weight: Column | None = None,
) -> DataFrame:
    """ROC AUC (ties half), PR AUC (trapezoid, from (0, 1)) and average precision, per ``by``."""
    areas = _areas()
    points = curve(score_counts(preds, label=label, score=score, by=by, weight=weight), by)
    return points.groupBy(*by).agg(*[areas[m].alias(m) for m in metrics])


def threshold_metrics(preds: DataFrame, threshold: float = 0.5, *, label: str = "label", score: str = "pred") -> DataFrame:
    """Precision, recall, F1 and accuracy at ``score >= threshold``; 0 where undefined."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    counts = preds.agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return counts.select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(n - fp - fn, n).alias("accuracy"),
    )


def roc_points(preds: DataFrame, *, label: str = "label", score: str = "pred") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the origin (null threshold)."""
    points = curve(score_counts(preds, label=label, score=score))
    rates = points.select(
        F.col("score").alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr")
    )
    origin = preds.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return rates.unionByName(origin)


def pr_points(preds: DataFrame, *, label: str = "label", score: str = "pred") -> DataFrame:
    points = curve(score_counts(preds, label=label, score=score))
    return points.select(
        F.col("score").alias("threshold"), _precision(F.col("tp"), F.col("fp")).alias("precision"),
        F.try_divide("tp", "n_pos").alias("recall"),
    )


def det_points(preds: DataFrame, *, label: str = "label", score: str = "pred") -> DataFrame:
    """Detection-error trade-off (threshold, fpr, fnr), without the flat ends.

    Starts at the last threshold with the fewest false positives and stops at
    the first one that finds every positive.
    """
    counts = score_counts(preds, label=label, score=score)
    top = counts.agg(F.max("score")).scalar()
    # Below this score the first further negatives come in; the lowest score above it is the start.
    next_negative = counts.where((F.col("neg") > 0) & (F.col("score") < top)).agg(F.max("score")).scalar()
    start = counts.where(F.coalesce(F.col("score") > next_negative, F.lit(True))).agg(F.min("score")).scalar()
    points = curve(counts)
    tp_before, _ = _previous()
    kept = points.where((F.col("score") <= start) & (tp_before < F.col("n_pos")))
    return kept.select(
        F.col("score").alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide(F.col("n_pos") - F.col("tp"), "n_pos").alias("fnr"),
    )


def binned_pr_curve(preds: DataFrame, n_thresholds: int = 50, *, label: str = "label", score: str = "pred") -> DataFrame:
    """Precision and recall at evenly spaced thresholds in [0, 1], closed by (1, 0).

    Rows fall into a histogram of at most ``n_thresholds + 1`` bins; thresholds
    meet the histogram, not the rows.
    """
    eps = 1e-6
    cuts = F.array(*[F.lit(i / (n_thresholds - 1.0)) for i in range(n_thresholds)])
    reached = F.size(F.filter(cuts, lambda t: t <= F.col(score)))
    bins = preds.groupBy(reached.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    expanded = bins.select(
        "pos", "neg", F.col("bin"), F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1))).alias("i")
    )
    in_reach = F.col("bin") > F.col("i")
    table = expanded.groupBy("i").agg(
        F.sum(F.when(in_reach, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(in_reach, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"),
    )
    rates = table.select(
        F.col("i").alias("point"),
        ((F.col("tp") + eps) / (F.col("tp") + F.col("fp") + eps)).alias("precision"),
        (F.col("tp") / (F.col("n_pos") + eps)).alias("recall"),
    )
    end = preds.sparkSession.range(1).select(
        F.lit(n_thresholds).alias("point"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return rates.unionByName(end)


def _centred_midranks(counts: DataFrame, value: str, alias: str) -> DataFrame:
    """(value, n, alias): midranks less their mean of distinct values counted by ``_n``."""
    return prefix_sums(counts, value, ["_n"]).select(
        value, F.col("_n").alias(f"n_{value}"), (F.col("_n_before") + (F.col("_n") - F.col("_n_total")) / F.lit(2.0)).alias(alias)
    )


def regression_metrics(preds: DataFrame, *, target: str = "label", pred: str = "pred") -> DataFrame:
    """Pearson, Spearman (Pearson of midranks) and mean absolute error.

    Ranks never meet the rows: equal (target, prediction) pairs are counted before
    the shuffle, the counted pairs get the rank of the prediction, and their sums by target the
    rank of the target. The mean of midranks is known, so sums are of centred ranks.
    Predictions are counted from the rows and targets from the pairs, so the pairs
    are merged twice.
    """
    pairs = preds.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).select(
        F.col(target).cast("double").alias("y"), F.col(pred).cast("double").alias("p")
    )
    rows = F.count(F.lit(1)).alias("_n")
    cells = pairs.groupBy("y", "p").agg(rows)
    n, rp = F.col("_n"), F.col("rp")
    by_target = cells.join(_centred_midranks(pairs.groupBy("p").agg(rows), "p", "rp"), "p").groupBy("y").agg(
        F.sum(n * rp).alias("s"), F.sum(n * rp * rp).alias("pp")
    )
    targets = cells.groupBy("y").agg(F.sum("_n").alias("_n"))
    ranked = by_target.join(_centred_midranks(targets, "y", "ry"), "y")
    sums = ranked.agg(
        F.sum(F.col("s") * F.col("ry")).alias("yp"), F.sum(F.col("n_y") * F.col("ry") * F.col("ry")).alias("yy"),
        F.sum("pp").alias("pp"), F.sum("n_y").alias("n"),
    )
    spearman = sums.select(F.when(F.col("n") > 1, F.col("yp") / F.sqrt(F.col("yy") * F.col("pp"))).alias("spearman"))
    direct = pairs.agg(F.corr("y", "p").alias("pearson"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return direct.crossJoin(spearman).select("pearson", "spearman", "mae")


def cosine_similarity(target: Column, pred: Column) -> Column:
    """Cosine of two array columns."""
    zero = F.lit(0.0).cast("double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    return F.try_divide(dot(target, pred), F.sqrt(dot(target, target)) * F.sqrt(dot(pred, pred)))


def explained_variance(target: str = "label", pred: str = "pred") -> Column:
    """1 - var(error) / var(target), an aggregate."""
    return F.lit(1.0) - F.try_divide(F.var_pop(F.col(target) - F.col(pred)), F.var_pop(target))


def weighted_explained_variance(target: str = "label", pred: str = "pred") -> str:
    """The same as text for :func:`resampling.regression_interval`, a row counted ``{w}`` times."""
    mean = "(sum({w} * MEANT) / sum({w}))"
    var = lambda x: f"({mean.replace('MEANT', f'{x} * {x}')} - {mean.replace('MEANT', x)} * {mean.replace('MEANT', x)})"
    return f"1 - try_divide({var(f'(`{target}` - `{pred}`)')}, {var(f'`{target}`')})"


def loss_metrics(
    preds: DataFrame, *, label: str = "label", prob: str = "pred", soft_label: str | None = None,
    neg_weight: float = 1.0, pos_weight: float = 1.0, alpha: float = 0.25, gamma: float = 2.0,
) -> DataFrame:
    """Weighted cross-entropy, binary focal loss, soft-label cross-entropy and squared error.

    Weighted means divide by the sum of weights. The focal weights are ``alpha``
    for class 0 and ``1 - alpha`` for class 1.
    """
    p = F.col(prob)
    is_pos = F.col(label) == 1
    own = F.when(is_pos, p).otherwise(1 - p)
    soft = F.col(soft_label or label).cast("double")
    weight = F.when(is_pos, F.lit(float(pos_weight))).otherwise(F.lit(float(neg_weight)))
    focal_weight = F.when(is_pos, F.lit(1.0 - alpha)).otherwise(F.lit(alpha))
    focal = -F.pow(1 - own, F.lit(gamma)) * F.ln(own) * focal_weight
    return preds.agg(
        F.try_divide(F.sum(-weight * F.ln(own)), F.sum(weight)).alias("cross_entropy"),
        F.try_divide(F.sum(focal), F.sum(focal_weight)).alias("focal"),
        F.avg(-(soft * F.ln(p) + (1 - soft) * F.ln(1 - p))).alias("soft_cross_entropy"),
        F.avg(F.pow(F.col(label) - p, F.lit(2.0))).alias("mse"),
    )


# --- DeLong ------------------------------------------------------------------


def _placements(preds: DataFrame, label: str, score: str) -> DataFrame:
    """(score, v_pos, v_neg): share of the other class a positive or negative at this score beats.

    Equals the midrank form: midrank overall minus midrank within the class,
    divided by the size of the other class.
    """
    points = curve(score_counts(preds, label=label, score=score))
    return points.select(
        F.col("score").alias(score),
        F.try_divide(F.col("neg_before") + F.col("neg") / F.lit(2.0), "n_neg").alias(f"{score}_v_pos"),
        (F.lit(1.0) - F.try_divide(F.col("pos_before") + F.col("pos") / F.lit(2.0), "n_pos")).alias(f"{score}_v_neg"),
    )


def delong(preds: DataFrame, score_a: str, score_b: str, *, label: str = "label") -> DataFrame:
    """One row: both AUCs and their DeLong (co)variances."""
    cells = (
        preds.groupBy(label, score_a, score_b).agg(F.count(F.lit(1)).alias("_n"))
        .join(_placements(preds, label, score_a), score_a)
        .join(_placements(preds, label, score_b), score_b)
    )
    is_pos = F.col(label) == 1
    n = F.col("_n").cast("double")
    a = F.when(is_pos, F.col(f"{score_a}_v_pos")).otherwise(F.col(f"{score_a}_v_neg"))
    b = F.when(is_pos, F.col(f"{score_b}_v_pos")).otherwise(F.col(f"{score_b}_v_neg"))
    sums = cells.groupBy(is_pos.alias("is_pos")).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"),
        F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"), F.sum(n * a * b).alias("sab"),
    )

    def cov(cross: str, x: str, y: str) -> Column:
        sample = F.try_divide(F.col(cross) - F.col(x) * F.col(y) / F.col("n"), F.col("n") - 1)
        return F.try_divide(sample, F.col("n"))

    return sums.agg(
        F.max(F.when(F.col("is_pos"), F.col("sa") / F.col("n"))).alias("auc_a"),
        F.max(F.when(F.col("is_pos"), F.col("sb") / F.col("n"))).alias("auc_b"),
        F.sum(cov("saa", "sa", "sa")).alias("var_a"),
        F.sum(cov("sbb", "sb", "sb")).alias("var_b"),
        F.sum(cov("sab", "sa", "sb")).alias("cov_ab"),
    )


def delong_test(preds: DataFrame, score_a: str, score_b: str, *, label: str = "label") -> DataFrame:
    """DeLong row with z and log10 of the two-sided p-value."""
    stats = delong(preds, score_a, score_b, label=label)
    spread = F.sqrt(F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"))
    return stats.withColumn("z", F.try_divide(F.abs(F.col("auc_a") - F.col("auc_b")), spread)).withColumn(
        "log10_p", normal_log10_two_sided("z")
    )


# --- metric tables -----------------------------------------------------------


def prefixed_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One-row metric tables per split as (metric, value) with ``train/``-style names."""
    result = None
    for prefix, table in tables.items():
        doubles = table.select(*[F.col(c).cast("double").alias(c) for c in table.columns])
        long = doubles.unpivot([], table.columns, "metric", "value").withColumn(
            "metric", F.concat(F.lit(prefix), F.col("metric"))
        )
        result = long if result is None else result.unionByName(long)
    return result
