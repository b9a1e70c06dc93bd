"""Bootstrap intervals as one weighted pass instead of a loop of resamples.

Replicate r gives row i the weight Poisson(1), drawn from md5(seed, r, i): the
large-sample form of drawing n rows with replacement. Replicates go in chunks:
a row carries an array with one counter per replicate of the chunk, equal
scores add theirs up before the shuffle, and from there on one row per distinct
score holds the counts of all of them. What is shuffled does not grow with the
replicates of a chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import POISSON1_THRESHOLDS, hash_prefix
from pulsegrid.operators.ordered import prefix_sums, prefix_vectors, vector_sum

#: Replicates whose counters one row carries.
CHUNK = 100

# Per replicate i of a chunk of {c}: positives and negatives at a score, at lower scores and in all.
_POS, _NEG, _POS_BELOW, _NEG_BELOW = "v[i]", "v[i + {c}]", "v_before[i]", "v_before[i + {c}]"
_TP, _FP = f"(v_total[i] - {_POS_BELOW})", f"(v_total[i + {{c}}] - {_NEG_BELOW})"
_HERE = f"coalesce(try_divide({_TP}, {_TP} + {_FP}), 1D)"
_BEFORE = f"coalesce(try_divide({_TP} - {_POS}, {_TP} - {_POS} + {_FP} - {_NEG}), 1D)"
#: metric: (its term at a score, what the sum of terms is divided by)
_METRICS = {
    "roc_auc": (f"{_POS} * ({_NEG_BELOW} + {_NEG} / 2)", "t[i] * t[i + {c}]"),
    "pr_auc": (f"{_POS} * ({_HERE} + {_BEFORE}) / 2", "t[i]"),
    "average_precision": (f"{_POS} * {_HERE}", "t[i]"),
}


def replicate_weights(df: DataFrame, first: int, last: int, id_col: str = "id", seed: str = "boot", alias: str = "weights") -> DataFrame:
    """``df`` with an array of how often each row is drawn in the replicates ``first`` to ``last``."""
    hashed = f"transform(sequence({first}, {last}), r -> substring(md5(concat('{seed}:', r, ':', `{id_col}`)), 1, 8))"
    weight = " + ".join(f"cast(h >= '{x}' AS int)" for x in POISSON1_THRESHOLDS)
    # Generated and not projected: else Spark would put the hashes into every expression that reads one element.
    return df.selectExpr("*", f"explode(array(transform({hashed}, h -> {weight}))) AS {alias}")


def _chunks(n_replicates: int) -> list[tuple[int, int]]:
    return [(low, min(low + CHUNK - 1, n_replicates)) for low in range(1, n_replicates + 1, CHUNK)]


def bootstrap_metrics(
    preds: DataFrame, n_replicates: int = 100, *, metrics: Sequence[str] = ("roc_auc", "pr_auc"), label: str = "label",
    score: str = "pred", id_col: str = "id", by: Sequence[str] = (), seed: str = "boot",
) -> DataFrame:
    """One row per (by, replicate) with the metrics; undefined ones are null.

    A ``by`` group none of whose rows is drawn in a replicate has null metrics there.
    """
    by = list(by)
    known = preds.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, id_col, label, F.col(score).alias("score"))
    result = None
    for first, last in _chunks(n_replicates):
        c = last - first + 1
        drawn = replicate_weights(known, first, last, id_col, seed, "_w")
        none = f"array_repeat(0, {c})"
        sides = drawn.selectExpr(*by, "score", f"cast(if(`{label}` = 1, concat(_w, {none}), concat({none}, _w)) AS array<double>) AS v")
        counts = sides.groupBy(*by, "score").agg(vector_sum(F.col("v")).alias("v"))
        below = prefix_vectors(counts, "score", "v", by)
        terms = ", ".join(f"transform(sequence(0, {c - 1}), i -> {_METRICS[m][0].format(c=c)})" for m in metrics)
        summed = below.selectExpr(*by, f"concat({terms}) AS s", "v_total AS t").groupBy(*by).agg(vector_sum(F.col("s")).alias("s"), F.first("t").alias("t"))
        values = ", ".join(f"try_divide(s[i + {k * c}], {_METRICS[m][1].format(c=c)}) AS {m}" for k, m in enumerate(metrics))
        part = summed.selectExpr(*by, f"inline(transform(sequence(0, {c - 1}), i -> struct(i + {first} AS replicate, {values})))")
        result = part if result is None else result.unionByName(part)
    return result


def interval(
    replicates: DataFrame, metrics: Sequence[str], *, by: Sequence[str] = (), low: float = 0.025, high: float = 0.975
) -> DataFrame:
    """(by, metric, mean, ci_low, ci_high) over replicate rows; null replicates are left out."""
    long = replicates.unpivot([*by], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", low).alias("ci_low"), F.percentile("value", high).alias("ci_high")
    )


def mean_error_summary(
    replicates: DataFrame, metric: str, by: Sequence[str], low: float = 0.025, high: float = 0.975
) -> DataFrame:
    """Mean and the distance of both percentiles from it."""
    stats = replicates.groupBy(*by).agg(
        F.avg(metric).alias("mean"), F.percentile(metric, low).alias("_lo"), F.percentile(metric, high).alias("_hi")
    )
    return stats.select(
        *by, "mean", F.abs(F.col("_lo") - F.col("mean")).alias("err_low"), F.abs(F.col("_hi") - F.col("mean")).alias("err_high")
    )


def regression_interval(
    df: DataFrame, n_replicates: int, statistics: Mapping[str, str], *, id_col: str = "id", seed: str = "boot"
) -> DataFrame:
    """(metric, mean, ci_low, ci_high): mean and mean +- 2 standard deviations over the replicates.

    A statistic is the text of an aggregate that reads a row's weight as
    ``{w}``. Replicates are aggregates of one pass, so only partial sums move.
    """
    result = None
    for first, last in _chunks(n_replicates):
        drawn = replicate_weights(df, first, last, id_col, seed, "_w")
        values = [", ".join(f"{text.format(w=f'_w[{i}]')} AS {name}" for name, text in statistics.items()) for i in range(last - first + 1)]
        part = drawn.agg(F.expr(f"array({', '.join(f'struct({v})' for v in values)})").alias("_r")).selectExpr("inline(_r)")
        result = part if result is None else result.unionByName(part)
    stats = result.unpivot([], list(statistics), "metric", "value").groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("_s")
    )
    return stats.selectExpr("metric", "mean", "mean - 2 * _s AS ci_low", "mean + 2 * _s AS ci_high")


def model_draws(models: DataFrame, n_replicates: int, model_col: str = "model", seed: str = "model") -> DataFrame:
    """(replicate, model, draws): as many models drawn with replacement as there are.

    Draw k of replicate r takes the model at position md5(seed, r, k) modulo
    the model count, in name order. Each model makes the draw of its own
    position, and a join on the position finds the model that was drawn.
    """
    names = models.select(model_col).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    placed = prefix_sums(names, model_col, ["_one"]).select(model_col, F.col("_one_before").alias("_at"), F.col("_one_total").alias("_n"))
    draws = placed.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n_replicates))))
    value = F.conv(hash_prefix(seed, F.col("replicate"), F.col("_at") + 1), 16, 10).cast("bigint")
    drawn = draws.select("replicate", F.pmod(value, F.col("_n")).alias("_at"))
    return drawn.join(placed.select(model_col, "_at"), "_at").groupBy("replicate", model_col).agg(F.count(F.lit(1)).alias("draws"))


def hierarchical_bootstrap(
    preds: DataFrame, n_replicates: int = 10, *, metrics: Sequence[str] = ("roc_auc", "average_precision"),
    model_col: str = "model", label: str = "label", score: str = "pred", id_col: str = "id", seed: str = "boot",
) -> DataFrame:
    """Per replicate: models drawn with replacement, one row resample shared by them, metrics averaged over the draws."""
    per_model = bootstrap_metrics(
        preds, n_replicates, metrics=metrics, label=label, score=score, id_col=id_col, by=[model_col], seed=seed
    )
    drawn = per_model.join(model_draws(preds, n_replicates, model_col), ["replicate", model_col])
    return drawn.groupBy("replicate").agg(
        *[F.try_divide(F.sum(F.col(m) * F.col("draws")), F.sum("draws")).alias(m) for m in metrics]
    )
