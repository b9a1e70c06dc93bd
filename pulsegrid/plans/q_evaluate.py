"""Evaluation of prediction and benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.columns import clip
from pulsegrid.functions.hashing import POISSON1_THRESHOLDS
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import ranktests as K
from pulsegrid.operators import resampling as B
from pulsegrid.operators import split as S
from pulsegrid.plans.registry import Tables, query, sql

PREDS = ["fx_predictions"]


def _preds(t: Tables, score: str = "pred_b"):
    return t("fx_predictions").select("id", "label", F.col(score).alias("pred"))


# Threshold table: cumulative counts at each distinct score, best first.
_CURVE = """
scored AS (SELECT pred_b AS score, sum(label) AS pos, sum(1 - label) AS neg FROM fx_predictions GROUP BY pred_b),
curve AS (
    SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg,
        row_number() OVER w AS i
    FROM scored WINDOW w AS (ORDER BY score DESC)),
steps AS (
    SELECT *, lag(tp, 1, 0) OVER (ORDER BY i) AS tp0, lag(fp, 1, 0) OVER (ORDER BY i) AS fp0 FROM curve)"""


@query(
    "e1_threshold_metrics",
    sql(
        """SELECT tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall,
            2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, (n - fp - fn) / CAST(n AS DOUBLE) AS accuracy FROM (
            SELECT count(*) FILTER (pred_b >= 0.5 AND label = 1) AS tp, count(*) FILTER (pred_b >= 0.5 AND label = 0) AS fp,
                count(*) FILTER (pred_b < 0.5 AND label = 1) AS fn, count(*) AS n FROM fx_predictions)""",
        PREDS,
    ),
)
def threshold_metrics(t: Tables):
    return E.threshold_metrics(_preds(t), 0.5)


@query(
    "e2_roc_auc",
    sql(
        """SELECT round(avg(CASE WHEN p.pred_b > n.pred_b THEN 1.0 WHEN p.pred_b = n.pred_b THEN 0.5 ELSE 0.0 END), 9) AS roc_auc
        FROM fx_predictions p JOIN fx_predictions n ON p.label = 1 AND n.label = 0""",
        PREDS,
    ),
)
def roc_auc(t: Tables):
    return E.rank_metrics(_preds(t), ["roc_auc"]).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "e3_pr_auc",
    sql(
        """SELECT round(sum((tp - tp0) / CAST(n_pos AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE)
            + CASE WHEN tp0 + fp0 = 0 THEN 1.0 ELSE tp0 / CAST(tp0 + fp0 AS DOUBLE) END) / 2), 9) AS pr_auc FROM steps""",
        PREDS, _CURVE,
    ),
)
def pr_auc(t: Tables):
    return E.rank_metrics(_preds(t), ["pr_auc"]).select(F.round("pr_auc", 9).alias("pr_auc"))


@query(
    "e4_average_precision",
    sql(
        "SELECT round(sum((tp - tp0) / CAST(n_pos AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)), 9) AS average_precision FROM steps",
        PREDS, _CURVE,
    ),
)
def average_precision(t: Tables):
    return E.rank_metrics(_preds(t), ["average_precision"]).select(F.round("average_precision", 9).alias("average_precision"))


@query(
    "e5_roc_curve",
    sql(
        """SELECT score AS threshold, fp / CAST(n_neg AS DOUBLE) AS fpr, tp / CAST(n_pos AS DOUBLE) AS tpr FROM curve
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0""",
        PREDS, _CURVE,
    ),
)
def roc_curve(t: Tables):
    points = E.roc_points(_preds(t))
    return points.select(F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"), "fpr", "tpr")


@query(
    "e6_binned_pr_curve",
    sql(
        """SELECT CAST(i AS INT) AS point, (tp + 1e-6) / (tp + fp + 1e-6) AS precision, tp / (n_pos + 1e-6) AS recall FROM (
            SELECT c.i, CAST(count(*) FILTER (p.label = 1 AND p.pred_b >= c.i / 49.0) AS DOUBLE) AS tp,
                CAST(count(*) FILTER (p.label = 0 AND p.pred_b >= c.i / 49.0) AS DOUBLE) AS fp, CAST(sum(p.label) AS DOUBLE) AS n_pos
            FROM fx_predictions p, (SELECT unnest(range(0, 50)) AS i) c GROUP BY c.i)
        UNION ALL SELECT 50, 1.0, 0.0""",
        PREDS,
    ),
)
def binned_pr_curve(t: Tables):
    return E.binned_pr_curve(_preds(t), 50)


@query(
    "e7_error_tradeoff",
    sql(
        """SELECT score AS threshold, fp / CAST(n_neg AS DOUBLE) AS fpr, (n_pos - tp) / CAST(n_pos AS DOUBLE) AS fnr FROM curve
        WHERE i >= (SELECT max(i) FROM curve WHERE fp = (SELECT min(fp) FROM curve)) AND i <= (SELECT min(i) FROM curve WHERE tp = n_pos)""",
        PREDS, _CURVE,
    ),
)
def error_tradeoff(t: Tables):
    return E.det_points(_preds(t))


def _weight_sql(replicate: str, row: str) -> str:
    draw = f"substr(md5(concat('boot:', CAST({replicate} AS VARCHAR), ':', CAST({row} AS VARCHAR))), 1, 8)"
    return " + ".join(f"CAST({draw} >= '{x}' AS INT)" for x in POISSON1_THRESHOLDS)


def _boot_ctes(n: int, by_model: bool = False) -> str:
    """Weighted AUC, PR AUC and average precision per replicate (and model)."""
    source = "fx_predictions"
    group = "r"
    if by_model:
        source = "(SELECT id, label, 'a' AS model, pred_a AS pred_b FROM fx_predictions UNION ALL SELECT id, label, 'b', pred_b FROM fx_predictions)"
        group = "r, model"
    return f"""
draws AS (SELECT {'p.model, ' if by_model else ''}g.r, p.label, p.pred_b AS score, {_weight_sql('g.r', 'p.id')} AS w
    FROM {source} p, (SELECT unnest(range(1, {n + 1})) AS r) g),
boot_scored AS (SELECT {group}, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM draws WHERE w > 0 GROUP BY {group}, score),
boot_curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {group}) AS n_pos, sum(neg) OVER (PARTITION BY {group}) AS n_neg
    FROM boot_scored WINDOW w AS (PARTITION BY {group} ORDER BY score DESC)),
boot AS (SELECT {group}, sum(pos * (n_neg - fp + neg / 2.0)) / CAST(max(n_pos) * max(n_neg) AS DOUBLE) AS roc_auc,
        sum(pos / CAST(n_pos AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE)
            + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) / CAST(tp - pos + fp - neg AS DOUBLE) END) / 2) AS pr_auc,
        sum(pos / CAST(n_pos AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)) AS average_precision
    FROM boot_curve GROUP BY {group})"""


@query(
    "e8_bootstrap_interval",
    sql(
        """SELECT 'roc_auc' AS metric, round(avg(roc_auc), 8) AS mean, round(quantile_cont(roc_auc, 0.05), 8) AS ci_low, round(quantile_cont(roc_auc, 0.95), 8) AS ci_high FROM boot
        UNION ALL SELECT 'pr_auc', round(avg(pr_auc), 8), round(quantile_cont(pr_auc, 0.05), 8), round(quantile_cont(pr_auc, 0.95), 8) FROM boot""",
        PREDS, _boot_ctes(100),
    ),
)
def bootstrap_interval(t: Tables):
    replicates = B.bootstrap_metrics(_preds(t), 100)
    ci = B.interval(replicates, ["roc_auc", "pr_auc"], low=0.05, high=0.95)
    return ci.select("metric", *[F.round(c, 8).alias(c) for c in ("mean", "ci_low", "ci_high")])


def _unpivoted(t: Tables):
    return t("fx_predictions").unpivot(["id", "label"], ["pred_a", "pred_b"], "model", "pred").withColumn(
        "model", F.substring("model", 6, 1)
    )


@query(
    "e9_hierarchical_bootstrap",
    sql(
        """SELECT CAST(d.r AS INT) AS replicate, round(sum(b.roc_auc * d.draws) / sum(d.draws), 8) AS roc_auc,
            round(sum(b.average_precision * d.draws) / sum(d.draws), 8) AS average_precision
        FROM model_draws d JOIN boot b ON b.r = d.r AND b.model = d.model GROUP BY d.r""",
        PREDS,
        _boot_ctes(10, by_model=True) + """, model_draws AS (
            SELECT r, CASE CAST(concat('0x', substr(md5(concat('model:', CAST(r AS VARCHAR), ':', CAST(k AS VARCHAR))), 1, 8)) AS BIGINT) % 2 WHEN 0 THEN 'a' ELSE 'b' END AS model,
                count(*) AS draws
            FROM (SELECT unnest(range(1, 11)) AS r), (SELECT unnest([1, 2]) AS k) GROUP BY 1, 2)""",
    ),
)
def hierarchical_bootstrap(t: Tables):
    result = B.hierarchical_bootstrap(_unpivoted(t), 10)
    return result.select("replicate", *[F.round(c, 8).alias(c) for c in ("roc_auc", "average_precision")])


@query(
    "e10_row_bootstrap",
    sql(
        "SELECT CAST(r AS INT) AS replicate, round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision FROM boot",
        PREDS, _boot_ctes(20),
    ),
)
def row_bootstrap(t: Tables):
    replicates = B.bootstrap_metrics(_preds(t), 20, metrics=["roc_auc", "average_precision"])
    return replicates.select("replicate", *[F.round(c, 8).alias(c) for c in ("roc_auc", "average_precision")])


@query(
    "e11_mean_and_error",
    sql(
        """SELECT model, round(avg(roc_auc), 8) AS mean, round(abs(quantile_cont(roc_auc, 0.025) - avg(roc_auc)), 8) AS err_low,
            round(abs(quantile_cont(roc_auc, 0.975) - avg(roc_auc)), 8) AS err_high FROM boot GROUP BY model""",
        PREDS, _boot_ctes(20, by_model=True),
    ),
)
def mean_and_error(t: Tables):
    replicates = B.bootstrap_metrics(_unpivoted(t), 20, metrics=["roc_auc"], by=["model"])
    summary = B.mean_error_summary(replicates, "roc_auc", ["model"])
    return summary.select("model", *[F.round(c, 8).alias(c) for c in ("mean", "err_low", "err_high")])


@query(
    "e12_regression_metrics",
    """SELECT round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman, round(avg(abs(y - p)), 6) AS mae FROM (
        SELECT l_extendedprice AS y, l_quantity AS p,
            rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry,
            rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rp FROM lineitem)""",
)
def regression_metrics(t: Tables):
    metrics = E.regression_metrics(t("lineitem"), target="l_extendedprice", pred="l_quantity")
    return metrics.select(*[F.round(c, 6).alias(c) for c in metrics.columns])


@query(
    "e13_similarity_and_variance",
    """SELECT round(sum(c), 6) AS cosine_sum, round(avg(c), 6) AS cosine_mean, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance
    FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p,
        (l_extendedprice * l_quantity * 1500 + l_discount * l_tax) / (sqrt(l_extendedprice * l_extendedprice + l_discount * l_discount)
            * sqrt(l_quantity * 1500 * l_quantity * 1500 + l_tax * l_tax)) AS c FROM lineitem)""",
)
def similarity_and_variance(t: Tables):
    rows = t("lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("pred"),
        F.array("l_extendedprice", "l_discount").alias("target"), F.array(F.col("l_quantity") * 1500, F.col("l_tax")).alias("guess"),
    )
    cosine = E.cosine_similarity(F.col("target"), F.col("guess"))
    return rows.agg(
        F.round(F.sum(cosine), 6).alias("cosine_sum"), F.round(F.avg(cosine), 6).alias("cosine_mean"),
        F.round(E.explained_variance(), 6).alias("explained_variance"),
    )


@query(
    "e13_regression_interval",
    sql(
        """SELECT metric, round(avg(v), 6) AS mean, round(avg(v) - 2 * stddev_samp(v), 6) AS ci_low, round(avg(v) + 2 * stddev_samp(v), 6) AS ci_high FROM (
            SELECT 'cosine' AS metric, sum(w * c) / sum(w) AS v FROM drawn GROUP BY r
            UNION ALL SELECT 'explained_variance', 1 - (sum(w * e * e) / sum(w) - pow(sum(w * e) / sum(w), 2)) / (sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2))
            FROM drawn GROUP BY r) GROUP BY metric""",
        [],
        f"""guessed AS (SELECT concat(CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR)) AS id, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p, l_discount AS d, l_tax AS t FROM lineitem),
        drawn AS (SELECT g.r, {_weight_sql("g.r", "p.id")} AS w, p.y, p.y - p.p AS e, (p.y * p.p + p.d * p.t) / (sqrt(p.y * p.y + p.d * p.d) * sqrt(p.p * p.p + p.t * p.t)) AS c
            FROM guessed p, (SELECT unnest(range(1, 11)) AS r) g)""",
    ),
)
def regression_interval(t: Tables):
    rows = t("lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") * 1.5).alias("pred"), "l_discount", "l_tax",
    )
    rows = rows.withColumn("cosine", E.cosine_similarity(F.array("label", "l_discount"), F.array("pred", "l_tax")))
    statistics = {"cosine": "sum({w} * cosine) / sum({w})", "explained_variance": E.weighted_explained_variance()}
    found = B.regression_interval(rows.select("id", "label", "pred", "cosine"), 10, statistics)
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


_DELONG = """
placed AS (
    SELECT p.id, p.label,
        (SELECT avg(CASE WHEN o.pred_a < p.pred_a THEN 1.0 WHEN o.pred_a = p.pred_a THEN 0.5 ELSE 0.0 END) FROM fx_predictions o WHERE o.label <> p.label) AS a,
        (SELECT avg(CASE WHEN o.pred_b < p.pred_b THEN 1.0 WHEN o.pred_b = p.pred_b THEN 0.5 ELSE 0.0 END) FROM fx_predictions o WHERE o.label <> p.label) AS b
    FROM fx_predictions p), delong AS (
    SELECT avg(a) FILTER (label = 1) AS auc_a, avg(b) FILTER (label = 1) AS auc_b,
        var_samp(a) FILTER (label = 1) / count(*) FILTER (label = 1) + var_samp(a) FILTER (label = 0) / count(*) FILTER (label = 0) AS var_a,
        var_samp(b) FILTER (label = 1) / count(*) FILTER (label = 1) + var_samp(b) FILTER (label = 0) / count(*) FILTER (label = 0) AS var_b,
        covar_samp(a, b) FILTER (label = 1) / count(*) FILTER (label = 1) + covar_samp(a, b) FILTER (label = 0) / count(*) FILTER (label = 0) AS cov_ab
    FROM placed)"""


@query(
    "e14_delong_variance",
    sql(
        """SELECT round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round(var_a, 8) AS var_a, round(var_b, 8) AS var_b,
            round(cov_ab, 8) AS cov_ab FROM delong""",
        PREDS, _DELONG,
    ),
)
def delong_variance(t: Tables):
    stats = E.delong(t("fx_predictions"), "pred_a", "pred_b")
    return stats.select(*[F.round(c, 8).alias(c) for c in stats.columns])


def _two_sided(z: str) -> str:
    """Two-sided normal p-value by the series of erf; exact to 1e-9 for |z| < 4."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow({x}, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1))"
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: {term})))"


@query(
    "e15_delong_test",
    sql(
        f"""SELECT round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round(var_a, 8) AS var_a, round(var_b, 8) AS var_b,
            round(cov_ab, 8) AS cov_ab, round(z, 6) AS z, round(log10({_two_sided("z")}), 6) AS log10_p
        FROM (SELECT *, abs(auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov_ab) AS z FROM delong)""",
        PREDS, _DELONG,
    ),
)
def delong_test(t: Tables):
    stats = E.delong_test(t("fx_predictions"), "pred_a", "pred_b")
    return stats.select(*[F.round(c, 6 if c in ("z", "log10_p") else 8).alias(c) for c in stats.columns])


_KS = [0.0005, 0.001, 0.005, 0.01, 0.1]


@query(
    "e16_precision_reference_lines",
    sql(
        """SELECT k, n_pos / n AS prevalence, least(1.0, n_pos / (n * k)) AS oracle FROM (
            SELECT unnest([CAST(0.0005 AS DOUBLE), 0.001, 0.005, 0.01, 0.1]) AS k, CAST(sum(label) AS DOUBLE) AS n_pos, CAST(count(*) AS DOUBLE) AS n
            FROM fx_predictions)""",
        PREDS,
    ),
)
def precision_reference_lines(t: Tables):
    return S.precision_reference_lines(t("fx_predictions"), _KS)


def _metrics(t: Tables):
    return t("fx_metrics").withColumn("accuracy", F.round("accuracy", 9))


_RUNS = "runs AS (SELECT classifier_name AS m, dataset_name AS d, round(accuracy, 9) AS v FROM fx_metrics)"


@query(
    "e17_friedman_test",
    sql(
        # The chi-square tail has a closed form for an even number of degrees of freedom: here 7 models, 6 degrees.
        """SELECT round(q, 6) AS statistic, round(exp(-q / 2) * (1 + q / 2 + q * q / 8), 6) AS p_value FROM (
            SELECT (12.0 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (k * (k * k - 1) * n)) AS q FROM (
                SELECT count(*) AS k, sum(rs * rs) AS ss, max(n) AS n, (SELECT sum(t * (t * t - 1)) FROM (SELECT count(*) AS t FROM runs GROUP BY d, v)) AS ties
                FROM (SELECT m, sum(r) AS rs, count(*) AS n FROM ranked GROUP BY m)))""",
        ["fx_metrics"],
        _RUNS + ", ranked AS (SELECT m, rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0 AS r FROM runs)",
    ),
)
def friedman_test(t: Tables):
    return K.friedman(_metrics(t)).select(F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"))


_WILCOXON = (
    _RUNS
    + f""", diffs AS (
    SELECT a.m AS model_a, b.m AS model_b, a.v - b.v AS x, abs(a.v - b.v) AS size FROM runs a JOIN runs b ON a.d = b.d AND a.m < b.m
), sized AS (
    SELECT *, count(*) OVER (PARTITION BY model_a, model_b, size) AS t,
        rank() OVER (PARTITION BY model_a, model_b ORDER BY size) + (count(*) OVER (PARTITION BY model_a, model_b, size) - 1) / 2.0 AS r FROM diffs
), sums AS (
    SELECT model_a, model_b, least(coalesce(sum(r) FILTER (x > 0), 0), coalesce(sum(r) FILTER (x < 0), 0)) AS statistic,
        CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (x = 0) AS DOUBLE) AS o, coalesce(sum(t * t - 1) FILTER (x <> 0), 0) AS ties
    FROM sized GROUP BY model_a, model_b
), scored AS (
    SELECT model_a, model_b, statistic, (statistic - (n * (n + 1) - o * (o + 1)) / 4)
        / sqrt((n * (n + 1) * (2 * n + 1) - o * (o + 1) * (2 * o + 1) - ties / 2.0) / 24) AS z FROM sums
), tested AS (
    SELECT *, {_two_sided("z")} AS p FROM scored
), wilcoxon AS (
    SELECT *, min(CAST(p <= 0.05 / (total - i + 1) AS INT)) OVER (ORDER BY i) AS significant FROM (
        SELECT *, row_number() OVER (ORDER BY round(p, 9), model_a, model_b) AS i, count(*) OVER () AS total FROM tested)
)"""
)


@query(
    "e18_wilcoxon_holm",
    sql(
        "SELECT model_a, model_b, CAST(statistic AS DOUBLE) AS statistic, round(z, 6) AS z, round(p, 6) AS p_value, significant FROM wilcoxon",
        ["fx_metrics"], _WILCOXON,
    ),
)
def wilcoxon_holm(t: Tables):
    pairs = K.wilcoxon_pairs(_metrics(t))
    return pairs.select("model_a", "model_b", "statistic", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), "significant")


@query(
    "e19_average_ranks",
    sql(
        """SELECT classifier_name, avg(rank) AS average_rank, count(*) FILTER (rank = 1.0) AS wins FROM (
            SELECT classifier_name, rank() OVER (PARTITION BY dataset_name ORDER BY round(accuracy, 9) DESC)
                + (count(*) OVER (PARTITION BY dataset_name, round(accuracy, 9)) - 1) / 2.0 AS rank FROM fx_metrics)
        GROUP BY classifier_name""",
        ["fx_metrics"],
    ),
)
def average_ranks(t: Tables):
    return K.average_ranks(_metrics(t))


@query(
    "e20_inseparable_groups",
    sql(
        # Every subset of the models as a bit mask: cliques without a significant pair, none inside a larger one.
        """SELECT string_agg(c.m, ',' ORDER BY c.m) AS members FROM cliques q JOIN models c ON (q.s >> c.i) & 1 = 1
        WHERE NOT EXISTS (SELECT 1 FROM cliques o WHERE o.s <> q.s AND (o.s & q.s) = q.s) GROUP BY q.s""",
        ["fx_metrics"],
        _WILCOXON + """, models AS (SELECT m, CAST(row_number() OVER (ORDER BY m) - 1 AS INT) AS i FROM (SELECT DISTINCT m FROM runs)),
        apart AS (SELECT (1 << a.i) + (1 << b.i) AS bits FROM wilcoxon w JOIN models a ON a.m = w.model_a JOIN models b ON b.m = w.model_b WHERE significant = 1),
        cliques AS (SELECT CAST(s AS INT) AS s FROM (SELECT unnest(range(1, (1 << (SELECT CAST(count(*) AS INT) FROM models)))) AS s)
            WHERE NOT EXISTS (SELECT 1 FROM apart WHERE (CAST(s AS INT) & bits) = bits))""",
    ),
)
def inseparable_groups(t: Tables):
    return K.inseparable_groups(K.wilcoxon_pairs(_metrics(t))).select("members")


@query(
    "e21_losses",
    sql(
        """SELECT round(sum(-w * ln(own)) / sum(w), 8) AS cross_entropy, round(sum(-pow(1 - own, 2) * ln(own) * fw) / sum(fw), 8) AS focal,
            round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 8) AS soft_cross_entropy, round(avg(pow(label - p, 2)), 8) AS mse FROM (
            SELECT *, CASE WHEN label = 1 THEN p ELSE 1 - p END AS own, CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END AS w,
                CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END AS fw FROM (
                SELECT label, greatest(least(pred_b, 0.999), 0.001) AS p FROM fx_predictions))""",
        PREDS,
    ),
)
def losses(t: Tables):
    preds = _preds(t).withColumn("pred", clip("pred", 0.001, 0.999))
    table = E.loss_metrics(preds, pos_weight=2.0)
    return table.select(*[F.round(c, 8).alias(c) for c in table.columns])


@query(
    "e22_prefixed_split_metrics",
    sql(
        """SELECT concat(CASE WHEN id % 2 = 0 THEN 'train/' ELSE 'test/' END, m.name) AS metric,
            round(CASE m.name WHEN 'accuracy' THEN avg(CASE WHEN (pred_b >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)
                ELSE sum(CASE WHEN pred_b >= 0.5 AND label = 1 THEN 1.0 ELSE 0.0 END) / sum(label) END, 8) AS value
        FROM fx_predictions, (SELECT unnest(['accuracy', 'recall']) AS name) m GROUP BY 1, m.name, id % 2""",
        PREDS,
    ),
)
def prefixed_split_metrics(t: Tables):
    preds = _preds(t)
    tables = {
        prefix: E.threshold_metrics(preds.where(F.col("id") % 2 == part)).select("accuracy", "recall")
        for prefix, part in (("train/", 0), ("test/", 1))
    }
    return E.prefixed_metrics(tables).withColumn("value", F.round("value", 8))


@query(
    "o11_sampled_curve_points",
    sql(
        """SELECT score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(n_pos AS DOUBLE) AS recall FROM curve
        ORDER BY substr(md5(concat('points:', CAST(score AS VARCHAR))), 1, 8), score LIMIT 30""",
        PREDS, _CURVE,
    ),
)
def sampled_curve_points(t: Tables):
    return S.sample_points(E.pr_points(_preds(t)), 30, ["threshold"])
