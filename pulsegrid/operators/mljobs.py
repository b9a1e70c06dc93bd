"""Model jobs on pyspark.ml: weak labels, boosted trees, random baseline, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import day_of, numeric_or
from pulsegrid.functions.hashing import hash_below
from pulsegrid.operators.evaluate import rank_metrics
from pulsegrid.operators.labels import FLU_TESTS, KEY, POSITIVE
from pulsegrid.operators.ordered import hash_rank
from pulsegrid.operators.reshape import expand_event_dates

#: Rows of a task when trees are fitted; with 336 features about 40 MB of what the fit caches.
ROWS_PER_TASK = 20_000


def coerce_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric_or(c) for c in columns})


def fit_label_model(
    labelled: DataFrame, features: Sequence[str], *, label: str = "label", id_col: str = "response_id",
    train_frac: float = 0.8, n_trees: int = 100, seed: int = 7,
) -> tuple[PipelineModel, DataFrame]:
    """Random forest on standardised features and its hold-out PR and ROC AUC.

    One hash split keeps features and labels together.
    """
    clean = coerce_features(labelled, features).withColumn(label, F.col(label).cast("int"))
    in_train = hash_below(train_frac, "weak-label", F.col(id_col))
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
            RandomForestClassifier(
                featuresCol="_features", labelCol=label, featureSubsetStrategy="sqrt", numTrees=n_trees, seed=seed
            ),
        ]
    )
    model = pipeline.fit(clean.where(in_train))
    held_out = score(model, clean.where(~in_train))
    return model, rank_metrics(held_out, ["average_precision", "roc_auc"], label=label)


def score(model: PipelineModel, df: DataFrame, alias: str = "pred") -> DataFrame:
    """Rows with the positive-class probability of a fitted pipeline."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.element_at(vector_to_array("probability"), -1).alias(alias))


def weak_flu_probability(
    surveys: DataFrame, labs: DataFrame, activity: DataFrame, survey_features: Sequence[str],
    activity_features: Sequence[str], *, onset_min: int = 0, onset_max: int = 0, n_trees: int = 100,
) -> DataFrame:
    """(participant_id, date, label): 0 or 1 where a lab result exists, else the model's probability for first reports."""
    results = (
        labs.withColumn("date", day_of("trigger_datetime"))
        .withColumn("is_pos", (F.col("result") == POSITIVE) & F.col("test_name").isin(*FLU_TESTS))
        .groupBy(*KEY, "first_report_yn").agg(F.bool_or("is_pos").alias("is_pos"))
    )
    merged = (
        surveys.withColumn("date", day_of("timestamp"))
        .join(results, [*KEY, "first_report_yn"], "left")
        .join(activity.select(*KEY, *activity_features), KEY, "left")
    )
    features = [*survey_features, *activity_features]
    known = merged.where(F.col("is_pos").isNotNull())
    model, _ = fit_label_model(known, features, label="is_pos", n_trees=n_trees)
    unknown = coerce_features(merged.where(F.col("is_pos").isNull() & F.col("first_report_yn")), features)
    probabilities = known.select(*KEY, F.col("is_pos").cast("double").alias("label")).unionByName(
        score(model, unknown.drop("is_pos"), "label").select(*KEY, "label")
    )
    per_day = probabilities.groupBy("participant_id", F.col("date").alias("_d")).agg(F.max("label").alias("label"))
    return expand_event_dates(per_day, F.col("_d"), onset_min, onset_max).groupBy(*KEY).agg(
        F.max("label").alias("label")
    )


def spread(df: DataFrame, features: str = "features", rows: int | None = None) -> DataFrame:
    """``df`` dealt by its other columns into partitions of about ``ROWS_PER_TASK`` rows.

    Each pass of a fit reads and caches whole partitions, so their number has to grow with the
    rows; the shuffle also spares the passes what is in front of it. What fits one task stays as
    it is. ``rows`` is a bound of the rows where one is known, else they are counted.
    """
    rows = df.count() if rows is None else rows
    if rows <= ROWS_PER_TASK:
        return df
    tasks = max(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *[c for c in df.columns if c != features])


def fit_boosted_trees(
    train: DataFrame, features: str = "features", *, label: str = "label", max_depth: int = 2, rounds: int = 10,
    step_size: float = 1.0, seed: int = 7, rows: int | None = None,
) -> PipelineModel:
    """Boosted trees (depth 2, 10 rounds by default) on an array column of features; ``rows`` as in :func:`spread`."""
    trees = GBTClassifier(
        featuresCol="_features", labelCol=label, maxDepth=max_depth, maxIter=rounds, stepSize=step_size, seed=seed
    )
    return Pipeline(stages=[trees]).fit(with_vector(spread(train, features, rows), features))


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))


def predictions_table(
    model: PipelineModel, windows: DataFrame, features: str = "features", label: str = "label"
) -> DataFrame:
    """participant_id, date, label, pred of a scored window table."""
    return score(model, with_vector(windows, features)).select(*KEY, label, "pred")


def random_reconstructions(
    train: DataFrame, evaluation: DataFrame, column: str, *, id_col: str = "id", seed: str = "recon"
) -> DataFrame:
    """Each evaluation row "reconstructed" by a random training row: (id, target, pred).

    Training rows get dense ids in hash order and every evaluation row draws one
    of them by hash: an equi-join on the drawn id.
    """
    ranked = hash_rank(train.select(id_col, column), [id_col], seed, alias="_row").select(
        "_row", F.col(column).alias("pred")
    )
    total = train.agg(F.count(F.lit(1))).scalar()
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10)
    wanted = evaluation.select(
        id_col, F.col(column).alias("target"), (F.pmod(draw.cast("bigint"), total) + 1).alias("_row")
    )
    return wanted.join(ranked, "_row").drop("_row")
