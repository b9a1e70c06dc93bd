"""Reproducible splits, sampling, shuffles and top-k measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import hash_below, hash_prefix, md5_of
from pulsegrid.operators.ordered import hash_rank, prefix_sums


def list_position(column: str, order: Sequence) -> Column:
    """1-based place of a value in a given order; unlisted values come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.when(position == 0, len(order) + 1).otherwise(position)


def order_by_list(df: DataFrame, column: str, order: Sequence, *then: str) -> DataFrame:
    return df.orderBy(list_position(column, order), *then)


def row_cap(df: DataFrame, n: int, keys: Sequence[str], seed: str = "cap") -> DataFrame:
    """A reproducible sample of ``n`` rows: the first in hash order of the keys."""
    ranked = hash_rank(df, keys, seed, alias="_cap")
    return ranked.where(F.col("_cap") <= n).drop("_cap")


def temporal_participant_split(
    df: DataFrame, split_at: str, *, test_frac: float = 0.5, end_at: str | None = None, seed: str = "split",
    key: str = "participant_id", ts_col: str = "timestamp", alias: str = "split",
) -> DataFrame:
    """train before ``split_at``; later rows go to eval or test by participant.

    The side is a function of the participant id, so no join or shuffle is
    needed and eval and test never share a participant.
    """
    if end_at is not None:
        df = df.where(F.col(ts_col) < F.lit(end_at).cast(df.schema[ts_col].dataType))
    before = F.col(ts_col) < F.lit(split_at).cast(df.schema[ts_col].dataType)
    side = F.when(hash_below(test_frac, seed, F.col(key)), "test").otherwise("eval")
    return df.withColumn(alias, F.when(before, "train").otherwise(side))


def _hash_cuts(participants: DataFrame, key: str, seed: str, fracs: Sequence[float]) -> list[Column]:
    """Per fraction the md5 of the last participant inside it, as a scalar.

    A participant is among the first ``int(frac * n)`` in hash order exactly
    when its md5 is not above the cut. The big table is then split by an
    expression: only the distinct participants are ranked, and no row is joined.
    """
    ranked = hash_rank(participants.select(key).distinct(), [key], seed, alias="_rank", total="_n", hash_as="_h")
    cuts = ranked.agg(
        F.struct(
            *[
                F.max(F.when(F.col("_rank") <= F.floor(F.lit(float(frac)) * F.col("_n")), F.col("_h"))).alias(f"c{i}")
                for i, frac in enumerate(fracs)
            ]
        ).alias("cuts")
    ).scalar()
    return [F.coalesce(cuts[f"c{i}"], F.lit("")) for i in range(len(fracs))]


def exact_temporal_split(
    df: DataFrame, split_at: str, *, test_frac: float = 0.5, end_at: str | None = None, seed: str = "exact",
    separate_train_and_eval: bool = False, key: str = "participant_id", ts_col: str = "timestamp",
) -> DataFrame:
    """Exactly ``int(frac * n)`` of the participants seen after the split are test.

    Their later rows are test. All other rows are train, or train and eval by
    date when the two are to be kept apart.
    """
    if end_at is not None:
        df = df.where(F.col(ts_col) < F.lit(end_at).cast(df.schema[ts_col].dataType))
    late = F.col(ts_col) >= F.lit(split_at).cast(df.schema[ts_col].dataType)
    (cut,) = _hash_cuts(df.where(late), key, seed, [test_frac])
    rest = F.when(late, "eval").otherwise("train") if separate_train_and_eval else F.lit("train_eval")
    return df.withColumn("split", F.when(late & (md5_of(seed, F.col(key)) <= cut), "test").otherwise(rest))


def user_split(
    df: DataFrame, *, eval_frac: float, test_frac: float, seed: str = "user", key: str = "participant_id"
) -> DataFrame:
    """Participants into test, eval and train: the first ``eval_frac`` is held out, ``test_frac`` of it is test."""
    test_cut, eval_cut = _hash_cuts(df, key, seed, [test_frac * eval_frac, eval_frac])
    place = md5_of(seed, F.col(key))
    side = F.when(place <= test_cut, "test").when(place <= eval_cut, "eval").otherwise("train")
    return df.withColumn("split", side)


def two_way_split(df: DataFrame, frac: float, *, seed: str = "two", key: str = "participant_id") -> DataFrame:
    """Participants into left (``int(frac * n)`` of them) and right."""
    (cut,) = _hash_cuts(df, key, seed, [frac])
    return df.withColumn("side", F.when(md5_of(seed, F.col(key)) <= cut, "left").otherwise("right"))


def keep_positives_sample_negatives(
    df: DataFrame, frac: float, *, label: str = "label", id_col: str = "id", seed: str = "neg"
) -> DataFrame:
    return df.where((F.col(label) == 1) | hash_below(frac, seed, F.col(id_col)))


def half_split(df: DataFrame, keys: Sequence[str], seed: str = "half", alias: str = "half") -> DataFrame:
    return df.withColumn(alias, F.when(hash_below(0.5, seed, *[F.col(k) for k in keys]), "a").otherwise("b"))


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: str = "shuffle") -> DataFrame:
    """Rows in hash order: a range-partitioned sort, repeatable unlike ``rand()``."""
    return df.orderBy(hash_prefix(seed, *[F.col(k) for k in keys]), *keys)


def surrogate_id(df: DataFrame, keys: Sequence[str], alias: str = "id", seed: str = "id") -> DataFrame:
    """Dense ids 1 to n in hash order of the row's keys: unique, without gaps, the same after a re-run or a lost executor.

    Rows are numbered inside the buckets of :func:`hash_rank` and bucket totals
    give what comes before. Rows with equal keys get ids of their own, in any order.
    """
    return hash_rank(df, keys, seed, alias=alias)


def sample_points(df: DataFrame, limit: int, keys: Sequence[str], seed: str = "points") -> DataFrame:
    """At most ``limit`` points of a curve, picked by hash order; the sampling is the feature."""
    return df.orderBy(hash_prefix(seed, *[F.col(k) for k in keys]), *keys).limit(limit)


def precision_at_k(
    preds: DataFrame, ks: Sequence[int | float], *, label: str = "label",
    score: str = "pred", id_col: str = "id",
) -> DataFrame:
    """Mean label of the k best-scored rows; a float k is a fraction of the rows.

    Ties at the cut go by hash order of the id. Scores are counted per distinct
    value first; only the rows of the tied value at a cut are looked at again,
    ranked in hash buckets.
    """
    counts = preds.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("pos"))
    ranked = prefix_sums(counts.withColumn("_down", -F.col(score)), "_down", ["n", "pos"])
    total = F.col("n_total")
    names = [str(k) for k in ks]
    wanted = [
        (F.floor(F.lit(k) * total) if isinstance(k, float) else F.least(F.lit(k), total)).cast("bigint") for k in ks
    ]

    # One row: per k the hits above the cut, the score at the cut and how many of its rows to take.
    through = F.col("n_before") + F.col("n")
    cuts = ranked.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("k"), F.max(w).alias("n_top"),
                    F.coalesce(F.sum(F.when(through <= w, F.col("pos"))), F.lit(0)).alias("hits"),
                    F.max(F.when((F.col("n_before") < w) & (through > w), F.col(score))).alias("_score"),
                    F.max(F.when((F.col("n_before") < w) & (through > w), w - F.col("n_before"))).alias("_take"),
                )
                for name, w in zip(names, wanted)
            ]
        ).alias("_cuts")
    ).select(F.inline("_cuts"))
    # As many rows as there are k's.
    tied = preds.join(F.broadcast(cuts.where("_take > 0")), preds[score] == F.col("_score")).select(
        "k", id_col, label, "_take"
    )
    taken = hash_rank(tied, [id_col], "tie", by=["k"]).where(F.col("hash_rank") <= F.col("_take"))
    extra = taken.groupBy("k").agg(F.sum(label).alias("_extra"))
    hits = F.col("hits") + F.coalesce("_extra", F.lit(0))
    return cuts.join(extra, "k", "left").select(
        "k", "n_top", F.try_divide(hits.cast("double"), "n_top").alias("precision_at_k")
    )


def precision_reference_lines(preds: DataFrame, ks: Sequence[float], *, label: str = "label") -> DataFrame:
    """Per k: prevalence (random order) and the best reachable precision."""
    totals = preds.agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("double").alias("n_pos"))
    return totals.select(
        F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k"), "n", "n_pos"
    ).select(
        "k", (F.col("n_pos") / F.col("n")).alias("prevalence"),
        F.least(F.lit(1.0), F.col("n_pos") / (F.col("n") * F.col("k"))).alias("oracle"),
    )
