"""Channel alignment, as-of and range joins, label lookup, pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.columns import epoch_seconds
from pulsegrid.functions.hashing import hash_below
from pulsegrid.functions.permute import permute
from pulsegrid.operators.ordered import hash_rank


def align_channels(steps: DataFrame, heart_rate: DataFrame, sleep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps with the heart rate and sleep of the same minute; only minutes with steps stay."""
    keys = list(keys)
    return steps.join(heart_rate, keys, "left").join(sleep, keys, "left")


def survey_labs_activity(
    surveys: DataFrame, labs: DataFrame, activity: DataFrame,
    lab_keys: Sequence[str] = ("participant_id", "date", "first_report_yn"),
    activity_keys: Sequence[str] = ("participant_id", "date"),
) -> DataFrame:
    return surveys.join(labs, list(lab_keys), "left").join(activity, list(activity_keys), "left")


def asof_backward(
    left: DataFrame, right: DataFrame, *, key: str, left_ts: str, right_ts: str, right_cols: Sequence[str],
    tie_col: str, tolerance_days: int = 7, bucket_seconds: int = 3600,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, within the tolerance.

    Equal right timestamps resolve to the largest ``tie_col``; without a match
    the right columns are null.

    Only distinct times take part: right rows shrink to one per (key, time) and
    left rows to their distinct (key, time) before anything is ordered. The
    ordered scan then runs per (key, time bucket). What a bucket inherits from
    earlier ones comes from a second, small scan over one row per (key, bucket),
    which the calendar bounds. A key with a third of the rows therefore spreads
    over all its buckets.
    """
    payload = [right_ts, *right_cols]

    def bucket(ts: str) -> Column:
        return F.floor(epoch_seconds(ts) / F.lit(bucket_seconds)).cast("bigint")

    best_tie = F.max_by(F.struct(*payload), F.col(tie_col)).alias("_r")
    points = (
        right.where(F.col(right_ts).isNotNull()).groupBy(key, F.col(right_ts).alias("_t")).agg(best_tie)
        .withColumn("_b", bucket("_t"))
    )
    probes = (
        left.where(F.col(left_ts).isNotNull()).select(key, F.col(left_ts).alias("_t")).distinct()
        .withColumn("_b", bucket("_t"))
    )

    # One row per (key, bucket): the last right row in it, then carried forward.
    ends = points.groupBy(key, "_b").agg(F.max_by("_r", "_t").alias("_end")).unionByName(
        probes.select(key, "_b").distinct(), allowMissingColumns=True
    ).groupBy(key, "_b").agg(F.max_by("_end", F.col("_end").isNotNull()).alias("_end"))
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(key, "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))

    both = points.select(key, "_b", "_t", "_r").unionByName(
        probes.select(key, "_b", "_t", F.lit(True).alias("_probe")), allowMissingColumns=True
    )
    # A right row sorts before a probe of the same time, hence counts as matched.
    inside = W.partitionBy(key, "_b").orderBy("_t", F.coalesce(F.col("_probe"), F.lit(False))).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    scanned = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside)).where(F.col("_probe"))
    latest = scanned.join(carried, [key, "_b"]).select(
        key, "_t", F.coalesce("_hit", "_carry").alias("_m")
    )
    within = F.col(f"_m.{right_ts}") >= F.col("_t") - F.make_dt_interval(days=F.lit(tolerance_days))
    matched = latest.select(key, F.col("_t").alias(left_ts), F.when(within, F.col("_m")).alias("_m"))
    return left.join(matched, [key, left_ts], "left").select(
        *[F.col(c) for c in left.columns], *[F.col(f"_m.{c}").alias(c) for c in payload]
    )


def in_any_interval(
    results: DataFrame, intervals: DataFrame, *, key: str = "participant_id", date_col: str = "date",
    start_col: str = "start", end_col: str = "end", chunk_days: int = 32,
) -> DataFrame:
    """Rows whose date lies in some interval of the same key, both ends included.

    Equality on the key alone would send a heavy key to one task and test every
    interval against every row. Intervals are listed under each calendar chunk
    they touch and the join key is (key, chunk).
    """
    def chunk(value: Column) -> Column:
        return F.floor(F.unix_date(value.cast("date")) / chunk_days).cast("int")

    spans = (
        intervals.where(F.col(start_col) <= F.col(end_col))
        .select(F.col(key).alias("_k"), F.col(start_col).alias("_s"), F.col(end_col).alias("_e"))
        .distinct()
        .withColumn("_c", F.explode(F.sequence(chunk(F.col("_s")), chunk(F.col("_e")))))
    )
    condition = (
        (F.col(key) == F.col("_k"))
        & (chunk(F.col(date_col)) == F.col("_c"))
        & F.col(date_col).between(F.col("_s"), F.col("_e"))
    )
    return results.join(spans, condition, "left_semi")


def lookup_labels(
    windows: DataFrame, labels: DataFrame, *, label_col: str = "label", default=0,
    keys: Sequence[str] = ("participant_id", "date"), alias: str = "label",
) -> DataFrame:
    """Windows with the label of their participant and last day, or ``default`` (a value, a list for a vector label, a Column).

    A label table with several rows for a key counts as the largest of them, so windows are never multiplied.
    """
    keys = list(keys)
    table = labels.groupBy(*keys).agg(F.max(label_col).alias("_label"))
    if isinstance(default, (list, tuple)):
        default = F.array(*[F.lit(float(x)) for x in default])
    fallback = default if isinstance(default, Column) else F.lit(default)
    return windows.join(table, keys, "left").select(
        *windows.columns, F.coalesce(F.col("_label"), fallback).alias(alias)
    )


def restrict_to_dates(df: DataFrame, listed: DataFrame, keys: Sequence[str] = ("participant_id", "date")) -> DataFrame:
    """Rows of a fold: those whose (participant, date) is listed."""
    return df.join(listed, list(keys), "left_semi")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on every column the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no common columns")
    return left.join(right, shared)


def append_day_features(
    labelled: DataFrame, features: DataFrame, default: Sequence[float], *, label_col: str = "label",
    keys: Sequence[str] = ("participant_id", "date"), alias: str = "label_vector",
) -> DataFrame:
    """Label followed by that day's feature vector, or the default vector."""
    keys = list(keys)
    table = features.select(*keys, F.col("features").alias("_f"))
    fallback = F.array(*[F.lit(float(x)) for x in default])
    vector = F.concat(F.array(F.col(label_col).cast("double")), F.coalesce(F.col("_f"), fallback))
    return labelled.join(table, keys, "left").select(*labelled.columns, vector.alias(alias))


# --- pairs -------------------------------------------------------------------


def _side(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) for c in df.columns])


def attach_sides(pairs: DataFrame, windows: DataFrame, id_col: str = "id") -> DataFrame:
    """Id pairs with every column of both windows, suffixed ``_l`` and ``_r``.

    Pairing works on ids alone; the wide channel arrays move only here.
    """
    return pairs.join(_side(windows, "_l"), f"{id_col}_l").join(_side(windows, "_r"), f"{id_col}_r")


def sample_pairs(
    windows: DataFrame, per_key: int, *, key: str = "participant_id", id_col: str = "id", seed: str = "same"
) -> DataFrame:
    """A uniform sample of ``per_key`` ordered pairs of windows of each participant, without repeats.

    A window may be paired with itself. A participant of n windows with at most
    ``per_key`` pairs (n * n) gets all of them; ``pairs_left_out`` says how many
    of a participant's pairs are missing. Draw k goes through a keyed bijection
    of the n * n pairs, so no pair is listed that is not taken. The draws of a
    heavy participant start from all its windows, and both joins have the
    unique key (participant, position).
    """
    ranked = hash_rank(windows.select(key, id_col), [id_col], seed, by=[key], alias="_pos", total="_n")
    n, first = F.col("_n"), F.col("_pos") - 1
    taken = F.least(F.lit(per_key).cast("bigint"), n * n)
    draws = ranked.select(key, "_n", F.explode(F.when(first < taken, F.sequence(first, taken - 1, n))).alias("_k"))
    pair = permute(F.concat(F.lit(f"{seed}:pairs:"), F.col(key).cast("string")), n * n, F.col("_k"))
    placed = draws.select(key, "_n", (n * n - taken).alias("pairs_left_out"), pair.alias("_pair")).select(
        key, "pairs_left_out", (F.floor(F.col("_pair") / n) + 1).alias("_l"), (F.pmod("_pair", n) + 1).alias("_r")
    )
    left = ranked.select(key, F.col("_pos").alias("_l"), F.col(id_col).alias(f"{id_col}_l"))
    right = ranked.select(key, F.col("_pos").alias("_r"), F.col(id_col).alias(f"{id_col}_r"))
    return placed.join(left, [key, "_l"]).join(right, [key, "_r"]).select(f"{id_col}_l", f"{id_col}_r", "pairs_left_out")


def sequential_pairs(
    windows: DataFrame, *, key: str = "participant_id", end_col: str = "end", offset_days: int = 7
) -> DataFrame:
    """Window pairs of one participant where the right one ends ``offset_days`` later."""
    left, right = _side(windows, "_l"), _side(windows, "_r")
    shifted = F.col(f"{end_col}_r") - F.make_dt_interval(days=F.lit(offset_days))
    return left.join(
        right, (F.col(f"{key}_l") == F.col(f"{key}_r")) & (F.col(f"{end_col}_l") == shifted)
    )


def random_pair_rounds(windows: DataFrame, *, id_col: str = "id", rounds: int = 11, seed: str = "pair") -> DataFrame:
    """Id pairs of several rounds of random pairing: in each, every window is once left and once right.

    Ids are ranked once, in hash order. Every round has a bijection of the
    positions of its own, so rounds are independent of each other, and a pair
    or a window with itself may come up again as chance has it. One window is
    paired with itself in all rounds.
    """
    ranked = hash_rank(windows.select(id_col), [id_col], seed, alias="_pos", total="_n")
    turns = ranked.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    tag = F.concat(F.lit(f"{seed}:"), F.col("_round").cast("string"))
    left = turns.select(F.col(id_col).alias(f"{id_col}_l"), (permute(tag, F.col("_n"), F.col("_pos") - 1) + 1).alias("_pos"))
    right = ranked.select(F.col(id_col).alias(f"{id_col}_r"), "_pos")
    return left.join(right, "_pos").select(f"{id_col}_l", f"{id_col}_r")


def sequential_task_pairs(
    windows: DataFrame, *, id_col: str = "id", offset_days: int = 7, seed: str = "seq"
) -> DataFrame:
    """Pairs with the columns of both windows: half of the sequential pairs as they are, the right sides of the others re-dealt."""
    l_id, r_id = f"{id_col}_l", f"{id_col}_r"
    pairs = sequential_pairs(windows, offset_days=offset_days)
    is_kept = hash_below(0.5, seed, F.col(l_id), F.col(r_id))
    broken = pairs.where(~is_kept)
    left = [c for c in pairs.columns if c.endswith("_l")]
    right = [c for c in pairs.columns if c.endswith("_r")]
    l_rank = hash_rank(broken.select(*left), [l_id], f"{seed}:l", alias="_row")
    r_rank = hash_rank(broken.select(*right), [r_id], f"{seed}:r", alias="_row")
    dealt = l_rank.join(r_rank, "_row").select(*pairs.columns)
    return pairs.where(is_kept).unionByName(dealt)
