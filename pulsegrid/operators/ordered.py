"""Ranks, runs and cumulative sums that never put one key or one table in one task.

Spark's window functions sort each partition in one task. That is fine where a
partition is bounded (the slots of a day, the days of a calendar), and a
bottleneck where it is a whole table or a participant with a third of it. The
helpers here split such inputs into ordered buckets, scan the buckets
independently and add what lies before each bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import md5_of

MAX_BUCKETS = 1024
ROWS_PER_BUCKET = 1_000_000
SAMPLE_ROWS = 16 * MAX_BUCKETS


def _splitters(sample: Column, parts: Column) -> Column:
    """``parts`` - 1 values that cut the sorted ``sample`` evenly."""
    places = F.sequence(F.lit(1), parts - 1)
    cut = F.transform(places, lambda k: F.get(sample, F.floor(k * F.size(sample) / parts).cast("int")))
    return F.when(parts > 1, F.array_distinct(F.filter(cut, lambda x: x.isNotNull())))


def _bucket(value: Column, splitters: Column) -> Column:
    """How many splitters are at most ``value``, in two short scans of the sorted array."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(splitters)))).cast("int")
    starts = F.sequence(F.lit(0), F.floor((F.size(splitters) - 1) / width).cast("int"))
    block = F.size(F.filter(starts, lambda b: F.get(splitters, b * width) <= value)) - 1
    first = F.greatest(block, F.lit(0)) * width
    inside = F.size(F.filter(F.slice(splitters, first + 1, width), lambda x: x <= value))
    return F.when(splitters.isNull() | (F.size(splitters) == 0), 0).otherwise(first + inside).cast("int")


def _placed(df: DataFrame, value: Column, cuts: Column, columns: Sequence[str]) -> DataFrame:
    """``columns`` and ``_b``: :func:`_bucket` as a binary search, one projection a step, so that it runs as compiled code."""
    placed = df.select(*columns, cuts.alias("_c"), F.lit(0).alias("_b"))
    step = MAX_BUCKETS // 2
    while step:
        beyond = F.when(F.get("_c", F.col("_b") + (step - 1)) <= value, step).otherwise(0)
        placed = placed.select(*columns, "_c", (F.col("_b") + beyond).alias("_b"))
        step //= 2
    return placed.select(*columns, "_b")


def prefix_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``<c>_before`` and ``<c>_total``: the sum of ``c`` over smaller ``order_col`` and over all, within ``by``.

    ``df`` has one row per (``by``, ``order_col``); the order column is not
    null. A group with more than ``rows_per_bucket`` rows is cut into ordered
    buckets at even places of a sorted sample of its values, so buckets are
    even in size for any distribution. The sample only places the cuts: each
    bucket is scanned on its own, and exact bucket totals give what lies before it.

    The sample holds the values with the smallest hashes, about ``SAMPLE_ROWS``
    per group, so it is a function of the data and a recomputed task finds the
    same buckets. All branches read the same columns of ``df``: an aggregate in
    front of it is computed and shuffled once.
    """
    by = list(by)
    totals = [F.sum(c).alias(f"_t_{c}") for c in sum_cols]
    located = _bucketed(df, order_col, totals, by, rows_per_bucket)

    # At most MAX_BUCKETS rows per ``by`` group, whatever the input.
    sums = located.groupBy(*by, "_b").agg(*totals)
    earlier = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_t_{c}").over(W.partitionBy(*by)).alias(f"_n_{c}") for c in sum_cols],
    )
    inside = W.partitionBy(*by, "_b").orderBy(order_col).rowsBetween(W.unboundedPreceding, -1)
    return located.join(sums if by else F.broadcast(sums), [*by, "_b"]).select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sum_cols],
        *[F.col(f"_n_{c}").alias(f"{c}_total") for c in sum_cols],
    )


def _bucketed(df: DataFrame, order_col: str, totals: Sequence[Column], by: Sequence[str], rows_per_bucket: int, small=lambda one_per_group: one_per_group) -> DataFrame:
    """``df`` with ``_b``, the ordered bucket of each row within ``by``; ``totals`` read what later branches read."""
    value = F.col(order_col)
    # Group sizes; the sums are there to make this read the same shuffle as the other branches.
    size = F.struct(F.count(F.lit(1)).alias("n"), *totals)
    draw = F.pmod(F.xxhash64(value), F.lit(1 << 32))

    large = F.col("_g.n") > rows_per_bucket
    drawn = large & (draw * F.col("_g.n") < F.lit(SAMPLE_ROWS << 32).cast("double"))
    parts = F.least(F.ceil(F.col("_g.n") / F.lit(rows_per_bucket)), F.lit(MAX_BUCKETS)).cast("int")
    if by:
        taken = F.struct(F.sort_array(F.collect_list(value)).alias("v"), *totals)
        sized = df.groupBy(*by).agg(size.alias("_g"))
        sample = df.join(small(sized), by).where(drawn).groupBy(*by).agg(taken.alias("_v"))
        cuts = sized.join(small(sample), by, "left").select(*by, _splitters(F.col("_v.v"), parts).alias("_c"))
        located = df.join(small(cuts), by)
        return located.select(*df.columns, _bucket(value, F.col("_c")).alias("_b"))
    # Rows meet the few cuts, which the subquery makes, and never the sample. The sample is no
    # filter: one on the value alone would go below the aggregate of ``df`` and have it computed again.
    sample = F.sort_array(F.collect_list(F.when(drawn, value)))
    taken = F.struct(_splitters(sample, F.max(parts)).alias("c"), *totals)
    cuts = df.withColumn("_g", df.agg(size).scalar()).agg(taken).scalar()
    return _placed(df, value, cuts["c"], df.columns)


def vector_sum(counters: Column, over: WindowSpec | None = None) -> Column:
    """Element-wise sum of arrays of non-negative numbers, combined before the shuffle like any other sum.

    The L1 norm of the summarizer adds the numbers up as they are; its own
    ``sum`` goes through a running mean, which would not be exact.
    """
    summary = Summarizer.metrics("normL1").summary(array_to_vector(counters))
    return vector_to_array((summary if over is None else summary.over(over))["normL1"])


def prefix_vectors(df: DataFrame, order_col: str, counters: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """:func:`prefix_sums` of an array of counters: ``<counters>_before`` and ``<counters>_total``, element by element."""
    # The summarizer has no sum of no rows, so the whole table is a group of a constant, whose one row is broadcast.
    group = list(by) or ["_all"]
    small = (lambda rows: rows) if by else F.broadcast
    rows = df if by else df.withColumn("_all", F.lit(0))
    total = vector_sum(F.col(counters)).alias("_t")
    located = _bucketed(rows, order_col, [total], group, rows_per_bucket, small)
    # The summarizer takes no empty frame, so frames end with the row itself, which is then taken off.
    through = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = located.groupBy(*group, "_b").agg(total)
    sums = sums.select(*group, "_b", "_t", vector_sum(F.col("_t"), through).alias("_o"), vector_sum(F.col("_t"), W.partitionBy(*group)).alias("_n"))
    inside = W.partitionBy(*group, "_b").orderBy(order_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = located.join(small(sums), [*group, "_b"]).withColumn("_i", vector_sum(F.col(counters), inside))
    before = f"transform(_i, (x, i) -> _o[i] - _t[i] + x - {counters}[i])"
    return joined.selectExpr(*df.columns, f"{before} AS {counters}_before", f"_n AS {counters}_total")


def midranks(df: DataFrame, ranks: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Add 1-based ranks with ties averaged: ``{alias: (value column, by columns)}``.

    Equal values are counted first, so a value that fills a third of the table
    is one row in the scan. Null values get a null rank.
    """
    result = df
    for alias, (value, by) in ranks.items():
        by = list(by)
        counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
        ranked = prefix_sums(counts, value, ["_n"], by).select(
            *by, value, (F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(alias)
        )
        result = result.join(ranked, [*by, value], "left")
    return result.select(*df.columns, *ranks)


def midrank(df: DataFrame, value: str, by: Sequence[str] = (), alias: str = "midrank") -> DataFrame:
    return midranks(df, {alias: (value, by)})


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: str | Column,
    by: Sequence[str] = (),
    digits: int = 3,
    alias: str = "hash_rank",
    total: str | None = None,
    hash_as: str | None = None,
) -> DataFrame:
    """Dense 1-based position of each row in md5 order of its (unique) keys within ``by``.

    Buckets are the leading hex digits of the md5, hence even in size. The
    offsets table has at most 16**digits rows per ``by`` group. ``total`` names
    a column for the size of the group and ``hash_as`` one for the md5.
    """
    by = list(by)
    # Never null, so the join below does not have Spark hash every key once more to filter nulls.
    hashed = df.withColumn("_h", F.coalesce(md5_of(seed, *[F.col(k) for k in keys]), F.lit(""))).withColumn(
        "_hb", F.substring("_h", 1, digits)
    )
    totals = hashed.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_t"))
    group = W.partitionBy(*by)
    before = group.orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_hb", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"), F.sum("_t").over(group).alias("_n")
    )
    inside = W.partitionBy(*by, "_hb").orderBy("_h", *keys)
    extra = [F.col("_n").alias(total)] if total else []
    if hash_as:
        extra.append(F.col("_h").alias(hash_as))
    return hashed.join(offsets, [*by, "_hb"]).select(
        *df.columns, (F.col("_o") + F.row_number().over(inside)).cast("bigint").alias(alias), *extra
    )


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (), alias: str = "quantile") -> DataFrame:
    """Linearly interpolated quantile per ``by`` over groups of any size.

    ``percentile`` keeps every distinct value of a group in one task's memory;
    this counts values and reads the two at the wanted position off their
    prefix counts.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(counts, "_v", ["_n"], by)
    at = F.lit(float(q)) * (F.col("_n_total") - 1)
    low, high = F.floor(at), F.ceil(at)

    def holds(position: Column) -> Column:
        return (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))

    picked = placed.where(holds(low) | holds(high)).groupBy(*by).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"),
        F.max(at - low).alias("_w"),
    )
    return picked.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(alias))


# --- runs and islands --------------------------------------------------------


def streak_sizes(df: DataFrame, keys: Sequence[str], order_col: str, flag: Column) -> DataFrame:
    """Sizes of the runs of ``flag``, one row per run.

    A run id counts the rows whose flag differs from the next row's, the row
    itself included, and the last row counts as a change. The first run is thus
    one shorter and the last row forms a run of its own. ``keys`` must bound the
    group (a participant's day).
    """
    keys = list(keys)
    ordered = W.partitionBy(*keys).orderBy(order_col)
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        df.select(*keys, order_col, flag.alias("_flag"))
        .withColumn("_next", F.lead("_flag").over(ordered))
        .withColumn("_change", F.coalesce((F.col("_flag") != F.col("_next")).cast("int"), F.lit(1)))
        .withColumn("streak", F.sum("_change").over(running))
        .groupBy(*keys, "streak")
        .agg(F.count(F.lit(1)).alias("streak_size"))
    )


def day_islands(df: DataFrame, key: str, day_col: str) -> DataFrame:
    """(key, day, island): consecutive calendar days of one key share an island.

    Days are de-duplicated first, so a key's window is bounded by the calendar
    however many rows it has.
    """
    days = df.select(key, day_col).distinct()
    ordered = W.partitionBy(key).orderBy(day_col)
    gap = F.datediff(F.col(day_col), F.lag(day_col).over(ordered))
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.withColumn("_new", F.coalesce((gap != 1).cast("int"), F.lit(1))).select(
        key, day_col, F.sum("_new").over(running).alias("island")
    )


def keep_last(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Last row per key in the order of ``order_cols``: an aggregate, combined before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def best_so_far(df: DataFrame, metric: str, order_col: str, by: Sequence[str], higher_is_better: bool = True) -> DataFrame:
    """Running best of a metric over the epochs or runs of one experiment."""
    frame = W.partitionBy(*by).orderBy(order_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    agg = F.max if higher_is_better else F.min
    return df.withColumn(f"best_{metric}", agg(metric).over(frame))


# --- rolling days ------------------------------------------------------------


def rolling_days(
    df: DataFrame,
    key: str,
    day_col: str,
    value_cols: Sequence[str],
    days: int,
    block_days: int | None = None,
    alias: str = "frame",
) -> DataFrame:
    """For each (key, day) the rows of the last ``days`` days as an array of structs.

    ``df`` has one row per (key, day). The calendar is cut into blocks; a block
    also gets the last ``days - 1`` days of the block before it, so the frames
    of a heavy key are built in as many tasks as it has blocks. Only days with
    rows appear; callers test ``size(frame) = days`` for complete frames.
    """
    block_days = block_days or max(28, 4 * days)
    if block_days < days:
        raise ValueError("block_days must be at least days")
    rows = df.select(key, day_col, F.unix_date(day_col).alias("_day"), *value_cols)
    block = F.floor(F.col("_day") / block_days).cast("int")
    into_block = F.pmod(F.col("_day"), F.lit(block_days))
    spans = F.when(into_block > block_days - days, F.array(block, block + 1)).otherwise(F.array(block))
    placed = rows.withColumn("_block", F.explode(spans))
    frame = W.partitionBy(key, "_block").orderBy("_day").rangeBetween(-(days - 1), 0)
    return (
        placed.withColumn(alias, F.collect_list(F.struct(F.col(day_col), *value_cols)).over(frame))
        .where(F.col("_block") == block)
        .select(key, day_col, alias)
    )
