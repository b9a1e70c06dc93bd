"""Packed device strings, sleep maps, gap filling, array channels, pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import SLEEP_STAGE_CLASS, clip, remap, round_to_step, seconds_into_day

DAY_SECONDS = 86_400


def _interval(seconds: Column) -> Column:
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


# --- packed strings ----------------------------------------------------------


def _explode_tokens(
    df: DataFrame, start: Column, slots: Column, text_col: str, value: str, step_seconds: int,
    keep: Sequence[str], separator: str, clip_max: float | None, mode: str,
) -> DataFrame:
    if mode not in ("strict", "trim"):
        raise ValueError("mode must be 'strict' or 'trim'")
    tokens = F.split(F.col(text_col), f"[{separator}]")
    packed = df.where(F.col(text_col).isNotNull()).select(
        *keep, start.alias("_start"), slots.cast("int").alias("_slots"), tokens.alias("_tokens")
    )
    if mode == "strict":
        wrong = F.raise_error(
            F.concat(F.lit("expected "), F.col("_slots").cast("string"), F.lit(" tokens, got "), F.size("_tokens").cast("string"))
        )
        checked = F.when(F.size("_tokens") == F.col("_slots"), F.col("_tokens")).otherwise(wrong.cast("array<string>"))
        packed = packed.withColumn("_tokens", checked)
    number = F.col("_token").try_cast("double")
    if mode == "strict":
        number = F.col("_token").cast("double")
    rows = packed.select(*keep, "_start", "_slots", F.size("_tokens").alias("_size"), F.posexplode("_tokens").alias("_pos", "_token"))
    dropped = []
    if mode == "trim":
        dropped = [F.greatest(F.col("_size") - F.col("_slots"), F.lit(0)).alias("tokens_dropped")]
    return rows.where(F.col("_pos") < F.col("_slots")).select(
        *keep, *dropped,
        (F.col("_start") + _interval(F.col("_pos") * F.lit(step_seconds))).alias("timestamp"),
        clip(number, upper=clip_max).alias(value),
    )


def explode_day_string(
    df: DataFrame, text_col: str, value: str, *, key: str = "participant_id", date_col: str = "dt",
    step_seconds: int = 60, separator: str = " ", clip_max: float | None = 200, mode: str = "strict",
) -> DataFrame:
    """One row per token of a packed day; token i stands for ``date + i * step``.

    ``strict`` fails on a wrong token count or a non-number, ``trim`` keeps the
    slots inside the day, nulls non-numbers and adds ``tokens_dropped``, how many
    tokens of the row's day lie beyond its slots.
    """
    start = F.col(date_col).cast("timestamp_ntz")
    slots = F.lit(DAY_SECONDS // step_seconds)
    return _explode_tokens(df, start, slots, text_col, value, step_seconds, [key], separator, clip_max, mode)


def explode_session_string(
    df: DataFrame, text_col: str, value: str, *, start_col: str, slots_col: str, key: str = "participant_id",
    step_seconds: int = 60, separator: str = " ", clip_max: float | None = 200, mode: str = "strict",
) -> DataFrame:
    """As :func:`explode_day_string`, anchored at a start rounded to the step."""
    start = round_to_step(start_col, step_seconds)
    return _explode_tokens(df, start, F.col(slots_col), text_col, value, step_seconds, [key], separator, clip_max, mode)


def explode_constant(
    df: DataFrame, value: str, *, start_col: str, seconds_col: str, key: str = "participant_id",
    step_seconds: int = 60, clip_max: float | None = 200,
) -> DataFrame:
    """Repeat one value for each slot of ``[start, start + seconds)``, start rounded to the step."""
    count = F.ceil(F.col(seconds_col) / F.lit(step_seconds)).cast("int")
    rows = df.where(F.col(seconds_col) > 0).select(
        key, round_to_step(start_col, step_seconds).alias("_start"),
        clip(F.col(value), upper=clip_max).alias(value),
        F.explode(F.sequence(F.lit(0), count - 1)).alias("_pos"),
    )
    return rows.select(
        key, (F.col("_start") + _interval(F.col("_pos") * F.lit(step_seconds))).alias("timestamp"), value
    )


def last_per_slot(
    df: DataFrame, value_cols: Sequence[str], order_cols: Sequence[str], *, key: str = "participant_id",
    ts_col: str = "timestamp", step_seconds: int = 60,
) -> DataFrame:
    """Last observation per (participant, slot); ``order_cols`` settles ties."""
    slot = slot_start(F.col(ts_col), step_seconds)
    last = F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_last")
    return (
        df.where(F.col(ts_col).isNotNull()).groupBy(key, slot.alias("_slot")).agg(last)
        .select(key, F.col("_slot").alias(ts_col), "_last.*")
    )


def slot_start(ts: Column, step_seconds: int) -> Column:
    """Start of the slot that holds ``ts``, counted from its midnight."""
    into_day = seconds_into_day(ts)
    return ts.cast("date").cast("timestamp_ntz") + _interval(into_day - F.pmod(into_day, F.lit(step_seconds)))


# --- stage maps --------------------------------------------------------------

SLEEP_MAP_TYPE = "map<string,array<struct<startTimeInSeconds:bigint,endTimeInSeconds:bigint>>>"


def flatten_sleep_levels(
    df: DataFrame, json_col: str = "sleepLevelsMap", stages: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per stage segment of a JSON stage map, with its numeric class."""
    stages = dict(stages or SLEEP_STAGE_CLASS)
    keep = [c for c in df.columns if c != json_col]
    levels = df.select(*keep, F.explode(F.from_json(json_col, SLEEP_MAP_TYPE)).alias("sleep_type", "_segments"))
    segments = levels.where(F.col("sleep_type").isin(*stages)).select(
        *keep, "sleep_type", F.explode("_segments").alias("_segment")
    )
    return segments.where(F.col("_segment").isNotNull()).select(
        *keep, "sleep_type", "_segment.*", remap("sleep_type", stages).alias("sleep_classic")
    )


def expand_event_dates(df: DataFrame, date: Column, onset_min: int, onset_max: int, alias: str = "date") -> DataFrame:
    """Every event day d becomes the days ``d - onset_min .. d + onset_max``.

    ``onset_min`` is subtracted, so ``(-1, 5)`` means d+1 to d+5; an empty range
    gives no rows.
    """
    if onset_min + onset_max < 0:
        return df.withColumn(alias, date).where(F.lit(False))
    days = F.sequence(F.date_sub(date, onset_min), F.date_add(date, onset_max))
    return df.withColumn(alias, F.explode(days))


# --- day pages: one row per participant and day, channels as arrays ----------


def day_pages(
    df: DataFrame, channels: Sequence[str], *, key: str = "participant_id", ts_col: str = "timestamp"
) -> DataFrame:
    """Channels of each (participant, day) as arrays ordered by time.

    One sort of one struct list serves all channels. The list is bounded by the
    slots of a day when (participant, timestamp) is unique.
    """
    entries = F.sort_array(F.collect_list(F.struct(ts_col, *channels)))
    return (
        df.groupBy(key, F.col(ts_col).cast("date").alias("date")).agg(entries.alias("_e"))
        .select(key, "date", *[F.col(f"_e.{c}").alias(c) for c in channels])
    )


def _gap(first: Column, last: Column, default: Column, entry_type: str) -> Column:
    filled = F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("slot"), default.alias("v")))
    return F.when(first <= last, filled.cast(entry_type)).otherwise(F.array().cast(entry_type))


def gap_filled_pages(
    df: DataFrame, defaults: Mapping[str, Column], *, key: str = "participant_id",
    ts_col: str = "timestamp", step_seconds: int = 60,
) -> DataFrame:
    """Regular series from each participant's first to last slot, as day pages.

    ``df`` has at most one row per (participant, slot). Rows and an empty grid
    of days meet in one group-by on (participant, day): one shuffle of the
    observed rows, no join, and gap slots are generated after it. Returns
    ``first_slot`` (slot number of entry 0) and one array per channel; slots
    without a row get the channel's default.
    """
    channels = list(defaults)
    last_slot = DAY_SECONDS // step_seconds - 1
    day = F.col(ts_col).cast("date")

    def slot_of(ts: str) -> Column:
        return F.floor(seconds_into_day(ts) / F.lit(step_seconds)).cast("int")

    observed = df.select(
        key, day.alias("date"), F.struct(slot_of(ts_col).alias("slot"), F.struct(*channels).alias("v")).alias("entry")
    )
    entry_type = observed.schema["entry"].dataType
    list_type = f"array<{entry_type.simpleString()}>"
    value_type = entry_type["v"].dataType
    default = F.struct(*[defaults[c].cast(value_type[c].dataType).alias(c) for c in channels])

    spans = df.groupBy(key).agg(F.min(ts_col).alias("_lo"), F.max(ts_col).alias("_hi"))
    grid = spans.select(
        key, "_lo", "_hi",
        F.explode(F.sequence(F.col("_lo").cast("date"), F.col("_hi").cast("date"))).alias("date"),
    )
    grid = grid.select(
        key, "date",
        F.when(F.col("date") == F.col("_lo").cast("date"), slot_of("_lo")).otherwise(0).alias("_from"),
        F.when(F.col("date") == F.col("_hi").cast("date"), slot_of("_hi")).otherwise(last_slot).alias("_to"),
    )
    pages = (
        observed.unionByName(grid, allowMissingColumns=True)
        .groupBy(key, "date")
        .agg(
            F.sort_array(F.collect_list("entry")).alias("_e"),
            F.max("_from").alias("_from"), F.max("_to").alias("_to"),
        )
    )
    entries = F.col("_e")
    first_seen = F.coalesce(F.get(entries, F.lit(0))["slot"], F.col("_to") + 1)
    head = _gap(F.col("_from"), first_seen - 1, default, list_type)
    body = F.flatten(
        F.transform(
            entries,
            lambda e, i: F.concat(
                F.array(e),
                _gap(
                    e["slot"] + 1,
                    F.coalesce(F.get(entries, i + 1)["slot"], F.col("_to") + 1) - 1,
                    default, list_type,
                ),
            ),
        )
    )
    return (
        pages.withColumn("_all", F.concat(head, body))
        .select(
            key, "date", F.col("_from").alias("first_slot"),
            *[F.col(f"_all.v.{c}").alias(c) for c in channels],
        )
    )


def pages_to_rows(
    pages: DataFrame, channels: Sequence[str], *, key: str = "participant_id",
    ts_col: str = "timestamp", step_seconds: int = 60,
) -> DataFrame:
    """Day pages back to one row per slot."""
    rows = pages.select(key, "date", "first_slot", F.posexplode(F.arrays_zip(*channels)).alias("_pos", "_v"))
    at = F.col("date").cast("timestamp_ntz") + _interval((F.col("first_slot") + F.col("_pos")) * F.lit(step_seconds))
    return rows.select(key, "date", at.alias(ts_col), *[F.col(f"_v.{c}").alias(c) for c in channels])




def spine_defaults() -> dict[str, Column]:
    """What an unobserved slot holds: zero values, both missing flags, no sleep class."""
    return {
        "heart_rate": F.lit(0), "steps": F.lit(0),
        "missing_heart_rate": F.lit(True), "missing_steps": F.lit(True),
        **{f"sleep_classic_{k}": F.lit(False) for k in range(4)},
    }


# --- arrays ------------------------------------------------------------------


def stack_channels(df: DataFrame, channels: Sequence[str] | None = None, alias: str = "inputs") -> DataFrame:
    """(time x channel) matrix in the given order, or by sorted name."""
    channels = list(channels or sorted(df.columns))
    zipped = F.arrays_zip(*[F.col(c).cast("array<double>") for c in channels])
    names = [f.name for f in df.select(zipped.alias("z")).schema["z"].dataType.elementType.fields]
    return df.withColumn(alias, F.transform(zipped, lambda z: F.array(*[z[n] for n in names])))


def flatten_matrix(df: DataFrame, matrix: str = "inputs", alias: str = "features") -> DataFrame:
    """Row-major feature vector of a stacked window."""
    return df.withColumn(alias, F.flatten(matrix))


# --- report tables -----------------------------------------------------------


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_table(df: DataFrame, index: Sequence[str], column: str, value: str, columns: Sequence, agg=F.avg) -> DataFrame:
    """Wide table with a declared column list, so no extra pass discovers it."""
    return df.groupBy(*index).pivot(column, list(columns)).agg(agg(value))


def mark_best(df: DataFrame, value: str, by: Sequence[str], alias: str = "is_best") -> DataFrame:
    """Flag rows that hold the maximum of their group (all of them on a tie)."""
    best = df.groupBy(*by).agg(F.max(value).alias("_best"))
    return df.join(best, list(by)).withColumn(alias, F.col(value) == F.col("_best")).select(*df.columns, alias)
