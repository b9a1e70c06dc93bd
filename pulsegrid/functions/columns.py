"""Row-wise expressions on sensor, survey and report columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SLEEP_CLASSES = (0, 1, 2, 3)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside an array lambda an outer expression would be computed again for every
    element; as the variable of a one-element transform it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- numbers -----------------------------------------------------------------


def clip(value: str | Column, lower=None, upper=None) -> Column:
    """Bound a value; null stays null (``least``/``greatest`` alone skip nulls)."""
    value = _col(value)
    bounded = value
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(lower))
    if upper is not None:
        bounded = F.least(bounded, F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def numeric_or(value: str | Column, default: float = -1.0) -> Column:
    """Number in the cell, or ``default`` for null and unparsable text."""
    return F.coalesce(_col(value).cast("string").try_cast("double"), F.lit(float(default)))


def body_mass_over(weight, feet, inches, limit: float = 30.0) -> Column:
    """Body-mass index in pounds and inches above ``limit``; unknown is false."""
    height = F.lit(12.0) * _col(feet) + _col(inches)
    index = _col(weight) / (height * height) * F.lit(703.0)
    return F.coalesce(index > F.lit(limit), F.lit(False))


def softmax_last(logits: str | Column) -> Column:
    """Probability of the last class; shifted by the maximum so exp() cannot overflow."""
    logits = _col(logits)
    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return let(exps, lambda xs: F.element_at(xs, -1) / total(xs))


def window_zscore(channel: str | Column) -> Column:
    """(x - mean) / population std inside one array; unchanged when std is 0."""
    zero = F.lit(0.0).cast("double")

    def scale(xs: Column, mean: Column) -> Column:
        square = F.aggregate(xs, zero, lambda acc, x: acc + (x - mean) * (x - mean))
        return let(
            F.sqrt(square / F.size(xs)),
            lambda std: F.when(std == 0, xs).otherwise(F.transform(xs, lambda x: (x - mean) / std)),
        )

    total = lambda xs: F.aggregate(xs, zero, lambda acc, x: acc + x)
    return let(
        F.transform(_col(channel), lambda x: x.cast("double")),
        lambda xs: let(total(xs) / F.size(xs), lambda mean: scale(xs, mean)),
    )


# --- missingness and one-hot -------------------------------------------------


def missing_heart_rate(heart_rate: str | Column) -> Column:
    heart_rate = _col(heart_rate)
    return heart_rate.isNull() | (heart_rate == 0)


def sleep_one_hot(sleep: str | Column) -> dict[str, Column]:
    """Four flags ``sleep_classic_0..3``; an unknown class counts as 0."""
    sleep = F.coalesce(_col(sleep), F.lit(0))
    return {f"sleep_classic_{k}": sleep == F.lit(k) for k in SLEEP_CLASSES}


def minute_flags(heart_rate="heart_rate", steps="steps", sleep="sleep_classic") -> dict[str, Column]:
    """Channels of one observed minute: values, missing flags and sleep flags."""
    return {
        "heart_rate": _col(heart_rate),
        "steps": F.coalesce(_col(steps), F.lit(0)),
        "missing_heart_rate": missing_heart_rate(heart_rate),
        "missing_steps": _col(steps).isNull(),
        **sleep_one_hot(sleep),
    }


# --- time --------------------------------------------------------------------


def seconds_into_day(ts: str | Column) -> Column:
    """Whole seconds since the midnight of a zone-free timestamp."""
    ts = _col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 with microseconds, the same in every session time zone.

    Casting a zone-free timestamp to an instant would shift and, around clock
    changes, even reorder it.
    """
    ts = _col(ts)
    days = F.unix_date(ts.cast("date")).cast("bigint") * 86_400
    return days + (F.hour(ts) * 3600 + F.minute(ts) * 60) + F.extract(F.lit("SECOND"), ts)


def epoch_seconds_to_ts(seconds: str | Column) -> Column:
    """Unix seconds to a zone-free UTC timestamp."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=_col(seconds).cast("decimal(18,6)")
    )


def epoch_nanos_to_ts(nanos: str | Column) -> Column:
    """Nanoseconds since 1970 to UTC, cut to whole seconds."""
    return epoch_seconds_to_ts(F.floor(_col(nanos).cast("decimal(20,0)") / F.lit(1_000_000_000)))


def local_timestamp(seconds: str | Column, offset_seconds: str | Column) -> Column:
    """Unix seconds plus a zone offset in seconds, as wall-clock time."""
    return epoch_seconds_to_ts(_col(seconds) + _col(offset_seconds))


def label_date(window_end: str | Column) -> Column:
    """Last day inside a window whose end is exclusive."""
    return (_col(window_end) - F.expr("INTERVAL '0.001' SECOND")).cast("date")


def day_of(ts: str | Column) -> Column:
    return _col(ts).cast("date")


def round_to_step(ts: str | Column, seconds: int = 60) -> Column:
    """Nearest multiple of ``seconds``, half to even, as the device feeds expect."""
    steps = epoch_seconds(ts).cast("decimal(20,6)") / F.lit(seconds).cast("decimal(9,0)")
    return epoch_seconds_to_ts(F.bround(steps, 0) * F.lit(seconds))


def last_token_timestamp(text: str | Column, separator: str = "|") -> Column:
    """Timestamp after the last separator; null where it does not parse."""
    token = F.element_at(F.split(_col(text), f"[{separator}]"), -1)
    return F.try_to_timestamp(token).cast("timestamp_ntz")


def weekday_in(day: str | Column, weekdays: Iterable[int]) -> Column:
    """True when the weekday (Monday = 0) is in the list."""
    return F.weekday(_col(day)).isin(*weekdays)


# --- mapping -----------------------------------------------------------------


def remap(value: str | Column, mapping: Mapping) -> Column:
    """Value looked up in a literal map; unmapped values become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(value))


# Wearable sleep stage to sleep class.
SLEEP_STAGE_CLASS = {"light": 1, "deep": 2, "rem": 2, "awake": 3}
