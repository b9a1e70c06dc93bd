"""Day features of a minute (or hour) series, chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import streak_sizes

KEYS = ["participant_id", "date"]


def _rested() -> Column:
    return (F.col("steps") == 0) & ~F.col("missing_steps")


def _quantile(value: Column, q: float, where: Column) -> Column:
    # Integer heart rates: the percentile's state is a count per distinct value.
    return F.percentile(F.when(where, value), q)


def _hr() -> Column:
    return F.col("heart_rate").cast("int")


AGGREGATES: dict[str, Callable[[], Column]] = {
    "resting_hr_95th_percentile": lambda: _quantile(_hr(), 0.95, _rested()),
    "resting_hr_50th_percentile": lambda: _quantile(_hr(), 0.50, _rested()),
    "resting_hr_std": lambda: F.stddev_samp(F.when(_rested(), F.col("heart_rate"))),
    "hr_awake_95th_percentile": lambda: _quantile(_hr(), 0.95, F.col("sleep_classic_0")),
    "total_steps": lambda: F.sum("steps").cast("double"),
    "sleep_minutes": lambda: F.count_if(F.col("sleep_classic_2")).cast("double"),
    "in_bed_minutes": lambda: F.count_if(F.col("sleep_classic_1")).cast("double"),
    "missing_hr": lambda: F.bool_and("missing_heart_rate").cast("double"),
    "missing_steps": lambda: F.bool_and("missing_steps").cast("double"),
    "missing_sleep": lambda: F.bool_and("sleep_classic_0").cast("double"),
}
STREAKS = {
    "steps_moving_streak_95th_percentile": 0.95,
    "steps_moving_streak_50th_percentile": 0.50,
}
ALL_FEATURES = [*AGGREGATES, *STREAKS]

# Channels each feature reads, so that a series need not carry the others.
_RESTING = ["heart_rate", "steps", "missing_steps"]
FEATURE_CHANNELS: dict[str, list[str]] = {
    "resting_hr_95th_percentile": _RESTING,
    "resting_hr_50th_percentile": _RESTING,
    "resting_hr_std": _RESTING,
    "hr_awake_95th_percentile": ["heart_rate", "sleep_classic_0"],
    "total_steps": ["steps"],
    "sleep_minutes": ["sleep_classic_2"],
    "in_bed_minutes": ["sleep_classic_1"],
    "missing_hr": ["missing_heart_rate"],
    "missing_steps": ["missing_steps"],
    "missing_sleep": ["sleep_classic_0"],
    **{name: ["steps"] for name in STREAKS},
}


def channels_of(names: Sequence[str]) -> list[str]:
    """Channels a set of features needs, each once."""
    return list(dict.fromkeys(c for n in names for c in FEATURE_CHANNELS[n]))


def register_feature(name: str, build: Callable[[], Column], channels: Sequence[str]) -> None:
    """Add a feature: ``build`` returns an aggregate Column over one participant-day."""
    if name in ALL_FEATURES:
        raise ValueError(f"{name} exists")
    AGGREGATES[name] = build
    FEATURE_CHANNELS[name] = list(channels)
    ALL_FEATURES.append(name)


def day_features(series: DataFrame, names: Sequence[str], drop_incomplete: bool = True) -> DataFrame:
    """One row per participant and day with the named features as doubles.

    All plain features share one group-by; streak features need the order of
    the day and share one scan. A participant-day is bounded by its slots.
    """
    unknown = [n for n in names if n not in ALL_FEATURES]
    if unknown:
        raise NameError(f"unknown features: {unknown}")
    plain = [n for n in names if n in AGGREGATES]
    streaks = [n for n in names if n in STREAKS]
    parts = []
    if plain:
        parts.append(series.groupBy(*KEYS).agg(*[AGGREGATES[n]().alias(n) for n in plain]))
    if streaks:
        sizes = streak_sizes(series, KEYS, "timestamp", F.col("steps") == 0)
        parts.append(
            sizes.groupBy(*KEYS).agg(*[F.percentile("streak_size", STREAKS[n]).alias(n) for n in streaks])
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.join(part, KEYS)
    result = result.select(*KEYS, *names)
    return result.dropna() if drop_incomplete else result
