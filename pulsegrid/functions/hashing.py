"""Reproducible randomness: md5 of a seed and a key instead of ``rand()``.

The same key always gets the same draw, in any partitioning, after an executor
loss and in any engine that has md5, so splits and resamples can be recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative probabilities of Poisson(1), times 2**32, as hex.
POISSON1_THRESHOLDS = (
    "5e2d58d8",
    "bc5ab1b1",
    "eb715e1d",
    "fb239797",
    "ff1025f5",
    "ffd90f3b",
    "fffa8b71",
    "ffff540c",
)


def _text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def md5_of(seed: str | Column, *keys) -> Column:
    """md5 hex of ``seed:key1:key2...``."""
    parts = [_text(seed)]
    for key in keys:
        parts += [F.lit(":"), _text(key)]
    return F.md5(F.concat(*parts).cast("binary"))


def hash_prefix(seed: str | Column, *keys) -> Column:
    """First 8 hex digits of :func:`md5_of`; uniform and ordered as text."""
    return F.substring(md5_of(seed, *keys), 1, 8)


def fraction_threshold(frac: float) -> str:
    """Hex text below which a fraction ``frac`` of the hash prefixes falls."""
    if not 0 <= frac <= 1:
        raise ValueError(f"fraction must be in [0, 1], got {frac}")
    return "g" if frac == 1 else format(int(frac * 2**32), "08x")


def hash_below(frac: float, seed: str, *keys) -> Column:
    """True for a reproducible fraction ``frac`` of the keys."""
    return hash_prefix(seed, *keys) < F.lit(fraction_threshold(frac))


def poisson_weight(prefix: Column) -> Column:
    """Poisson(1) draw from a hash prefix: how often a row occurs in one bootstrap resample.

    ``prefix`` occurs once per threshold here, so pass a column that holds it.
    """
    weight = F.lit(0)
    for threshold in POISSON1_THRESHOLDS:
        weight = weight + (prefix >= F.lit(threshold)).cast("int")
    return weight
