"""Tail probabilities of the normal and chi-square distributions as Column expressions.

``erfc`` has no built-in: near 0 its power series, further out its continued
fraction, each a fold over a literal sequence. They run in the JVM like any other expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEAR = 2.0
_SERIES, _FRACTION = 60, 160


def _scaled_erfc(x: Column) -> Column:
    """erfc(x) * exp(x * x) for x >= ``_NEAR``, from the innermost term of the fraction outwards."""
    steps = F.sequence(F.lit(_FRACTION), F.lit(1), F.lit(-1))
    inner = F.aggregate(steps, x, lambda acc, k: x + (k / 2.0) / acc)
    return 1.0 / (math.sqrt(math.pi) * inner)


def _near_erfc(x: Column) -> Column:
    """erfc(x) for 0 <= x < ``_NEAR``: 1 minus a sum of positive terms."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2.0 * x * x / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(_SERIES)), start, add, lambda acc: acc["total"])
    return 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x * x) * total


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    x = x.cast("double")
    return F.when(x < _NEAR, _near_erfc(x)).otherwise(F.exp(-x * x) * _scaled_erfc(x))


def normal_two_sided(z: Column | str) -> Column:
    """Two-sided normal p-value; null stays null."""
    z = F.col(z) if isinstance(z, str) else z
    return erfc(F.abs(z.cast("double")) / math.sqrt(2.0))


def normal_log10_two_sided(z: Column | str) -> Column:
    """log10 of the two-sided normal p-value, also where that is too small for a double."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z.cast("double")) / math.sqrt(2.0)
    far = (-x * x + F.log(_scaled_erfc(x))) / math.log(10.0)
    return F.when(x < _NEAR, F.log10(_near_erfc(x))).otherwise(far)


def chi2_upper(x: Column | str, dof: Column) -> Column:
    """Upper tail of chi-square with a whole number of degrees of freedom; 1 where x <= 0.

    The tail is a finite sum: exp(-h) times powers of h = x / 2 over factorials,
    which start at 1 (even) or after erfc(sqrt(h)) with half-integer gammas (odd).
    """
    x = F.col(x) if isinstance(x, str) else x
    h = x.cast("double") / 2.0
    odd = F.pmod(dof, F.lit(2)).cast("double")
    first = F.when(odd == 1, 2.0 * F.sqrt(h / math.pi)).otherwise(F.lit(1.0)) * F.exp(-h)
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        following = acc["term"] * h / (k + odd / 2.0)
        return F.struct(following.alias("term"), (acc["total"] + acc["term"]).alias("total"))

    count = ((dof - odd) / 2).cast("int")
    terms = F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), lambda k: (k >= 1) & (k <= count))
    total = F.aggregate(terms, start, add, lambda acc: acc["total"])
    tail = total + F.when(odd == 1, erfc(F.sqrt(h))).otherwise(F.lit(0.0))
    return F.when(h <= 0, F.lit(1.0)).otherwise(tail)
