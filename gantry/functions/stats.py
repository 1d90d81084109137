"""Aggregate and scalar expressions shared by the operators. All give Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero(x: Column | str) -> Column:
    """Null as 0 (before sums and maxima that never give null)."""
    return F.coalesce(_c(x), F.lit(0))


def rate(numerator: Column | str, denominator: Column | str) -> Column:
    """Ratio, null where the denominator is 0 or null."""
    d = _c(denominator).cast("double")
    return _c(numerator) / F.when(d != 0, d)


def percentile(x: Column | str, q: float) -> Column:
    """Exact percentile with linear interpolation; q within 0 to 1."""
    return F.percentile(_c(x), q)


def median(x: Column | str) -> Column:
    return F.median(_c(x))


def variation(x: Column | str) -> Column:
    """Sample deviation by mean; null for fewer than two values or a mean of 0."""
    x = _c(x)
    return F.when(F.count(x) >= 2, rate(F.stddev_samp(x), F.avg(x)))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the score interval of a proportion; null without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)


def total_or_null(x: Column | str) -> Column:
    """Plain sum: null when no value was present."""
    return F.sum(_c(x))


def all_true(x: Column | str) -> Column:
    return F.bool_and(F.coalesce(_c(x), F.lit(False)))


def strict_greatest(a: Column, b: Column) -> Column:
    """The larger of two; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
