"""Interval estimates and quantiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a rate, within 0 and 1; (0, 0) for no rows."""
    p, z2 = successes / n, Z * Z
    middle, width = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (middle - width) / (1 + z2 / n)), F.least(F.lit(1.0), (middle + width) / (1 + z2 / n))
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def mean_interval(mean: Column, variance: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a mean by the sample variance, at least 0, with no upper bound; a point for one row."""
    half = Z * F.sqrt(F.coalesce(variance, F.lit(0.0)) / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mean - half)), F.when(n == 0, 0.0).otherwise(mean + half)


def nearest_rank(n: Column, fraction: float) -> Column:
    """The rank, from 1, of the nearest-rank quantile; halves round to even."""
    return (F.rint((n - 1) * F.lit(fraction)) + 1).cast("long")
