"""Gates of a pilot: what may never happen, and rates that must reach or stay below a limit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operational(counts: Mapping[str, Column]) -> Column:
    """True if none of the counts is above zero."""
    return F.forall(F.array(*counts.values()), lambda n: F.coalesce(n, F.lit(0)) == 0)


def quality(rates: DataFrame, at_least: Mapping[str, float], at_most: Mapping[str, float]) -> DataFrame:
    """Adds ``failures``, the sorted names of the rates beyond a limit, and ``passed``. A rate that is null
    fails; without any limit nothing passes. The limits themselves are within."""
    low = [F.when(F.col(k).isNull() | (F.col(k) < v), F.lit(k)) for k, v in at_least.items()]
    high = [F.when(F.col(k).isNull() | (F.col(k) > v), F.lit(k)) for k, v in at_most.items()]
    failures = F.array_sort(F.array_compact(F.array(*low, *high))) if low or high else F.array().cast("array<string>")
    return rates.withColumn("failures", failures).withColumn("passed", (F.size("failures") == 0) & F.lit(bool(low or high)))
