"""Deterministic sampling: allocation by largest remainder, strata, quantiles, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank


def allocate(total: int, weights: Mapping[str, float]) -> dict[str, int]:
    """Largest remainder on the driver; ties go to the smaller key. The products are floats on purpose: their
    floors are part of the result."""
    exact = {k: total * w for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def quotas(counts: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Largest remainder over a table of counts, one row for each stratum: adds ``quota``."""
    every = Window.partitionBy(F.lit(0))
    share = F.lit(total) * F.col("n") / F.sum("n").over(every)
    c = counts.withColumn("floor", F.floor(share)).withColumn("rest", share - F.floor(share))
    left = F.lit(total) - F.sum("floor").over(every)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), *keys))
    return c.withColumn("left", left).withColumn("rank", rank).select(*keys, "n", (F.col("floor") + (F.col("rank") <= F.col("left")).cast("int")).cast("long").alias("quota"))


def shuffle_key(key: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"), 256)


def stratified(rows: DataFrame, keys: Sequence[str], id_col: str, total: int, seed: int) -> DataFrame:
    """``total`` rows, each stratum by its quota, the first in a seeded order. Only the first so many of each
    stratum leave their tasks."""
    q = quotas(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, total)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(shuffle_key(F.col(id_col), seed), id_col))
    return rows.withColumn("rank", rank).where(F.col("rank") <= total).join(q.select(*keys, "quota"), list(keys)).where("rank <= quota").drop("quota")


def value_range(value: Column) -> Column:
    """A range that a number falls in, in the numbers' order: 256 to each power of two."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * 256)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Nearest-rank quantiles of each group, from counts of the distinct values. The counts are summed up over ranges
    of values; values are ranked only inside the ranges that hold a quantile, so no group is one task's."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_range", value_range(F.col(value)))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    r = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    r = r.withColumn("_end", F.sum("_in").over(upto)).withColumn("_all", F.sum("_in").over(Window.partitionBy(*by)))
    holds = [(nearest_rank(F.col("_all"), f) <= F.col("_end")) & (nearest_rank(F.col("_all"), f) > F.col("_end") - F.col("_in")) for f in fractions]
    r = r.where(reduce(lambda a, b: a | b, holds)).select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), (F.col("_end") - F.col("_in")).alias("_before"), "_all")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_range") == F.col("_at"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.join(r, same).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    pick = lambda f: F.min(F.when(F.col("_upto") >= nearest_rank(F.col("_all"), f), F.col(value)))
    return c.groupBy(*by).agg(F.first("_all").alias("n"), *(pick(f).alias(f"q{round(100 * f)}") for f in fractions))


def best_of_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group by a lexicographic rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rank = 1").drop("rank")
