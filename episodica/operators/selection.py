"""Selection by cells and strata, splits, and seeded orders, on tables of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .sampling import allocate, shuffle_key

#: Hex digits of the seeded order that make a bucket: a cell is spread over 4096 of them.
BUCKET = 3


def rounded_quotas(count: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Halves round to even; what is then over or short goes one each to the largest, by name among equals."""
    out = {k: round(count * s) for k, s in shares.items()}
    short = count - sum(out.values())
    for k in sorted(out, key=lambda k: (-out[k], k))[: abs(short)]:
        out[k] += 1 if short > 0 else -1
    return out


def seeded_limit(rows: DataFrame, id_col: str, count: int, seed: int, first: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """``count`` rows in a seeded order, numbered from 0 as ``position``; those whose ``by`` is in ``first`` come
    before all others, in that order. Each task sends on at most ``count`` rows."""
    whens = [F.col(by) == x for x in first] if by else []
    place = F.coalesce(*(F.when(w, F.lit(i)) for i, w in enumerate(whens)), F.lit(len(whens)))
    keyed = rows.withColumn("_place", place).withColumn("_key", shuffle_key(F.col(id_col), seed))
    top = keyed.orderBy("_place", "_key", id_col).limit(count)
    return top.withColumn("position", F.row_number().over(Window.orderBy("_place", "_key", id_col)) - 1).drop("_place", "_key")


def ranked(rows: DataFrame, keys: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """``rank`` of each row in its cell's seeded order, from 1. No cell is one task's: rows are ranked in buckets
    of the order, and the buckets' counts are summed up."""
    r = rows.withColumn("_key", shuffle_key(F.col(id_col), seed)).withColumn("_bucket", F.substring("_key", 1, BUCKET))
    n = r.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_bucket") == F.col("_b"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_key", id_col))
    return r.withColumn("_inside", inside).join(n, same).withColumn("rank", F.col("_before") + F.col("_inside")).select(*rows.columns, "rank")


def shares_of(counts: DataFrame, keys: Sequence[str], n: str, total: Column, name: str) -> DataFrame:
    """Largest remainder of ``total`` over a table of cells; a cell's share is total times its part of all, in
    that order of the products, since floors depend on it."""
    every = Window.partitionBy(F.lit(0))
    c = counts.withColumn("_x", total * F.coalesce(F.col(n) / F.nullif(F.sum(n).over(every), F.lit(0)), F.lit(0.0)))
    c = c.withColumn("_f", F.floor("_x")).withColumn("_left", total - F.sum("_f").over(every))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_x") - F.col("_f")), *keys))
    return c.withColumn("_rank", rank).withColumn(name, (F.col("_f") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("long")).drop("_x", "_f", "_left", "_rank")


def split(rows: DataFrame, keys: Sequence[str], id_col: str, train: int, held: int, seed: int) -> DataFrame:
    """Adds ``split``: of each cell its share of ``train``, then of what remains its share of ``held`` (eval), the
    rest is reserve. The table of cells must fit in one task."""
    cells = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    cells = shares_of(cells, keys, "_n", F.lit(train), "_train").withColumn("_rest", F.col("_n") - F.col("_train"))
    cells = shares_of(cells, keys, "_rest", F.lit(held), "_held").select(*(F.col(k).alias(f"_{k}") for k in keys), "_train", "_held")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    r = ranked(rows, keys, id_col, seed).join(cells, same)
    part = F.when(F.col("rank") <= F.col("_train"), "train").when(F.col("rank") <= F.col("_train") + F.col("_held"), "eval").otherwise("reserve")
    return r.withColumn("split", part).select(*rows.columns, "split")


def cell_targets(total: int, sources: Mapping[str, float], buckets: Mapping[str, float], grades: Mapping[str, Mapping[str, float]]) -> dict[tuple[str, str, str], int]:
    """Rows wanted of each source, bucket and grade."""
    return allocate(total, {(s, b, g): x * y * z for s, x in sources.items() for b, y in buckets.items() for g, z in grades[s].items()})


def shortages(pool: DataFrame, keys: Sequence[str], targets: Mapping[tuple[str, ...], int]) -> DataFrame:
    """Cells with fewer rows than wanted: keys, needed, available."""
    names = list(keys)
    wanted = pool.sparkSession.createDataFrame([(*k, n) for k, n in sorted(targets.items())], ", ".join(f"{k} string" for k in names) + ", needed long")
    have = pool.groupBy(*names).agg(F.count("*").alias("available"))
    return wanted.join(have, names, "left").withColumn("available", F.coalesce("available", F.lit(0))).where("available < needed")


#: Grades in order of preference.
GRADES = ("A", "B", "C")


def candidate_order(source: Column, grade: Column, recall: Column, grounded: Column, truncations: Column, searches: Column, tokens: Column, candidate: Column) -> list[Column]:
    """The order in which candidates are preferred: by grade, then coverage (of the multi-hop source; of the other by being
    grounded), then fewer truncated observations, fewer searches, shorter prompts, and the id."""
    multi = source == "hotpotqa"
    rank = F.coalesce(*(F.when(grade == g, F.lit(i)) for i, g in enumerate(GRADES)), F.lit(len(GRADES)))
    by_grade = F.when(multi, rank).otherwise(F.when(F.coalesce(grounded, F.lit(False)), 0).otherwise(1))
    return [by_grade, F.when(multi, -F.coalesce(recall, F.lit(0.0))).otherwise(0.0), truncations, searches, tokens, candidate]


def ranked_models(summaries: DataFrame) -> DataFrame:
    """``rank`` of models (model, em, f1, mean_no_progress_searches, format_compliance_rate, search_limit_rate), one row each: the
    better answers first, then less useless searching, better form, fewer that ran out of searches, and the name."""
    order = [F.desc("em"), F.desc("f1"), "mean_no_progress_searches", F.desc("format_compliance_rate"), "search_limit_rate", "model"]
    return summaries.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fill_cells(pool: DataFrame, keys: Sequence[str], question: str, strata: Sequence[str], order: Sequence[str], targets: Mapping[tuple[str, ...], int]) -> DataFrame:
    """Fill the cells one after the other, in order of their keys. A question that an earlier cell took is out of
    later ones; within a cell the strata share its target by what they have, best ranks first.

    ``pool`` has one row for each question and cell. The loop is over cells, a small fixed table; what was taken is
    cut off by a checkpoint, so that plans do not grow. A shortage is an error.
    """
    taken: DataFrame | None = None
    for cell in sorted(k for k, n in targets.items() if n > 0):
        here = pool.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in zip(keys, cell, strict=True))))
        if taken is not None:
            here = here.join(taken.select(question), question, "left_anti")
        quota = shares_of(here.groupBy(*strata).agg(F.count("*").alias("_n")), strata, "_n", F.lit(targets[cell]), "_quota")
        best = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
        chosen = here.withColumn("_best", best).where(F.col("_best") <= targets[cell]).join(F.broadcast(quota.select(*strata, "_quota")), list(strata))
        chosen = cut(chosen.where("_best <= _quota").select(*pool.columns))
        if (n := chosen.count()) != targets[cell]:
            raise ValueError(f"cell {'/'.join(cell)}: {n} rows of {targets[cell]}")
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken if taken is not None else pool.limit(0)
