"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves of a tree: domain, language, source. A token budget is handed down from the root:
at each node the children share it by weight, and what a child cannot use goes to its siblings by their
weights. As a child's supply is that of its whole subtree, a shortage stays among siblings while they can
take it, and only then reaches their parent's siblings. The shares have a closed form (children in order of
supply over weight, prefix sums), so each level is one window over a table with a row for each leaf.

A leaf's documents are in an order seeded anew for each epoch; the leaf takes whole epochs, then the
prefix of one more, by tokens. Places in the order are found by sums over buckets of it, so that a leaf of
any size is spread over many tasks; only ids and counts are shuffled. A token is a word here, as words are the
unit of the budgets: they need no vocabulary.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

LEVELS = ("domain", "lang", "source")
SEED = 20_240
#: Hex digits of the order that make a bucket.
BUCKET_DIGITS = 2
WORD = r"[^\x20\x09-\x0D]+"


def weight_of(level: int, weights: Mapping[str, float]) -> Column:
    """A node's weight by its path (``web/en``), else by its name, else 1."""
    path = F.concat_ws("/", *LEVELS[: level + 1])
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*(F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))))
    return F.coalesce(F.try_element_at(known, path), F.try_element_at(known, F.col(LEVELS[level])), F.lit(1.0))


def shared_out(nodes: DataFrame, parent: list[str], budget: Column, supply: str, weight: Column, name: str) -> DataFrame:
    """Share ``budget``, the same for all children of a parent, among them by weight up to their supply."""
    kids = Window.partitionBy(*parent, "root").orderBy("ratio", *LEVELS)
    before = kids.rowsBetween(Window.unboundedPreceding, -1)
    after = kids.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("w", weight).withColumn("ratio", F.when(F.col("w") > 0, F.col(supply) / F.col("w")).otherwise(F.lit(float("inf"))))
    n = n.withColumn("level", (budget - F.coalesce(F.sum(supply).over(before), F.lit(0))) / F.nullif(F.sum("w").over(after), F.lit(0.0)))
    n = n.withColumn("level", F.coalesce(F.max("level").over(Window.partitionBy(*parent, "root")), F.lit(0.0)))
    return n.withColumn(name, F.least(F.col(supply).cast("double"), F.col("w") * F.col("level"))).drop("w", "ratio", "level")


def leaf_budgets(leaves: DataFrame, budget_share: float, weights: Mapping[str, float], max_epochs: int, budget_tokens: int | None = None) -> DataFrame:
    """Token budgets of all leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("root", F.lit(0)).withColumn("supply", F.col("tokens") * max_epochs)
    everything = Window.partitionBy("root")
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.floor(F.sum("tokens").over(everything) * budget_share).cast("double")
    leaves = leaves.withColumn("budget", budget)
    for level in range(len(LEVELS)):
        parent, path = list(LEVELS[:level]), list(LEVELS[: level + 1])
        nodes = leaves.groupBy("root", *path).agg(F.sum("supply").alias("node_supply"), F.first("budget").alias("node_budget"))
        for rest in LEVELS[level + 1 :]:
            nodes = nodes.withColumn(rest, F.lit(""))
        nodes = shared_out(nodes, parent, F.col("node_budget"), "node_supply", weight_of(level, weights), "share").select(*path, "share")
        leaves = leaves.join(nodes, path).drop("budget").withColumnRenamed("share", "budget")
    # A hair is added so that whole shares do not fall short by the last bit.
    return leaves.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def with_leaf(docs: DataFrame, domain: Column) -> DataFrame:
    null = F.lit("")
    return docs.select("*", domain.alias("domain"), F.coalesce("lang", null).alias("leaf_lang"), F.coalesce("source", null).alias("leaf_source"))


def default_domain() -> Column:
    """Without a domain column: one of four by the source's name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def order_of(epoch: Column, seed: int) -> Column:
    """The seeded order of an epoch, by doc_id; rows without one are told apart by their number."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("row").cast("string")))
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, name).cast("binary"))


def places(d: DataFrame, order: Column) -> DataFrame:
    """Adds ``start``: the tokens of the rows before, in the leaf's order. Rows are summed up in buckets of the order,
    and the buckets' sums in theirs, so that no leaf is one task's."""
    d = d.withColumn("sort", order).withColumn("bucket", F.substring("sort", 1, BUCKET_DIGITS))
    by_bucket = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = d.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    buckets = buckets.select(*LEVELS, "bucket", F.coalesce(F.sum("bucket_tokens").over(by_bucket), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("sort", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(buckets, [*LEVELS, "bucket"])
    return d.withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).drop("sort", "bucket", "before")


def select_mix(docs: DataFrame, budget_share: float = 0.6, weights: Mapping[str, float] | None = None, max_epochs: int = 2, seed: int = SEED, budget_tokens: int | None = None, domain: Column | None = None, row: str | None = None) -> DataFrame:
    """The documents of the mix: doc_id, row, domain, lang, source, n_tokens, epoch (from 0), position,
    take_tokens, leaf_budget.

    A leaf reads its documents epoch after epoch, each in an order of its own by the seed, the epoch and the doc_id,
    until its budget is spent. ``position``: the tokens of the leaf before the document, over all its epochs.
    ``take_tokens`` are its tokens that count: all but for the document in which the budget ends, so that they add
    up to it. ``row``: what names a row (a column of ``docs``, unique, else a number is given); the order of rows
    that share a doc_id goes by it.

    Null languages and sources are the empty one. Null and empty texts have no tokens; they come with any epoch
    that reaches them. Very long texts are counted whole, and cut only by the budget. Repeated rows count each. A
    null doc_id is kept; such rows are ordered by their number. An empty table gives no rows. Weights of 0 give
    nothing. Other columns, also of clashing names, are not read.
    """
    weights = weights or {}
    names = ("doc_id", "text", "lang", "source")
    d = pick(docs, *names, row).withColumnRenamed(row, "row") if row else pick(docs, *names).withColumn("row", F.monotonically_increasing_id())
    d = with_leaf(d, domain if domain is not None else default_domain())
    d = d.select("doc_id", "row", "domain", F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    d = written(d, "mix-counts")  # texts are read once; what follows needs ids and counts alone
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, budget_share, weights, max_epochs, budget_tokens)
    # Leaves: as many as there are domains, languages and sources together.
    budgets = budgets.withColumn("whole", F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(F.lit(0)).cast("int"))
    budgets = written(budgets.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*LEVELS, "whole", "rest", F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget")), "mix-budgets")
    d = d.join(budgets, list(LEVELS))
    parts = []
    for epoch in range(max_epochs):  # in the order of this epoch, if the leaf comes so far
        here = places(d.where(F.col("whole") + (F.col("rest") > 0).cast("int") > epoch), order_of(F.lit(epoch), seed))
        left = F.when(F.col("whole") > epoch, F.col("leaf_tokens")).otherwise(F.col("rest"))
        here = here.where((F.col("whole") > epoch) | (F.col("start") < left))
        parts.append(here.select("doc_id", "row", *LEVELS, "n_tokens", F.lit(epoch).alias("epoch"), (F.col("leaf_tokens") * epoch + F.col("start")).alias("position"), F.least(F.col("n_tokens"), left - F.col("start")).alias("take_tokens"), "leaf_budget"))
    return reduce(DataFrame.union, parts)
