"""The audit of a pilot: its funnel, distributions and prompt lengths as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import quantiles

LENGTHS = (0.5, 0.9, 0.95, 0.99, 1.0)


def funnel(candidates: DataFrame) -> DataFrame:
    """One row of counts, rates and means over all candidates. Flags that are null count as false, counts that
    are null as 0; without candidates the rates are null."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)))
    stalled = (F.coalesce("repeated", F.lit(0)) > 0) | (F.coalesce("no_progress", F.lit(0)) > 0)
    return candidates.agg(
        F.count("*").alias("candidate_count"),
        F.count_distinct(F.coalesce("question", F.lit(""))).alias("unique_question_count"),
        F.count_if("eligible").alias("strict_eligible_count"),
        rate(F.col("eligible")).alias("strict_eligible_rate"),
        rate(F.col("correct")).alias("exact_match"),
        rate(F.col("format_compliant")).alias("format_compliance_rate"),
        rate(F.col("termination") == "generation_truncated").alias("generation_truncated_rate"),
        rate(F.col("termination") == "search_limit").alias("search_limit_rate"),
        mean("searches").alias("mean_search_actions"),
        mean("executed").alias("mean_executions"),
        mean("unique_docs").alias("mean_unique_documents"),
        rate(F.col("searches") >= 2).alias("multi_search_fraction"),
        F.count_if(F.col("correct") & stalled).alias("correct_after_repeat_or_no_progress"),
    )


def distributions(candidates: DataFrame, multi_hop: str, single_hop: str) -> DataFrame:
    """section, key, n: candidates by source, termination, searches, reason (each of a candidate's own), evidence
    grade (of the multi-hop source) and grounding (of the single-hop one). One pass, combined before its shuffle."""

    def label(section: str, key: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.coalesce(key.cast("string"), F.lit("None")).alias("key"))

    source = F.col("source")
    grounded = F.when(F.col("grounded"), "grounded").otherwise("ungrounded")
    own = F.array(
        label("source", source),
        label("termination", F.col("termination")),
        label("searches", F.coalesce("searches", F.lit(0))),
        F.when(source == multi_hop, label("evidence", F.col("evidence"))),
        F.when(source == single_hop, label("grounding", grounded)),
    )
    why = F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: label("reason", r))
    return candidates.select(F.explode(F.array_compact(F.concat(own, why))).alias("x")).groupBy("x.section", "x.key").agg(F.count("*").alias("n"))


def audit(candidates: DataFrame, multi_hop: str, single_hop: str) -> DataFrame:
    """section, key, value: the funnel ("all"), the distributions, and mean and nearest-rank quantiles of the
    candidates' longest prompts ("prompt_tokens", a candidate without prompt counts as 0).

    ``candidates``: question, source, eligible, correct, format_compliant, termination, reasons, searches,
    executed, repeated, no_progress, unique_docs, evidence, grounded, prompt_tokens. The table is read three
    times; what is shuffled is one row for each task, question or distinct value.
    """
    f = funnel(candidates)
    cells = F.array(*(F.struct(F.lit("all").alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in f.columns))
    lengths = candidates.select(F.lit(0).alias("every"), F.coalesce("prompt_tokens", F.lit(0)).alias("tokens"))
    q = quantiles(lengths, ["every"], "tokens", LENGTHS)
    points = F.array(*(F.struct(F.lit("prompt_tokens").alias("section"), F.lit(f"q{round(100 * x)}").alias("key"), F.col(f"q{round(100 * x)}").cast("double").alias("value")) for x in LENGTHS))
    mean = lengths.agg(F.avg("tokens").alias("value")).select(F.lit("prompt_tokens").alias("section"), F.lit("mean").alias("key"), "value")
    counted = distributions(candidates, multi_hop, single_hop).select("section", "key", F.col("n").cast("double").alias("value"))
    return f.select(F.inline(cells)).union(counted).union(q.select(F.inline(points))).union(mean)
