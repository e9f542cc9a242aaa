"""Results of replayed episodes in the three protocols, and their summaries by grouping sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, stats, text
from . import replay

Z = stats.Z


def scored(episodes: DataFrame, guard: bool, both_empty: float) -> DataFrame:
    """Adds exact_match (0 or 1, any gold answer) and f1 (the best over them, 0 without any)."""
    said = F.coalesce("prediction", F.lit(""))
    f1 = F.coalesce(F.array_max(F.transform("golden_answers", lambda g: text.token_f1(said, g, both_empty))), F.lit(0.0))
    return episodes.withColumn("exact_match", text.exact_match(said, F.col("golden_answers"), guard).cast("int")).withColumn("f1", f1)


def result_v0(episodes: DataFrame, golds: DataFrame) -> DataFrame:
    """Results of the first protocol. ``episodes``: from ``replay``; ``golds``: episode, golden_answers, data_source. Any
    recorded reason makes the tool call invalid."""
    r = scored(episodes.join(golds, "episode"), False, 1.0)
    invalid, present = F.size("recorded") > 0, F.coalesce("prediction", F.lit("")) != ""
    ended = F.col("termination").isin(*replay.SEARCH_FAILURES, "search_limit", "repeated_search")
    r = r.withColumns({
        "search_count": F.col("succeeded"),
        "search_attempt_count": F.col("searches") + F.col("termination").isin("repeated_search", "search_limit").cast("int"),
        "redundant": F.col("succeeded") - F.col("progressive"),
        "answer_present": present,
        "format_compliant": F.col("termination") != "format_error",
        "invalid_tool_call": invalid,
        "has_repeated_query": F.col("termination") == "repeated_search",
        "has_no_progress": (F.col("no_progress") > 0) | ended,
        "zero_search": F.col("succeeded") == 0,
    })
    valid = F.col("answer_present") & F.col("format_compliant") & ~invalid
    hit = F.col("exact_match") == 1
    return r.withColumns({"valid_trajectory": valid, "strict_success": hit & valid, "recovered_success": hit & F.col("answer_present") & F.col("has_no_progress")})


def result_v1(episodes: DataFrame, golds: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Results of the second protocol. ``first`` (episode, v0_exact_match, v0_f1, v0_search_count,
    v0_search_attempt_count): what the first gave, for the differences; null where there is none."""
    r = replay.recovery(scored(episodes.join(golds, "episode"), False, 1.0), F.col("exact_match") == 1)
    ended = F.col("termination").isin(*replay.SEARCH_FAILURES, "search_limit")
    r = r.withColumns({
        "search_count": F.col("succeeded"),
        "search_attempt_count": F.col("searches"),
        "redundant": F.col("succeeded") - F.col("progressive"),
        "answer_present": F.coalesce("prediction", F.lit("")) != "",
        "format_compliant": F.col("termination") != "format_error",
        "invalid_tool_call": F.col("terminal_invalid"),
        "has_repeated_query": F.col("repeated") > 0,
        "has_no_progress": (F.col("no_progress") > 0) | ended,
        "zero_search": F.col("succeeded") == 0,
        "valid_trajectory": F.col("valid"),
        "strict_trajectory": F.col("strict"),
        "strict_success": (F.col("exact_match") == 1) & F.col("strict"),
        "recovered_success": F.col("recovered"),
        "recoverable_violation": F.exists("recorded", lambda x: x.isin(*replay.RECOVERABLE)),
        "has_any_violation": F.size("recorded") > 0,
        "final_answer_opportunity": F.col("final_only"),
    }).drop("valid", "strict", "recovered")
    if first is None:
        return r
    r = r.join(first, "episode", "left")
    pairs = {"exact_match": "exact_match", "f1": "f1", "search_count": "search_count", "search_attempt_count": "search_attempt_count"}
    return r.withColumns({f"{c}_delta_vs_v0": F.when(F.col(f"v0_{c}").isNotNull(), F.col(c) - F.col(f"v0_{c}")) for c in pairs})


def result_v3(episodes: DataFrame, golds: DataFrame, documents: Column | None = None) -> DataFrame:
    """Results of the third protocol. ``golds``: episode, golden_answers, data_source, and where known supporting_titles,
    supporting_sentences and context. ``documents``: the visible documents, array of (title, text), as a column of
    the joined table; without it nothing was visible."""
    r = episodes.join(golds, "episode").withColumn("prediction", F.when(F.col("termination").startswith("answer"), F.col("prediction")))
    r = replay.reasons(scored(r, True, 0.0), F.col("exact_match") == 1)
    none = F.array().cast("array<struct<title:string,text:string>>")
    r = r.withColumn("documents", F.coalesce(documents if documents is not None else none, none))
    titles = F.col("supporting_titles") if "supporting_titles" in r.columns else F.array().cast("array<string>")
    r = r.withColumn("coverage", evidence.title_coverage(titles, F.transform("documents", lambda x: x["title"])))
    if {"supporting_sentences", "context"} <= set(golds.columns):
        seen = evidence.sentence_visibility(titles, F.col("supporting_sentences"), F.col("context"), F.col("documents"))["recall"]
    else:
        seen = F.lit(None).cast("double")
    r = r.withColumn("sentence_recall", seen)
    r = r.withColumn("grounded", F.coalesce(evidence.answer_grounded(F.col("prediction"), F.transform("documents", lambda x: x["text"])), F.lit(False)))
    multi = F.lower("data_source") == "hotpotqa"
    return r.withColumns({
        "answer_present": F.coalesce("prediction", F.lit("")) != "",
        "format_compliant": ~F.col("termination").isin("format_error", "generation_truncated"),
        "has_repeated_query": F.col("repeated") > 0,
        "has_no_progress": F.col("no_progress") > 0,
        "support_recall": F.col("coverage.recall"),
        "evidence_grade": text.evidence_grade(multi, F.col("coverage.recall"), F.col("sentence_recall"), F.col("grounded")),
        "invalid_reasons": F.array_distinct("recorded"),
    })


def mean(c: str | Column) -> Column:
    return F.avg(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double"))


def rate(c: str | Column) -> Column:
    return F.avg(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)).cast("double"))


def of_rows(where: Column, c: Column) -> Column:
    """A mean over the rows where it holds, else null."""
    return F.avg(F.when(where, c.cast("double")))


MEANS_FIRST = {"em": "exact_match", "f1": "f1", "mean_searches": "search_count", "mean_search_attempts": "search_attempt_count", "mean_progressive_searches": "progressive", "mean_redundant_searches": "redundant", "mean_retrieved_documents": "retrieved", "mean_unique_documents": "unique_docs", "mean_novelty_ratio": "novelty", "mean_rounds": "generations"}
RATES_FIRST = {"zero_search_rate": "zero_search", "answer_rate": "answer_present", "format_compliance_rate": "format_compliant", "valid_trajectory_rate": "valid_trajectory", "invalid_tool_call_rate": "invalid_tool_call", "repeated_query_rate": "has_repeated_query", "no_progress_call_rate": "has_no_progress", "strict_success_rate": "strict_success", "recovered_success_rate": "recovered_success"}


def measures_v0() -> dict[str, Column]:
    n = F.count(F.lit(1))
    low, high = stats.wilson(F.sum("exact_match"), n)
    out = {"examples": n} | {k: mean(c) for k, c in MEANS_FIRST.items()} | {k: rate(c) for k, c in RATES_FIRST.items()}
    out |= {"em_low": low, "em_high": high}
    for k, c in (("f1", "f1"), ("mean_searches", "search_count")):
        a, b = stats.mean_interval(F.avg(F.col(c).cast("double")), F.var_samp(F.col(c).cast("double")), n)
        out |= {f"{k}_low": a, f"{k}_high": b}
    return out


def measures_v1() -> dict[str, Column]:
    repeated, final, fine = F.col("has_repeated_query"), F.col("final_answer_opportunity"), ~F.col("terminal_invalid")
    hit, ended, paired = F.col("exact_match") == 1, F.col("termination") == "answer_after_search_budget", F.col("v0_exact_match").isNotNull()
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return measures_v0() | {
        "strict_trajectory_rate": rate("strict_trajectory"),
        "recoverable_violation_rate": rate("recoverable_violation"),
        "terminal_invalid_rate": rate("terminal_invalid"),
        "any_violation_rate": rate("has_any_violation"),
        "final_answer_opportunity_rate": rate("final_answer_opportunity"),
        "repeated_query_examples": F.count_if(repeated),
        "repeated_query_answer_recovery_rate": none(of_rows(repeated, F.col("answer_present") & fine)),
        "repeated_query_correct_recovery_rate": none(of_rows(repeated, hit & fine)),
        "repeated_query_recovered_correct": F.count_if(repeated & hit & fine),
        "final_answer_opportunity_examples": F.count_if(final),
        "final_answer_completion_rate": none(of_rows(final, ended)),
        "final_answer_correct_rate": none(of_rows(final, ended & hit)),
        "paired_v0_examples": F.count_if(paired),
        "em_delta_vs_v0": of_rows(paired, F.col("exact_match_delta_vs_v0")),
        "f1_delta_vs_v0": of_rows(paired, F.col("f1_delta_vs_v0")),
        "mean_search_count_delta_vs_v0": of_rows(paired, F.col("search_count_delta_vs_v0")),
        "mean_search_attempt_count_delta_vs_v0": of_rows(paired, F.col("search_attempt_count_delta_vs_v0")),
    }


def measures_v3() -> dict[str, Column]:
    hit, recall, end = F.col("exact_match") == 1, F.col("support_recall"), F.col("termination")
    out = {"examples": F.count(F.lit(1)), "em": mean("exact_match"), "f1": mean("f1")}
    for name, c in (("search_actions", "searches"), ("bm25_executions", "executed")):
        out |= {f"mean_{name}": mean(c), f"mean_{name}_correct": of_rows(hit, F.col(c)), f"mean_{name}_wrong": of_rows(~hit, F.col(c))}
    out |= {f"mean_{k}": mean(c) for k, c in (("unique_queries", "unique_queries"), ("unique_documents", "unique_docs"), ("progressive_searches", "progressive"), ("no_progress_searches", "no_progress"))}
    out |= {f"{k}_rate": rate(c) for k, c in (("answer", "answer_present"), ("format_compliance", "format_compliant"), ("repeated_query", "has_repeated_query"), ("no_progress", "has_no_progress"))}
    out |= {f"{k}_rate": rate(end == k) for k in ("search_limit", "context_overflow", "generation_truncated")}
    return out | {"support_recall": F.avg(recall), "full_support_rate": of_rows(recall.isNotNull(), recall == 1)}


def measures_running() -> dict[str, Column]:
    """Of a running rollout."""
    return {"count": F.count(F.lit(1)), "exact_match": mean("exact_match"), "f1": mean("f1"), "strict_sft_eligible_rate": rate("eligible"), "mean_search_actions": mean("searches"), "mean_bm25_executions": mean("executed")}


def summary(results: DataFrame, measures: Mapping[str, Column], groups: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """grouping, key, metric, value: the measures overall (``all``) and by each of ``groups``, in one pass of grouping
    sets, and counts of each label (``labels``: metric to column; an array counts each of its values; null is
    ``None``) as ``metric:label``. Nothing but partial aggregates is shuffled."""
    sets = [[], *([g] for g in groups)]

    def keyed(g: DataFrame) -> DataFrame:
        which = F.coalesce(*(F.when(F.col(f"at_{c}") == 0, F.lit(c)) for c in groups), F.lit("all"))
        key = F.coalesce(*(F.when(F.col(f"at_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in groups), F.lit("all"))
        return g.withColumn("grouping", which).withColumn("key", key)

    marks = [F.grouping(c).alias(f"at_{c}") for c in groups]
    g = keyed(results.groupingSets(sets, *groups).agg(*(c.cast("double").alias(k) for k, c in measures.items()), *marks))
    out = g.unpivot(["grouping", "key"], list(measures), "metric", "value")
    for metric, c in (labels or {}).items():
        one = F.explode(c) if results.schema[c].dataType.typeName() == "array" else F.coalesce(F.col(c).cast("string"), F.lit("None"))
        rows = results.select(*groups, one.alias("label"))
        h = keyed(rows.groupingSets([[*s, "label"] for s in sets], *groups, "label").agg(F.count("*").cast("double").alias("value"), *marks))
        out = out.union(h.select("grouping", "key", F.concat(F.lit(f"{metric}:"), "label"), "value"))
    return out
