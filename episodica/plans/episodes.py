"""Queries of results and their summaries in the three protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import replay, results, sampling, selection
from .queries import query, table

#: Endings of searches that stand in the events by their key.
_EMPTY, _NOTHING, _BROKEN = "k % 41 = 40", "k % 37 = 36", "k % 43 = 42"


def turns(spark, d, truncation: bool) -> DataFrame:
    """Turns of users' four-day episodes: early errors and purchases end them, all other events search; some searches
    have no words, some bring nothing, some fail; some errors hold an answer. ``truncation``: some errors are
    generations that were cut off."""
    e = table(spark, d, "events").where("event_type <> 'signup'")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("episode", F.concat_ws("-", "user_id", F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 345_600)))
    e = e.withColumn("kind", F.expr("CASE WHEN k < 12 AND event_type = 'error' THEN 'error' WHEN k < 12 AND event_type = 'purchase' THEN 'answer' ELSE 'search' END"))
    cut_off = "WHEN kind = 'error' AND k % 4 = 3 THEN 'generation_truncated'" if truncation else ""
    return e.select(
        "episode", "kind",
        F.row_number().over(Window.partitionBy("episode").orderBy("ts", "event_id")).alias("turn"),
        F.expr(f"CASE WHEN kind = 'search' AND NOT {_EMPTY} THEN k % 9 END").alias("query_key"),
        F.array(F.col("k") % 10, 100 + F.col("k") % 7, 200 + F.col("k") % 5).alias("doc_keys"),
        F.expr(f"CASE {cut_off} WHEN kind = 'search' AND {_NOTHING} THEN 'empty_search_result' WHEN kind = 'search' AND {_BROKEN} THEN 'retrieval_error' END").alias("failure"),
        F.when(F.col("kind") == "search", "Timeout").alias("detail"),
        F.expr("CASE WHEN kind = 'answer' THEN concat('The ANSWER ', k % 3, CASE WHEN k % 2 = 0 THEN ' so' ELSE '' END) WHEN kind = 'error' AND k % 2 = 0 THEN concat('an answer ', k % 3) END").alias("content"),
    )


def golds(t: DataFrame) -> DataFrame:
    """Gold answers and sources of the episodes, by their user; supporting titles of the multi-hop ones."""
    u = F.split_part("episode", F.lit("-"), F.lit(1)).cast("long")
    none = F.array().cast("array<string>")
    titles = F.when(u % 3 == 0, F.array(F.concat(F.lit("Doc "), u % 10), F.concat(F.lit("doc  "), 100 + u % 7), F.lit(" "))).otherwise(none)
    return t.select("episode").distinct().select(
        "episode",
        F.array(F.concat(F.lit("answer "), u % 3), F.concat(F.lit("Answer: "), (u + 1) % 3, F.lit(" so"))).alias("golden_answers"),
        F.when(u % 3 == 0, "hotpotqa").otherwise("nq").alias("data_source"),
        titles.alias("supporting_titles"),
    )


def documents() -> Column:
    """The visible documents: of odd keys, the text holds an answer."""
    return F.transform("visible", lambda k: F.struct(F.concat(F.lit("DOC "), k).alias("title"), F.concat(F.lit("It says: the answer "), k % 4, F.lit(".")).alias("text")))


def facts_sql(protocol: int) -> str:
    """CTEs up to ``r``: facts, answers and scores of each episode, written from the protocols' descriptions."""
    budget, rounds, unfinished = {0: (8, 8, "max_rounds"), 1: (8, 9, "generation_budget"), 3: (4, 5, "generation_budget")}[protocol]
    empty = "empty_search" if protocol == 3 else "invalid_search"
    cut_off = "WHEN kind = 'error' AND k % 4 = 3 THEN 'generation_truncated'" if protocol == 3 else ""
    repeat = "WHEN kind = 'search' AND seen > 1 THEN 'repeated_search'" if protocol == 0 else ""
    guard = "pred <> '' AND" if protocol == 3 else ""
    said = "CASE WHEN starts_with(termination, 'answer') THEN said END" if protocol == 3 else "said"
    both_empty = 0 if protocol == 3 else 1
    norm = lambda c: f"list_filter(string_split(lower(replace({c}, ':', '')), ' '), lambda x: x NOT IN ('a', 'an', 'the', ''))"
    f1 = lambda g: f"CASE WHEN len(p) = 0 OR len({g}) = 0 THEN CASE WHEN len(p) = len({g}) THEN {both_empty}.0 ELSE 0.0 END ELSE 2.0 * len(list_intersect(p, {g})) / (len(p) + len({g})) END"
    return f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type <> 'signup'),
a AS (SELECT user_id AS u, user_id || '-' || CAST(floor(epoch(ts) / 345600) AS BIGINT) AS episode, ts, event_id, k, CASE WHEN k < 12 AND event_type = 'error' THEN 'error' WHEN k < 12 AND event_type = 'purchase' THEN 'answer' ELSE 'search' END AS kind FROM e),
b AS (SELECT *, CASE WHEN kind = 'search' AND k % 41 <> 40 THEN k % 9 END AS qk, [k % 10, 100 + k % 7, 200 + k % 5] AS docs, CASE {cut_off} WHEN kind = 'search' AND k % 37 = 36 THEN 'empty_search_result' WHEN kind = 'search' AND k % 43 = 42 THEN 'retrieval_error' END AS failure,
CASE WHEN kind = 'answer' THEN 'the answer ' || k % 3 || CASE WHEN k % 2 = 0 THEN ' so' ELSE '' END WHEN kind = 'error' AND k % 2 = 0 THEN 'an answer ' || k % 3 END AS content, row_number() OVER (PARTITION BY episode ORDER BY ts, event_id) AS turn FROM a QUALIFY turn <= {rounds}),
c AS (SELECT *, count(*) FILTER (kind = 'search') OVER (PARTITION BY episode ORDER BY turn) AS ns, row_number() OVER (PARTITION BY episode, kind, qk ORDER BY turn) AS seen, first_value(docs) OVER (PARTITION BY episode, kind, qk ORDER BY turn) AS held FROM b),
l AS (SELECT *, CASE WHEN kind = 'error' THEN coalesce(failure, 'format_error') WHEN kind = 'answer' THEN CASE WHEN ns >= {budget} THEN 'answer_after_search_budget' ELSE 'answer' END WHEN qk IS NULL AND ns <= {budget} THEN '{empty}' {repeat} WHEN ns > {budget} THEN 'search_limit' WHEN seen = 1 THEN failure END AS label FROM c),
m AS (SELECT *, min(turn) FILTER (label IS NOT NULL) OVER (PARTITION BY episode) AS cut FROM l),
t AS (SELECT *, kind = 'search' AND (cut IS NULL OR turn < cut) AS live, turn = cut AS last FROM m WHERE cut IS NULL OR turn <= cut),
n AS (SELECT episode, turn, count(*) AS fresh FROM (SELECT episode, doc, min(turn) AS turn FROM (SELECT episode, turn, unnest(docs) AS doc FROM t WHERE live AND seen = 1) GROUP BY ALL) GROUP BY ALL),
j AS (SELECT t.*, coalesce(fresh, 0) AS fresh FROM t LEFT JOIN n USING (episode, turn)),
f AS (SELECT episode, any_value(u) AS u, count(*) FILTER (live) AS lived, count(*) FILTER (live AND seen = 1) AS succeeded, count(*) FILTER (live AND seen > 1) AS repeated, count(*) FILTER (live AND seen = 1 AND fresh > 0) AS progressive, count(*) FILTER (live AND fresh = 0) AS stalled, CAST(sum(fresh) AS BIGINT) AS unique_docs,
coalesce(max(label) FILTER (last), '{unfinished}') AS termination, count(*) FILTER (last AND kind = 'search' AND label <> 'repeated_search' AND label <> 'search_limit') AS failed, count(*) FILTER (last AND label = 'empty_search_result') AS returned, count(*) FILTER (seen = 1 AND qk IS NOT NULL AND (live OR last AND label IN ('empty_search_result', 'retrieval_error'))) AS unique_queries,
3 * count(*) FILTER (live AND seen = 1) AS retrieved, 3 * count(*) FILTER (live) AS shown, coalesce(avg(fresh / 3.0) FILTER (live AND seen = 1), 0) AS novelty, count(*) AS generations, max(content) FILTER (last AND kind <> 'search') AS said,
coalesce(flatten(list(docs ORDER BY turn) FILTER (live AND seen = 1)), []) AS visible FROM j GROUP BY episode),
h AS (SELECT * EXCLUDE (said), coalesce({said}, '') AS pred, {norm(f"coalesce({said}, '')")} AS p, ['answer', CAST(u % 3 AS VARCHAR)] AS g1, ['answer', CAST((u + 1) % 3 AS VARCHAR), 'so'] AS g2, CASE WHEN u % 3 = 0 THEN 'hotpotqa' ELSE 'nq' END AS data_source, CASE LEAST(lived + failed, 3) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_plus' END AS bucket FROM f),
r AS (SELECT *, CAST({guard} (p = g1 OR p = g2) AS INT) AS exact_match, greatest({f1("g1")}, {f1("g2")}) AS f1, pred <> '' AS answer_present, succeeded = 0 AS zero_search, succeeded - progressive AS redundant, termination <> 'format_error' AS format_compliant FROM h)"""


_R0 = facts_sql(0) + """, r0 AS (SELECT *, succeeded AS search_count, lived + failed + CAST(termination IN ('repeated_search', 'search_limit') AS INT) AS search_attempt_count, NOT starts_with(termination, 'answer') OR stalled > 0 AS invalid_tool_call, termination = 'repeated_search' AS has_repeated_query, stalled > 0 OR failed > 0 OR termination IN ('repeated_search', 'search_limit') AS has_no_progress FROM r),
s0 AS (SELECT *, answer_present AND format_compliant AND NOT invalid_tool_call AS valid_trajectory, exact_match = 1 AND answer_present AND format_compliant AND NOT invalid_tool_call AS strict_success, exact_match = 1 AND answer_present AND has_no_progress AS recovered_success FROM r0)"""
_R1 = facts_sql(1) + """, r1 AS (SELECT *, succeeded AS search_count, lived + failed AS search_attempt_count, NOT starts_with(termination, 'answer') AS terminal_invalid, stalled > 0 AS recoverable_violation, repeated > 0 AS has_repeated_query, stalled > 0 OR failed > 0 OR termination = 'search_limit' AS has_no_progress, lived >= 8 AS final_answer_opportunity FROM r),
s1 AS (SELECT *, terminal_invalid AS invalid_tool_call, terminal_invalid OR recoverable_violation AS has_any_violation, answer_present AND format_compliant AND NOT terminal_invalid AS valid_trajectory, answer_present AND format_compliant AND NOT terminal_invalid AND NOT recoverable_violation AS strict_trajectory, exact_match = 1 AND answer_present AND format_compliant AND NOT terminal_invalid AND NOT recoverable_violation AS strict_success, exact_match = 1 AND answer_present AND recoverable_violation AND NOT terminal_invalid AS recovered_success FROM r1)"""
_R3 = facts_sql(3) + """, q3 AS (SELECT * EXCLUDE (format_compliant), lived + failed AS searches, succeeded + returned AS executed, stalled AS no_progress, termination NOT IN ('format_error', 'generation_truncated') AS format_compliant, repeated > 0 AS has_repeated_query, stalled > 0 AS has_no_progress,
CASE WHEN u % 3 = 0 THEN CAST(list_contains(visible, u % 10) AS INT) + CAST(list_contains(visible, 100 + u % 7) AS INT) END AS hits, len(p) > 0 AND len(list_filter(visible, lambda x: array_to_string(p, ' ') IN ('answer ' || x % 4, 'answer', CAST(x % 4 AS VARCHAR)))) > 0 AS grounded FROM r),
r3 AS (SELECT *, hits / 2.0 AS support_recall, CASE WHEN data_source = 'hotpotqa' THEN CASE hits WHEN 2 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END WHEN grounded THEN 'grounded' ELSE 'ungrounded' END AS evidence_grade,
list_sort(list_distinct(list_filter([CASE WHEN pred = '' THEN 'missing_answer' WHEN exact_match = 0 THEN 'wrong_answer' END, CASE WHEN NOT format_compliant THEN 'format_error' END, CASE WHEN searches < 1 THEN 'closed_book_answer' END, CASE WHEN repeated > 0 THEN 'repeated_search_query' END, CASE WHEN stalled > 0 THEN 'no_progress_search' END, CASE WHEN termination = 'generation_truncated' THEN termination END, CASE WHEN NOT starts_with(termination, 'answer') THEN 'terminal:' || termination END], lambda x: x IS NOT NULL))) AS reasons FROM q3)"""

_V0 = ("episode", "search_count", "search_attempt_count", "progressive", "redundant", "retrieved", "unique_docs", "generations", "zero_search", "answer_present", "format_compliant", "valid_trajectory", "strict_success", "recovered_success", "invalid_tool_call", "has_repeated_query", "has_no_progress", "termination", "exact_match")
_V1 = (*_V0, "strict_trajectory", "terminal_invalid", "recoverable_violation", "has_any_violation", "final_answer_opportunity")
_V3 = ("episode", "data_source", "searches", "executed", "unique_queries", "unique_docs", "shown", "progressive", "no_progress", "repeated", "generations", "termination", "answer_present", "format_compliant", "has_repeated_query", "has_no_progress", "exact_match", "grounded", "evidence_grade")
_FLOATS = ("f1", "novelty")


def _columns(names, *more) -> str:
    return " SELECT " + ", ".join([*names, *(f"round({c}, 9) AS {c}" for c in _FLOATS), *more])


def _v0(spark, d):
    t = turns(spark, d, False)
    return results.result_v0(replay.replay(t, **replay.V0), golds(t))


def _v1(spark, d):
    t = turns(spark, d, False)
    first = results.result_v0(replay.replay(t, **replay.V0), golds(t)).where(F.col("termination").isin("repeated_search", "max_rounds"))
    first = first.select("episode", *(F.col(c).alias(f"v0_{c}") for c in ("exact_match", "f1", "search_count", "search_attempt_count")))
    return results.result_v1(replay.replay(t, **replay.V1), golds(t), first)


def _v3(spark, d):
    t = turns(spark, d, True)
    return results.result_v3(replay.replay(t, **replay.V3), golds(t), documents())


_PAIRED = """, z1 AS (SELECT s1.*, exact_match - v0_exact_match AS exact_match_delta_vs_v0, f1 - v0_f1 AS f1_delta_vs_v0, search_count - v0_search_count AS search_count_delta_vs_v0, search_attempt_count - v0_search_attempt_count AS search_attempt_count_delta_vs_v0, v0_exact_match FROM s1 LEFT JOIN (SELECT episode, exact_match AS v0_exact_match, f1 AS v0_f1, search_count AS v0_search_count, search_attempt_count AS v0_search_attempt_count FROM ("""
_FIRST = _R0 + " SELECT * FROM s0 WHERE termination IN ('repeated_search', 'max_rounds')"
_Z1 = _R1 + _PAIRED + _FIRST + ")) USING (episode))"
_DELTAS = ("exact_match_delta_vs_v0", "search_count_delta_vs_v0", "search_attempt_count_delta_vs_v0")


@query(_R0 + _columns(_V0) + " FROM s0")
def result_rows_v0(spark, d):
    return _v0(spark, d).select(*_V0, *(F.round(c, 9).alias(c) for c in _FLOATS))


@query(_Z1 + _columns(_V1, *_DELTAS, "round(f1_delta_vs_v0, 9) AS f1_delta_vs_v0") + " FROM z1")
def result_rows_v1(spark, d):
    return _v1(spark, d).select(*_V1, *_DELTAS, *(F.round(c, 9).alias(c) for c in (*_FLOATS, "f1_delta_vs_v0")))


@query(_R3 + _columns(_V3, "round(support_recall, 9) AS support_recall", "array_to_string(reasons, ',') AS reasons", "len(reasons) = 0 AS eligible") + " FROM r3")
def result_rows_v3(spark, d):
    return _v3(spark, d).select(*_V3, *(F.round(c, 9).alias(c) for c in (*_FLOATS, "support_recall")), F.array_join("reasons", ",").alias("reasons"), "eligible")


_B = lambda c: f"avg(CAST({c} AS INT))"
_SQL0 = {"examples": "count(*)", "em": "avg(exact_match)", "f1": "avg(f1)", "mean_searches": "avg(search_count)", "mean_search_attempts": "avg(search_attempt_count)", "mean_progressive_searches": "avg(progressive)", "mean_redundant_searches": "avg(redundant)", "mean_retrieved_documents": "avg(retrieved)", "mean_unique_documents": "avg(unique_docs)", "mean_novelty_ratio": "avg(novelty)", "mean_rounds": "avg(generations)"}
_SQL0 |= {k: _B(c) for k, c in results.RATES_FIRST.items()}
_P, _N = "avg(exact_match)", "count(*)"
_WILSON = f"sqrt({_P} * (1 - {_P}) / {_N} + 3.8416 / (4.0 * {_N} * {_N}))"
_SQL0 |= {"em_low": f"greatest(0, ({_P} + 3.8416 / (2 * {_N}) - 1.96 * {_WILSON}) / (1 + 3.8416 / {_N}))", "em_high": f"least(1, ({_P} + 3.8416 / (2 * {_N}) + 1.96 * {_WILSON}) / (1 + 3.8416 / {_N}))"}
for _k, _c in (("f1", "f1"), ("mean_searches", "search_count")):
    _SQL0 |= {f"{_k}_low": f"greatest(0, avg({_c}) - 1.96 * sqrt(coalesce(var_samp({_c}), 0) / count(*)))", f"{_k}_high": f"avg({_c}) + 1.96 * sqrt(coalesce(var_samp({_c}), 0) / count(*))"}
_SQL1 = _SQL0 | {k: _B(c) for k, c in (("strict_trajectory_rate", "strict_trajectory"), ("recoverable_violation_rate", "recoverable_violation"), ("terminal_invalid_rate", "terminal_invalid"), ("any_violation_rate", "has_any_violation"), ("final_answer_opportunity_rate", "final_answer_opportunity"))}
_SQL1 |= {
    "repeated_query_examples": "count(*) FILTER (has_repeated_query)",
    "repeated_query_answer_recovery_rate": "coalesce(avg(CAST(answer_present AND NOT terminal_invalid AS INT)) FILTER (has_repeated_query), 0)",
    "repeated_query_correct_recovery_rate": "coalesce(avg(CAST(exact_match = 1 AND NOT terminal_invalid AS INT)) FILTER (has_repeated_query), 0)",
    "repeated_query_recovered_correct": "count(*) FILTER (has_repeated_query AND exact_match = 1 AND NOT terminal_invalid)",
    "final_answer_opportunity_examples": "count(*) FILTER (final_answer_opportunity)",
    "final_answer_completion_rate": "coalesce(avg(CAST(termination = 'answer_after_search_budget' AS INT)) FILTER (final_answer_opportunity), 0)",
    "final_answer_correct_rate": "coalesce(avg(CAST(termination = 'answer_after_search_budget' AND exact_match = 1 AS INT)) FILTER (final_answer_opportunity), 0)",
    "paired_v0_examples": "count(v0_exact_match)",
    "em_delta_vs_v0": "avg(exact_match_delta_vs_v0)",
    "f1_delta_vs_v0": "avg(f1_delta_vs_v0)",
    "mean_search_count_delta_vs_v0": "avg(search_count_delta_vs_v0)",
    "mean_search_attempt_count_delta_vs_v0": "avg(search_attempt_count_delta_vs_v0)",
}
_SQL3 = {"examples": "count(*)", "em": "avg(exact_match)", "f1": "avg(f1)"}
for _k, _c in (("search_actions", "searches"), ("bm25_executions", "executed")):
    _SQL3 |= {f"mean_{_k}": f"avg({_c})", f"mean_{_k}_correct": f"avg({_c}) FILTER (exact_match = 1)", f"mean_{_k}_wrong": f"avg({_c}) FILTER (exact_match = 0)"}
_SQL3 |= {"mean_unique_queries": "avg(unique_queries)", "mean_unique_documents": "avg(unique_docs)", "mean_progressive_searches": "avg(progressive)", "mean_no_progress_searches": "avg(no_progress)", "answer_rate": _B("answer_present"), "format_compliance_rate": _B("format_compliant"), "repeated_query_rate": _B("has_repeated_query"), "no_progress_rate": _B("has_no_progress")}
_SQL3 |= {f"{k}_rate": _B(f"termination = '{k}'") for k in ("search_limit", "context_overflow", "generation_truncated")}
_SQL3 |= {"support_recall": "avg(support_recall)", "full_support_rate": "avg(CAST(support_recall = 1 AS INT)) FILTER (support_recall IS NOT NULL)"}
_SQL4 = {"count": "count(*)", "exact_match": "avg(exact_match)", "f1": "avg(f1)", "strict_sft_eligible_rate": _B("len(reasons) = 0"), "mean_search_actions": "avg(searches)", "mean_bm25_executions": "avg(executed)"}


def _summary_sql(of: str, measures: dict[str, str], groups: tuple[str, ...], labels: dict[str, str]) -> str:
    """The overall figures and those of each group as plain queries, one after the other."""
    parts = []
    for g in (None, *groups):
        head = f"'{g or 'all'}' AS grouping, " + (g if g else "'all'") + " AS key"
        by = f" GROUP BY {g}" if g else ""
        cells = ", ".join(f"row('{k}', CAST({v} AS DOUBLE))" for k, v in measures.items())
        parts.append(f"SELECT grouping, key, x[1] AS metric, round(x[2], 9) AS value FROM (SELECT grouping, key, unnest(xs) AS x FROM (SELECT {head}, [{cells}] AS xs FROM {of}{by}))")
        for metric, c in labels.items():
            source = f"(SELECT *, unnest({c}) AS label FROM {of})" if c == "reasons" else f"(SELECT *, {c} AS label FROM {of})"
            parts.append(f"SELECT {head}, '{metric}:' || label, CAST(count(*) AS DOUBLE) FROM {source} GROUP BY label" + (f", {g}" if g else ""))
    return " UNION ALL ".join(parts)


def _rounded(s: DataFrame) -> DataFrame:
    return s.withColumn("value", F.round("value", 9))


def _bucket(n: str) -> Column:
    return F.when(F.col(n) == 0, "zero").when(F.col(n) == 1, "one").when(F.col(n) == 2, "two").otherwise("three_plus")


@query(_R0 + _summary_sql("s0", _SQL0, ("data_source",), {"termination": "termination"}))
def summary_v0(spark, d):
    return _rounded(results.summary(_v0(spark, d), results.measures_v0(), ["data_source"], {"termination": "termination"}))


@query(_Z1 + ", y1 AS (SELECT *, CASE WHEN v0_exact_match IS NULL THEN 'v0_reused' ELSE 'v1_continued' END AS origin FROM z1) " + _summary_sql("y1", _SQL1, ("data_source",), {"termination": "termination", "origin": "origin"}))
def summary_v1(spark, d):
    r = _v1(spark, d).withColumn("origin", F.when(F.col("v0_exact_match").isNull(), "v0_reused").otherwise("v1_continued"))
    return _rounded(results.summary(r, results.measures_v1(), ["data_source"], {"termination": "termination", "origin": "origin"}))


@query(_R3 + " " + _summary_sql("r3", _SQL3, ("data_source", "bucket"), {"termination": "termination"}))
def summary_v3(spark, d):
    r = _v3(spark, d).withColumn("bucket", _bucket("searches"))
    return _rounded(results.summary(r, results.measures_v3(), ["data_source", "bucket"], {"termination": "termination"}))


@query(_R3 + " " + _summary_sql("r3", _SQL4, ("data_source",), {"termination": "termination", "reason": "reasons"}))
def running_rollout_summary(spark, d):
    return _rounded(results.summary(_v3(spark, d), results.measures_running(), ["data_source"], {"termination": "termination", "reason": "reasons"}))


@query(_R3 + " SELECT u AS question, bucket, episode FROM (SELECT *, row_number() OVER (PARTITION BY u, bucket ORDER BY CASE WHEN data_source = 'hotpotqa' THEN CASE evidence_grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END ELSE CASE WHEN grounded THEN 0 ELSE 1 END END, CASE WHEN data_source = 'hotpotqa' THEN -coalesce(support_recall, 0) ELSE 0 END, repeated, searches, shown, episode) AS k FROM r3) WHERE k = 1")
def best_candidates(spark, d):
    """Of each user and search bucket the candidate that is preferred; repeats stand in for truncated observations, shown
    documents for the length of its prompts."""
    c = F.col
    order = selection.candidate_order(c("data_source"), c("evidence_grade"), c("support_recall"), c("grounded"), c("repeated"), c("searches"), c("shown"), c("episode"))
    r = _v3(spark, d).withColumn("bucket", _bucket("searches")).withColumn("question", F.split_part("episode", F.lit("-"), F.lit(1)).cast("long"))
    return sampling.best_of_group(r, ["question", "bucket"], order).select("question", "bucket", "episode")


@query(_R3 + ", g AS (SELECT u % 7 AS model, round(avg(exact_match), 9) AS em, round(avg(f1), 9) AS f1, round(avg(no_progress), 9) AS stalls, round(avg(CAST(format_compliant AS INT)), 9) AS form, round(avg(CAST(termination = 'search_limit' AS INT)), 9) AS limits FROM r3 GROUP BY 1) SELECT model, em, f1, CAST(row_number() OVER (ORDER BY em DESC, f1 DESC, stalls, form DESC, limits, model) AS INT) AS rank FROM g")
def model_ranking(spark, d):
    """Checkpoints by the six keys of their summaries; groups of users stand in for models."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 9)
    r = _v3(spark, d).groupBy((F.split_part("episode", F.lit("-"), F.lit(1)).cast("long") % 7).alias("model"))
    g = r.agg(mean(F.col("exact_match")).alias("em"), mean(F.col("f1")).alias("f1"), mean(F.col("no_progress")).alias("mean_no_progress_searches"), mean(F.col("format_compliant")).alias("format_compliance_rate"), mean(F.col("termination") == "search_limit").alias("search_limit_rate"))
    return selection.ranked_models(g).select("model", "em", "f1", "rank")
