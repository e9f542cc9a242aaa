"""Replay of recorded episodes by windows: every flag of a turn is a function of the turns before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 4
#: Failures of a search, which count as an action; in the last two the retriever had returned.
SEARCH_FAILURES = ("empty_search", "invalid_search", "retrieval_error", "empty_search_result", "observation_error")
RETURNED = ("empty_search_result", "observation_error")
#: Reasons that an episode can recover from.
RECOVERABLE = ("repeated_search_query", "no_new_documents")
#: Endings that rule an episode out.
FAILURES = ("format_error", "empty_search", "empty_search_result", "retrieval_error", "observation_error", "search_limit", "generation_budget", "generation_truncated", "context_overflow")
#: The reason that each ending is recorded with, in the first, the second and the third protocol; an
#: ending that is not here is its own reason.
WHY_V0 = {"format_error": "malformed_or_ambiguous_action", "invalid_search": "empty_search_query", "repeated_search": "repeated_search_query", "search_limit": "search_limit_exceeded", "max_rounds": "max_rounds_without_answer"}
WHY_V1 = {"format_error": "malformed_or_ambiguous_action", "invalid_search": "empty_search_query", "search_limit": "search_after_search_budget", "generation_budget": "generation_budget_exhausted_without_answer"}
WHY_V3 = {"format_error": "strict_action_format_error", "search_limit": "search_after_search_budget", "generation_budget": "assistant_generation_budget_exhausted"}
#: What ``replay`` is given for each protocol.
V0 = {"budget": 8, "repeat_ends": True, "empty": "invalid_search", "unfinished": "max_rounds", "rounds": 8, "why": WHY_V0}
V1 = {"budget": 8, "empty": "invalid_search", "rounds": 9, "why": WHY_V1}
V3 = {"budget": BUDGET, "rounds": 5, "why": WHY_V3}

OPTIONAL = {"failure": "string", "detail": "string", "content": "string"}


def replay(turns: DataFrame, budget: int = BUDGET, repeat_ends: bool = False, empty: str = "empty_search", unfinished: str = "generation_budget", rounds: int | None = None, why: dict[str, str] = WHY_V3) -> DataFrame:
    """Facts of each episode. ``turns``: episode, turn (from 1), kind (search, answer, error), query_key, doc_keys, and
    perhaps failure, detail and content. The first protocol has a budget of 8 in 8 rounds and ends at a repeat, the
    second has 8, the third 4; both have one round more, for the answer.

    An error ends the episode, an answer does; a search beyond the budget ends it unanswered; a repeated query
    is answered from the cache and counts as no progress, or ends the episode where ``repeat_ends``. A search
    without query_key ends it as ``empty``. ``failure`` names what else ended it at that turn: of an error
    (generation_truncated, context_overflow), or of a search that was not answered from the cache; ``detail`` is
    what is recorded with it. ``content``: the answer, or what an error's text still holds of one.

    ``searches``: actions that counted; ``executed``: those that the retriever answered; ``succeeded``: those that
    brought documents; ``shown``: documents of all rounds, the cached ones too; ``visible``: the executed rounds'
    documents in order; ``novelty``: mean share of new documents of these rounds (0 without any); ``recorded``:
    reasons in order, each as often as it came.
    """
    turns = turns.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in turns.columns})
    if rounds is not None:
        turns = turns.where(F.col("turn") <= rounds)
    order = Window.partitionBy("episode").orderBy("turn")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("episode", "kind", "query_key").orderBy("turn")
    search = F.col("kind") == "search"
    t = turns.withColumn("searches", F.sum(search.cast("int")).over(sofar))
    t = t.withColumn("seen", F.when(search, F.row_number().over(same))).withColumn("held", F.first("doc_keys").over(same))
    label = F.when(F.col("kind") == "error", F.coalesce("failure", F.lit("format_error"))).when(F.col("kind") == "answer", F.when(F.col("searches") >= budget, "answer_after_search_budget").otherwise("answer"))
    no_query = search & F.col("query_key").isNull() & (F.col("searches") <= budget)
    label = label.when(no_query, empty)
    if repeat_ends:
        label = label.when(F.col("seen") > 1, "repeated_search")
    label = label.when(F.col("searches") > budget, "search_limit").when(F.col("seen") == 1, F.col("failure"))
    t = t.withColumn("label", label).withColumn("cut", F.min(F.when(label.isNotNull(), F.col("turn"))).over(Window.partitionBy("episode")))
    t = t.where(F.col("cut").isNull() | (F.col("turn") <= F.col("cut")))
    t = t.withColumn("live", search & (F.col("cut").isNull() | (F.col("turn") < F.col("cut"))))
    t = t.withColumn("executed", F.col("live") & (F.col("seen") == 1))
    docs = t.where("executed").select("episode", "turn", F.explode("doc_keys").alias("doc")).groupBy("episode", "doc").agg(F.min("turn").alias("turn"))
    news = docs.groupBy("episode", "turn").agg(F.count("*").alias("new_docs"))
    t = t.join(news, ["episode", "turn"], "left").withColumn("new_docs", F.coalesce("new_docs", F.lit(0)))
    live, executed, last = F.col("live"), F.col("executed"), F.col("turn") == F.col("cut")
    failed = F.coalesce(search & last & F.col("label").isin(*SEARCH_FAILURES), F.lit(False))
    of_end = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in why.items() for x in kv)), F.col("label")), F.col("label"))
    of_end = F.when(F.col("label") == "retrieval_error", F.concat_ws(":", "label", "detail")).when(F.col("label").isin("format_error", "observation_error"), F.coalesce("detail", of_end)).otherwise(of_end)
    reason = F.when(last & ~F.col("label").startswith("answer"), of_end).when(live & ~executed, "repeated_search_query").when(executed & (F.col("new_docs") == 0), "no_new_documents")
    ending = F.max(F.when(last, F.col("label")))
    recorded = F.transform(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("turn", reason.alias("reason"))))), lambda x: x["reason"])
    return t.groupBy("episode").agg(
        F.count_if(live | failed).alias("searches"),
        F.count_if(executed | (failed & F.col("label").isin(*RETURNED))).alias("executed"),
        F.count_if(live & ~executed).alias("repeated"),
        F.count_if(executed & (F.col("new_docs") > 0)).alias("progressive"),
        F.count_if(live & (F.col("new_docs") == 0)).alias("no_progress"),
        F.sum("new_docs").alias("unique_docs"),
        F.coalesce(ending, F.lit(unfinished)).alias("termination"),
        F.count_if(executed).alias("succeeded"),
        F.count_if((live | (failed & F.col("query_key").isNotNull())) & (F.col("seen") == 1)).alias("unique_queries"),
        F.coalesce(F.sum(F.when(executed, F.size("doc_keys"))), F.lit(0)).alias("retrieved"),
        F.coalesce(F.sum(F.when(live, F.size("held"))), F.lit(0)).alias("shown"),
        F.coalesce(F.avg(F.when(executed & (F.size("doc_keys") > 0), F.col("new_docs") / F.size("doc_keys"))), F.lit(0.0)).alias("novelty"),
        F.count("*").alias("generations"),
        F.max(F.when(last & (F.col("kind") != "search"), F.col("content"))).alias("prediction"),
        (F.count_if(live) >= budget).alias("final_only"),
        F.concat(recorded, F.when(ending.isNull(), F.array(F.lit(why.get(unfinished, unfinished)))).otherwise(F.array().cast("array<string>"))).alias("recorded"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(executed, F.struct("turn", "doc_keys")))), lambda x: x["doc_keys"])).alias("visible"),
    )


def reasons(episodes: DataFrame, correct: Column) -> DataFrame:
    """Why an episode of the third protocol is not to be learnt from: sorted distinct reasons, and whether there are
    none. ``episodes`` come from ``replay``; ``correct``: its prediction matches a gold answer."""
    end = F.col("termination")
    r = F.array(
        F.when(F.coalesce("prediction", F.lit("")) == "", "missing_answer").when(~F.coalesce(correct, F.lit(False)), "wrong_answer"),
        F.when(end.isin("format_error", "generation_truncated"), "format_error"),
        F.when(F.col("searches") < 1, "closed_book_answer"),
        F.when(F.col("repeated") > 0, "repeated_search_query"),
        F.when(F.col("no_progress") > 0, "no_progress_search"),
        F.when(end == "generation_truncated", "generation_truncated"),
        F.when(end == "context_overflow", "sequence_overflow"),
        F.when(end.isin(*FAILURES), F.concat(F.lit("terminal:"), end)),
    )
    return episodes.withColumn("reasons", F.array_sort(F.array_distinct(F.array_compact(r)))).withColumn("eligible", F.size("reasons") == 0)


def recovery(episodes: DataFrame, correct: Column) -> DataFrame:
    """Of the second protocol's recorded reasons: terminal_invalid (one that cannot be recovered from), valid (a well
    formed answer without such), strict (valid, without any) and recovered (a correct answer, with recoverable
    reasons only)."""
    final = F.exists("recorded", lambda r: ~r.isin(*RECOVERABLE))
    other = F.exists("recorded", lambda r: r.isin(*RECOVERABLE))
    present = F.coalesce("prediction", F.lit("")) != ""
    e = episodes.withColumn("terminal_invalid", final).withColumn("valid", present & (F.col("termination") != "format_error") & ~final)
    return e.withColumn("strict", F.col("valid") & ~other).withColumn("recovered", correct & present & other & ~final)


def order_errors(events: DataFrame) -> DataFrame:
    """The first breach of order in each episode (episode, idx, kind: search, answer, observation, anything else):
    an observation stands after its search, nothing generated stands there, an answer ends the episode, and one
    ends it. Codes as in the revalidation of candidates."""
    order = Window.partitionBy("episode").orderBy("idx")
    kind = F.col("kind")
    e = events.withColumn("before", F.lag("kind").over(order)).withColumn("after", F.lead("kind").over(order))
    answered = F.max((kind == "answer").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)) == 1
    waits = F.coalesce(F.col("before") == "search", F.lit(False))
    said = kind.isin("search", "answer")
    code = (
        F.when(said & (waits | answered), "candidate_event_order_error")
        .when((kind == "answer") & F.col("after").isNotNull(), "candidate_answer_not_final")
        .when((kind == "observation") & (~waits | F.coalesce(answered, F.lit(False))), "candidate_observation_order_error")
        .when(~said & (kind != "observation") | kind.isNull(), "candidate_unknown_event_kind")
        .when(F.col("after").isNull() & (kind != "answer"), "candidate_incomplete_trajectory")
    )
    return e.withColumn("code", code).groupBy("episode").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("idx"))).alias("code"))
