"""Traces checked again: tool progress of the first protocols, and whole candidates of the third."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def repeats(items: Column) -> Column:
    """Whether an array holds something twice."""
    return F.size(F.array_distinct(items)) < F.size(items)


def tool_progress(trace: Column, well_formed: Callable[[Column], Column] | None = None) -> Column:
    """The first thing that is wrong with a trace of searches and information blocks, else ``ok``. ``well_formed``: null, or
    what its own parser finds wrong; parsers differ, so it is given. Searches and blocks are looked at in pairs: of the
    first pair that breaks a rule, the query's fault comes before the block's."""
    t = F.coalesce(trace, F.lit(""))
    pairs = F.arrays_zip(F.transform(text.tag_contents(t, "search"), text.fingerprint).alias("q"), F.transform(text.tag_contents(t, "information"), text.fingerprint).alias("i"))

    def of_pair(p: Column) -> Column:
        def fault(x: Column, k: Column) -> Column:
            before = F.slice(p, 1, k)
            return (
                F.when(x["q"] == "", "empty search query")
                .when(F.exists(before, lambda y: y["q"] == x["q"]), "repeated search query (no progress)")
                .when(x["i"] == "", "empty information result (no progress)")
                .when(F.exists(before, lambda y: y["i"] == x["i"]), "repeated information result (no progress)")
            )

        return F.get(F.array_compact(F.transform(p, fault)), F.lit(0))

    searches, blocks = F.size(text.tag_contents(t, "search")), F.size(text.tag_contents(t, "information"))
    parsed = well_formed(t) if well_formed else F.lit(None).cast("string")
    return (
        F.when(parsed.isNotNull(), F.concat(F.lit("invalid tool-use sequence: "), parsed))
        .when(searches == 0, "no search turn")
        .when(searches != blocks, "search/information turn count mismatch")
        .otherwise(F.coalesce(text.let(pairs, of_pair), F.lit("ok")))
    )


def teacher_trace(rows: DataFrame, well_formed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (question, answer, assistant, label_type) with ``error``, the first that holds, and ``conversations`` where
    there is none: the question and the trace's turns with the evidence as human turns."""
    blank = lambda c: text.strip(F.coalesce(c, F.lit("")))
    trace = blank("assistant")
    progress = tool_progress(trace, well_formed)
    turns = text.masked_conversation(blank("question"), trace)
    error = (
        F.when((blank("question") == "") | (blank("answer") == ""), "empty question/answer")
        .when(~trace.contains("<search>") | ~trace.contains("<information>"), "no search/information turn")
        .when(~trace.contains("<answer>") | ~trace.contains("</answer>"), "missing answer tags")
        .when(progress != "ok", progress)
        .when(F.coalesce(F.col("label_type").endswith("oracle_answer_pilot"), F.lit(False)), "oracle pilot record")
        .otherwise(turns["error"])
    )
    return rows.withColumn("error", error).withColumn("conversations", F.when(F.col("error").isNull(), turns["turns"]))


def loose_teacher_episode(rows: DataFrame) -> DataFrame:
    """The first teacher's rule for whole traces (question, golden_answers, assistant): ``keep`` if any answer block, in
    normal form, is a gold answer, there is a search at least and the searches make progress."""
    golds = F.transform("golden_answers", text.normalize)
    hit = F.exists(F.transform(text.tag_contents(F.col("assistant"), "answer"), text.normalize), lambda a: F.array_contains(golds, a))
    searches = F.size(text.tag_contents(F.coalesce("assistant", F.lit("")), "search"))
    keep = F.coalesce(hit, F.lit(False)) & (searches > 0) & (tool_progress(F.col("assistant")) == "ok")
    return rows.withColumn("search_count", searches).withColumn("keep", keep)


#: Types of the columns of a candidate that is checked again.
EVENT = "struct<kind:string,text:string,query:string,raw_text:string,canonical_text:string,documents:array<string>>"
ROUND = "struct<query:string,documents:array<string>>"


def revalidate(candidates: DataFrame, protocol: str) -> DataFrame:
    """candidate_id and ``error``: the first rule, in the order of the events, that a candidate breaks, whatever its own
    flags say; null if none.

    ``candidates``: candidate_id, protocol_id, strict_sft_eligible, sft_rejection_reasons, raw_generations,
    assistant_generation_count, events (EVENT), retrieval_rounds (ROUND), search_action_count, canonical_trajectory.
    A candidate's own checks come first, then its events', by windows over the exploded events, then those of their
    sums. Nulls are missing values; only events are shuffled.
    """
    c = candidates.withColumn(
        "_own",
        F.when(~F.col("protocol_id").eqNullSafe(F.lit(protocol)), "candidate_protocol_mismatch")
        .when(~F.coalesce("strict_sft_eligible", F.lit(False)) | (F.coalesce(F.size("sft_rejection_reasons"), F.lit(0)) > 0), "candidate_not_strict_eligible")
        .when(F.col("raw_generations").isNull() | ~F.size("raw_generations").eqNullSafe(F.coalesce("assistant_generation_count", F.lit(-1))), "raw_generation_audit_mismatch")
        .when(F.col("events").isNull() | (F.size("events") == 0), "missing_candidate_events")
        .when(F.col("retrieval_rounds").isNull(), "missing_retrieval_rounds"),
    )
    order = Window.partitionBy("candidate_id").orderBy("idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    kind, said = F.col("e.kind"), F.coalesce("e.text", F.lit(""))
    e = c.where("_own is null").select("candidate_id", "retrieval_rounds", F.size("events").alias("n"), F.posexplode("events").alias("idx", "e"))
    e = e.withColumn("a", F.when(kind == "generated", text.parse_action(said)))
    e = e.withColumn("step", F.when(kind == "generated", F.coalesce("a.kind", F.lit("bad"))).when(kind == "observation", "observation"))
    blank = lambda q: text.strip(F.coalesce(q, F.lit("")))
    e = e.withColumn("waits", F.coalesce(F.lag("step").over(order) == "search", F.lit(False))).withColumn("asked", F.lag("e.query").over(order))
    e = e.withColumn("done", F.coalesce(F.max((F.col("step") == "answer").cast("int")).over(earlier) == 1, F.lit(False)))
    e = e.withColumn("round", F.coalesce(F.count_if(F.col("step") == "observation").over(earlier), F.lit(0)).cast("int"))
    here = F.get("retrieval_rounds", F.col("round"))
    generated, seen = kind == "generated", kind == "observation"
    code = (
        F.when(generated & (F.col("waits") | F.col("done")), "candidate_event_order_error")
        .when(generated & ((F.coalesce("e.raw_text", F.lit("")) == "") | ~F.col("e.canonical_text").eqNullSafe(said)), "candidate_raw_canonical_missing")
        .when(generated & F.col("a.error").isNotNull(), F.col("a.error"))
        .when((F.col("step") == "search") & (blank("e.query") != F.col("a.content")), "candidate_query_event_mismatch")
        .when((F.col("step") == "answer") & (F.col("idx") < F.col("n") - 1), "candidate_answer_not_final")
        .when(seen & (~F.col("waits") | F.col("done")), "candidate_observation_order_error")
        .when(seen & ~(said.startswith("<information>") & said.endswith("</information>")), "candidate_observation_format_error")
        .when(seen & (F.col("round") >= F.size("retrieval_rounds")), "candidate_missing_retrieval_round")
        .when(seen & (blank(here["query"]) != blank("asked")), "candidate_query_information_mismatch")
        .when(seen & ~here["documents"].eqNullSafe(F.col("e.documents")), "candidate_retrieval_documents_mismatch")
        .when(~generated & ~seen | kind.isNull(), "candidate_unknown_event_kind")
    )
    e = e.withColumn("code", code)
    last = F.max_by("step", "idx")
    g = e.groupBy("candidate_id").agg(
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("idx"))).alias("_code"),
        last.alias("_last"),
        F.count_if(F.col("step") == "search").alias("_searches"),
        F.count_if(F.col("step") == "observation").alias("_rounds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", text.strip(said).alias("t")))), lambda x: x["t"]), "\n\n").alias("_trajectory"),
    )
    j = c.join(g, "candidate_id", "left")
    error = (
        F.when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("_code").isNotNull(), F.col("_code"))
        .when(~F.col("_last").eqNullSafe(F.lit("answer")), "candidate_incomplete_trajectory")
        .when((F.col("_searches") != F.coalesce("search_action_count", F.lit(-1))) | (F.col("_rounds") != F.size("retrieval_rounds")), "candidate_search_count_mismatch")
        .when(~F.col("_trajectory").eqNullSafe(F.col("canonical_trajectory")), "candidate_canonical_trajectory_mismatch")
    )
    return j.select("candidate_id", error.alias("error"))
