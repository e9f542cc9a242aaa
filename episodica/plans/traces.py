"""Queries of actions, traces and compiled tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, text
from ..operators import carry, compiled, validation
from ..sources.shipping import ship
from .queries import query, table


def _traces(spark, d):
    """Users' events as traces: each a search and its block; some queries and blocks are blank, some last blocks are
    missing, some traces have an answer."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    q = F.when(F.col("k") % 19 == 18, " \n").otherwise(F.concat(F.lit(" Query  "), F.col("k")))
    i = F.when(F.col("k") % 29 == 28, "\t").otherwise(F.concat(F.lit("Evidence\n"), F.col("k") % 61))
    pair = F.struct("event_id", F.concat(F.lit("<search>"), q, F.lit("</SEARCH>\n")).alias("q"), F.concat(F.lit("<information>"), i, F.lit("</information>\n")).alias("i"))
    t = e.groupBy("user_id").agg(F.array_sort(F.collect_list(pair)).alias("x"))
    u = F.col("user_id")
    body = F.array_join(F.transform("x", lambda p, k: F.concat(p["q"], F.when((u % 11 == 7) & (k == F.size("x") - 1), "").otherwise(p["i"]))), "")
    answer = F.when(u % 4 != 0, F.concat(F.lit("<answer> The user "), u % 3, F.lit("</answer>"))).otherwise("")
    return t.select("user_id", F.concat(body, answer).alias("assistant"))


_TRACES = """WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
p AS (SELECT user_id, n, CASE WHEN k % 19 = 18 THEN '' ELSE 'query ' || k END AS q, CASE WHEN k % 29 = 28 THEN '' ELSE 'evidence ' || k % 61 END AS i FROM e),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, q ORDER BY n) AS nq, row_number() OVER (PARTITION BY user_id, i ORDER BY n) AS ni FROM p),
f AS (SELECT user_id, n, CASE WHEN q = '' THEN 'empty search query' WHEN nq > 1 THEN 'repeated search query (no progress)' WHEN i = '' THEN 'empty information result (no progress)' WHEN ni > 1 THEN 'repeated information result (no progress)' END AS fault FROM s),
v AS (SELECT user_id, CASE WHEN user_id % 11 = 7 THEN 'search/information turn count mismatch' ELSE coalesce(min_by(fault, n) FILTER (fault IS NOT NULL), 'ok') END AS progress, count(*) AS searches FROM f GROUP BY user_id)"""


@query(_TRACES + " SELECT user_id, progress FROM v")
def tool_progress(spark, d):
    return _traces(spark, d).select("user_id", validation.tool_progress(F.col("assistant")).alias("progress"))


@query(_TRACES + """ SELECT user_id, CASE WHEN user_id % 13 = 12 THEN 'empty question/answer' WHEN user_id % 11 = 7 AND searches = 1 THEN 'no search/information turn' WHEN user_id % 4 = 0 THEN 'missing answer tags' WHEN progress <> 'ok' THEN progress WHEN user_id % 17 = 16 THEN 'oracle pilot record' END AS error,
CASE WHEN user_id % 13 <> 12 AND user_id % 4 <> 0 AND progress = 'ok' AND user_id % 17 <> 16 THEN 2 + 2 * searches END AS turns FROM v""")
def teacher_traces(spark, d):
    u = F.col("user_id")
    rows = _traces(spark, d).withColumns({"question": F.when(u % 13 != 12, "Who?"), "answer": F.lit("x"), "label_type": F.when(u % 17 == 16, "v2_oracle_answer_pilot")})
    return validation.teacher_trace(rows).select("user_id", "error", F.when(F.col("conversations").isNotNull(), F.size("conversations")).alias("turns"))


@query(_TRACES + " SELECT user_id, CAST(searches AS INT) AS search_count, user_id % 4 <> 0 AND user_id % 3 < 2 AND progress = 'ok' AS keep FROM v")
def loose_teacher_episodes(spark, d):
    golds = F.array(F.lit("user 0"), F.lit("The user, 1."))
    return validation.loose_teacher_episode(_traces(spark, d).withColumn("golden_answers", golds)).select("user_id", "search_count", "keep")


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS s, turn % 6 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'answer' WHEN 2 THEN 'search' WHEN 5 THEN 'answer' END AS kind, CASE WHEN k IN (0, 1) THEN sha256(s) WHEN k IN (2, 5) THEN sha256('') END AS content_sha256, CASE WHEN k = 1 THEN sha256(s) WHEN k IN (3, 5) THEN sha256('') WHEN k = 4 THEN sha256('two') END AS answer_sha256 FROM t""")
def loose_actions(spark, d):
    """Whole texts in the first protocols' tags: think may be empty, content too, and back-quoted tags are words."""
    k, s = F.col("turn") % 6, F.coalesce("text", F.lit(""))
    raw = (
        F.when(k == 0, F.concat(F.lit("<think></think>\n<SEARCH>\n"), s, F.lit(" </search> ")))
        .when(k == 1, F.concat(F.lit("no opener, `<answer>` is a word</think><answer> "), s, F.lit("</answer>")))
        .when(k == 2, F.lit("<think>x</think><search> \n</search>"))
        .when(k == 3, F.concat(F.lit("<answer></answer><think>"), s))
        .when(k == 4, F.lit("<answer>one</answer>, no: <answer>\n two </answer> and more"))
        .otherwise("<think>y</think> <answer></answer>")
    )
    t = table(spark, d, "conversations").select("conv_id", "turn", text.normalize_segment(raw).alias("t"))
    t = t.select("conv_id", "turn", text.loose_action(F.col("t")).alias("a"), text.fallback_answer(F.col("t")).alias("f"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return t.select("conv_id", "turn", "a.kind", digest("a.content").alias("content_sha256"), digest("f").alias("answer_sha256"))


def _candidates(spark, d):
    """A candidate for each conversation, of two searches and an answer, that breaks one rule by its id."""
    k = F.col("conv_id") % 24
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("text").alias("text"))

    def event(kind, said, query=None, raw=True, docs=None):
        said = said if not isinstance(said, str) else F.lit(said)
        null = F.lit(None).cast("string")
        is_generated = F.lit(kind) == "generated" if isinstance(kind, str) else kind == "generated"
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), said.alias("text"), (query if query is not None else null).alias("query"),
            F.when(is_generated & raw, said).alias("raw_text"), F.when(is_generated, said).alias("canonical_text"), (docs if docs is not None else F.lit(None).cast("array<string>")).alias("documents"),
        )

    q = [F.concat(F.lit(f"q{n} "), F.col("conv_id").cast("string")) for n in (1, 2)]
    said = [F.concat(F.lit("<think>t</think><search>"), x, F.lit("</search>")) for x in q]
    said[0] = F.when(k == 20, F.concat(said[0], F.lit("x"))).otherwise(said[0])
    docs = [F.array(F.col("text")), F.array(F.lit("e"), F.lit("f"))]
    seen = F.concat(F.lit("<information>\n"), F.coalesce("text", F.lit("")), F.lit("\n</information>"))
    e = [
        event("generated", said[0], F.when(k == 9, F.lit("other")).otherwise(F.concat(q[0], F.lit(" "))), k != 8),
        event("observation", F.when(k == 12, F.lit("bare")).otherwise(seen), docs=docs[0]),
        event("generated", said[1], q[1]),
        event(F.when(k == 16, "remark").otherwise("observation"), seen, docs=F.when(k == 15, docs[0]).otherwise(docs[1])),
        event("generated", "<think>u</think><answer>a</answer>"),
    ]
    events = (
        F.when(k == 5, F.filter(F.array(e[0]), lambda x: F.lit(False)))
        .when(k == 7, F.array(e[0], e[2], e[3], e[4]))
        .when(k == 10, F.array(e[0], e[1], e[4], e[2], e[3]))
        .when(k == 11, F.array(e[1], e[0], e[4]))
        .when(k == 17, F.array(*e[:4]))
        .otherwise(F.array(*e))
    )
    rounds = [F.struct(x.alias("query"), y.alias("documents")) for x, y in zip(q, docs, strict=True)]
    rounds[1] = F.when(k == 14, F.struct(F.lit("z").alias("query"), docs[1].alias("documents"))).otherwise(rounds[1])
    both = F.when(k == 13, F.array(rounds[0])).when(k == 21, F.array(*rounds, rounds[1])).when(k != 6, F.array(*rounds))
    c = c.select(
        F.col("conv_id").alias("candidate_id"), F.when(k == 1, "old").otherwise("new").alias("protocol_id"), (k != 2).alias("strict_sft_eligible"),
        F.when(k == 3, F.array(F.lit("wrong_answer"))).otherwise(F.array().cast("array<string>")).alias("sft_rejection_reasons"),
        F.array(F.lit("r"), F.lit("r"), F.lit("r")).alias("raw_generations"), F.when(k == 4, 2).otherwise(3).alias("assistant_generation_count"),
        events.cast(f"array<{validation.EVENT}>").alias("events"), both.cast(f"array<{validation.ROUND}>").alias("retrieval_rounds"), F.when(k == 18, 3).otherwise(2).alias("search_action_count"),
    )
    trajectory = prompts.appended(F.transform("events", lambda x: x["text"]))
    return c.withColumn("canonical_trajectory", F.when(F.col("candidate_id") % 24 == 19, F.concat(trajectory, F.lit(" "))).otherwise(trajectory))


_CODES = {1: "protocol_mismatch", 2: "not_strict_eligible", 3: "not_strict_eligible", 5: "", 7: "event_order_error", 8: "raw_canonical_missing", 9: "query_event_mismatch", 10: "answer_not_final", 11: "observation_order_error", 12: "observation_format_error", 13: "missing_retrieval_round", 14: "query_information_mismatch", 15: "retrieval_documents_mismatch", 16: "unknown_event_kind", 17: "incomplete_trajectory", 18: "search_count_mismatch", 19: "canonical_trajectory_mismatch", 21: "search_count_mismatch"}
_OTHER = {4: "raw_generation_audit_mismatch", 5: "missing_candidate_events", 6: "missing_retrieval_rounds", 20: "strict_action_format_error"}


@query("SELECT conv_id AS candidate_id, CASE conv_id % 24 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in (_OTHER | {k: f"candidate_{v}" for k, v in _CODES.items() if v}).items()) + " END AS error FROM (SELECT DISTINCT conv_id FROM conversations)")
def candidates_revalidated(spark, d):
    return validation.revalidate(_candidates(spark, d), "new")


_INSTRUCTION = "Say the answer now."


@query(f"""WITH t AS (SELECT conv_id, turn, '<information>' || coalesce(text, '') || '</information>' AS o, conv_id % 10 AS k, 'user: Q' || conv_id || chr(10) || 'assistant: <think>' || chr(10) AS p, '<think>t</think><search>q' || turn || '</search>' AS a FROM conversations)
SELECT conv_id, turn, CASE k WHEN 9 THEN 'strict_action_format_error' WHEN 8 THEN 'empty_supervision' WHEN 7 THEN 'sequence_overflow' END AS error, CASE WHEN k < 7 THEN length(p) + length(a) + length(o) + 34 - 14 + {len(_INSTRUCTION)} + 6 + 8 END AS tokens, CASE WHEN k < 7 THEN length(a) + 34 - 14 END AS supervised, CASE WHEN k < 7 THEN length(o) ELSE 0 END AS information, CASE WHEN k < 7 THEN length(p) + 6 ELSE 0 END AS prompt, CASE WHEN k < 7 THEN 9 END AS spans, NULL::VARCHAR AS mask_error FROM t""")
def sft_compile(spark, d):
    """Whole texts as evidence between a search and an answer, character by character."""
    ship(spark)
    k = F.col("conv_id") % 10
    seen = F.concat(F.lit("<information>"), F.coalesce("text", F.lit("")), F.when(k == 7, F.repeat(F.lit("x"), 8200)).otherwise(""), F.lit("</information>"))
    event = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    search = F.concat(F.lit("<think>t</think><search>q"), "turn", F.lit("</search>"))
    answer = F.when(k == 9, "<answer>a</answer>").otherwise("<think>u</think><answer>a</answer>")
    events = F.when(k == 8, F.array(event("observation", seen))).otherwise(F.array(event("generated", search), event("observation", seen), event("generated", answer)))
    rendered = F.concat(F.lit("user: Q"), "conv_id", F.lit("\nassistant: <think>\n"))
    t = table(spark, d, "conversations").select("conv_id", "turn", compiled.pieces(rendered, events, True, _INSTRUCTION, 1).alias("p"))
    t = t.select("conv_id", "turn", F.col("p.error").alias("own"), F.when(F.col("p.error").isNull(), F.col("p.pieces")).otherwise(F.slice("p.pieces", 1, 1)).alias("pieces"))
    t = t.select("conv_id", "turn", "own", compiled.compiled(F.col("pieces")).alias("c"))
    tokens = lambda *kinds: compiled.span_tokens(F.col("c"), *kinds)
    return t.select("conv_id", "turn", F.coalesce("own", "c.error").alias("error"), F.col("c.token_count").alias("tokens"), F.col("c.supervised_token_count").alias("supervised"), tokens("observation").alias("information"), tokens("prompt", "separator").alias("prompt"), F.when(F.col("c.spans").isNotNull(), F.size("c.spans")).alias("spans"), compiled.mask_error(F.col("c")).alias("mask_error"))


_STATS = {"count": "count(*)", "mean_tokens": "avg(n_chars)", "mean_supervised_tokens": "avg(n_chars // 3)", "mean_supervised_fraction": "avg((n_chars // 3) / n_chars)", "mean_information_tokens": "avg(n_chars // 2)", "mean_information_mask_fraction": "avg((n_chars // 2) / n_chars)"}


@query("WITH d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'eval' ELSE 'reserve' END AS split FROM documents WHERE n_chars > 0), r AS (SELECT split, n_chars, row_number() OVER (PARTITION BY split ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY split) AS n FROM d) "
       + " UNION ALL ".join([f"SELECT split, '{k}' AS metric, round(CAST({v} AS DOUBLE), 9) AS value FROM d GROUP BY split" for k, v in _STATS.items()] + [f"SELECT split, 'q{round(100 * f)}', CAST(max(CASE WHEN k = CAST(round_even((n - 1) * {f}, 0) AS BIGINT) + 1 THEN n_chars END) AS DOUBLE) FROM r GROUP BY split" for f in compiled.LENGTHS] + ["SELECT split, 'source:' || coalesce(source, 'None'), CAST(count(*) AS DOUBLE) FROM d GROUP BY split, source"]))
def split_statistics(spark, d):
    i, n = F.col("doc_id") % 3, F.col("n_chars")
    rows = table(spark, d, "documents").where("n_chars > 0").select(F.when(i == 0, "train").when(i == 1, "eval").otherwise("reserve").alias("split"), n.alias("token_count"), F.floor(n / 3).alias("supervised_token_count"), F.floor(n / 2).alias("information_token_count"), "source")
    return compiled.split_statistics(rows, ("source",)).withColumn("value", F.round("value", 9))


@query("SELECT doc_id, CASE WHEN k = 0 THEN coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END, ''), 'C') WHEN doc_id % 2 = 0 THEN 'grounded' ELSE 'ungrounded' END AS quality, CASE k WHEN 0 THEN 'hotpotqa' WHEN 1 THEN 'nq' ELSE 'other' END AS source, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE coalesce(lang, 'unknown') END AS type, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars + doc_id % 3 END AS tokens FROM (SELECT *, doc_id % 4 AS k FROM documents)")
def quality_buckets(spark, d):
    i = F.col("doc_id")
    source = F.when(i % 8 == 0, " Hotpot_QA").when(i % 4 == 0, "HotpotQA").when(i % 8 == 1, "natural_questions").when(i % 4 == 1, "NQ ").otherwise("other")
    grade = F.when(i % 3 == 0, "A").when(i % 3 == 1, "B")
    lengths = F.when(i % 5 != 0, F.array(F.lit(0).cast("long"), F.col("n_chars") + i % 3, F.col("n_chars")))
    return table(spark, d, "documents").select("doc_id", text.quality_bucket(source, grade, i % 2 == 0).alias("quality"), text.source_name(source).alias("source"), text.or_unknown(F.when(i % 7 == 0, "").otherwise(F.col("lang"))).alias("type"), text.trajectory_tokens(lengths).alias("tokens"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(left(text, 1800)) WHEN doc_id % 4 = 1 THEN sha256(left(regexp_replace('T' || chr(10) || text, '[\\s\\p{Z}]+$', ''), 1800)) WHEN doc_id % 4 = 2 THEN sha256('T') END AS passage_sha256 FROM documents WHERE text IS NOT NULL")
def hit_contents(spark, d):
    """The first protocol's limit of a passage is part of what it computes."""
    k = F.col("doc_id") % 4
    passage = text.hit_content(F.when(k.isin(1, 2), "T"), F.when(k == 1, F.col("text")), F.when(k == 0, F.col("text")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(passage.cast("binary"), 256).alias("passage_sha256"))


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN sha256({f"'{prompts.TASK}'"} || s) WHEN turn % 3 = 1 THEN sha256('<information>' || chr(10) || s || chr(10) || chr(10) || s || chr(10) || '</information>' || chr(10) || 'Use the evidence above.' || CASE WHEN turn % 2 = 0 THEN '{prompts.LAST}' ELSE '{prompts.GO_ON}' END) ELSE sha256('<information>' || chr(10) || CASE WHEN turn % 2 = 0 THEN '{prompts.NOTHING_NEW_LAST}' ELSE '{prompts.NOTHING_NEW}' END || chr(10) || '</information>') END AS message_sha256 FROM t""")
def environment_messages(spark, d):
    k, s, last = F.col("turn") % 3, F.coalesce("text", F.lit("")), F.col("turn") % 2 == 0
    message = F.when(k == 0, prompts.question_message(s)).when(k == 1, prompts.information_message(F.array(s, s), last)).otherwise(prompts.repeat_message(last))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(message.cast("binary"), 256).alias("message_sha256"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n, string_agg(s, chr(10) || chr(10) ORDER BY turn) AS trajectory FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS s FROM conversations) GROUP BY conv_id)
SELECT conv_id, sha256('P<think>' || trajectory || chr(10) || chr(10) || '<think>' || chr(10)) AS input_sha256, length(trajectory) + 18 AS tokens, CASE WHEN length(trajectory) + 18 + 768 > 2048 THEN 'context_overflow' END AS error FROM t""")
def model_inputs(spark, d):
    """Trajectories of whole conversations after a prompt, and whether another action of 768 tokens fits in 2,048."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    t = t.select("conv_id", prompts.model_input(F.lit("P<think>"), prompts.appended(F.transform("x", lambda y: y["text"]))).alias("m"))
    return t.select("conv_id", F.sha2(F.col("m").cast("binary"), 256).alias("input_sha256"), F.length("m").cast("long").alias("tokens"), prompts.overflow(F.length("m"), 768, 2048).alias("error"))


def _v0_rows(spark, d):
    """Transcripts of the first protocol: two searches, then a repeat or not; some lack a part."""
    k, c = F.col("conv_id") % 12, F.col("conv_id").cast("string")
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("text").alias("text"))
    info = F.concat(F.lit("<information>\n"), F.coalesce("text", F.lit("")), F.lit("\n</information>\n"))
    say = lambda q: F.concat(F.lit("<think>like <information>this</information></think><search> "), q, F.lit(" </search>\n"))
    again = F.when(k == 5, F.lit("<think>x</think><answer>a</answer>")).when(k == 6, say(F.lit("never asked"))).otherwise(say(F.concat(F.lit("The  Q2, "), c)))
    body = F.when(k == 1, say(c)).otherwise(F.concat(say(F.concat(F.lit("q1 "), c)), info, F.when(k == 2, F.lit("no tags\n")).otherwise(say(F.concat(F.lit("q2 "), c))), info, F.when(k >= 8, "").otherwise(again)))
    return t.select(
        "conv_id", body.alias("assistant"), F.when(k == 0, "answer").when(k >= 8, "max_rounds").otherwise("repeated_search").alias("termination_reason"), F.array(F.concat(F.lit("q1 "), c), F.concat(F.lit("q2 "), c)).alias("queries"),
        F.when(k == 10, 8).otherwise(2).alias("search_count"), F.when((k == 9) | (k < 7), 3).otherwise(8).alias("search_attempt_count"), F.array(F.lit("d1"), F.when(k == 3, "").otherwise("d2"), F.lit("d1")).alias("doc_ids"),
        F.when(k == 4, F.array(F.lit("empty_search_query"))).when(k >= 8, F.array(F.lit("no_new_documents"), F.lit("max_rounds_without_answer"))).otherwise(F.array(F.lit("no_new_documents"), F.lit("repeated_search_query"))).alias("invalid_reasons"),
    )


@query(f"""WITH t AS (SELECT conv_id, max(text) AS text, conv_id % 12 AS k FROM conversations GROUP BY conv_id), e AS (SELECT *, CASE k WHEN 0 THEN 'not_affected' WHEN 1 THEN 'no_information_block' WHEN 2 THEN 'no_latest_search_action' WHEN 3 THEN 'missing_document_identity' WHEN 4 THEN 'terminal_reasons' WHEN 5 THEN 'no_repeated_search_action' WHEN 6 THEN 'repeat_not_in_history' WHEN 9 THEN 'attempts_not_spent' END AS error FROM t)
SELECT conv_id, error, CASE WHEN error IS NULL THEN 'v1_continued' ELSE 'v1_rerun' END AS origin, CASE WHEN error IS NULL THEN '<think>like <information>this</information></think><search> q2 ' || conv_id || ' </search>' END AS last_action, CASE WHEN error IS NULL THEN sha256('<information>' || chr(10) || coalesce(text, '') || chr(10) || '</information>' || chr(10) || 'Use the evidence above.' || CASE WHEN k >= 8 THEN '{prompts.LAST}' ELSE '{prompts.GO_ON}' END) END AS last_observation_sha256,
CASE WHEN k = 7 THEN '<think>like <information>this</information></think><search> The  Q2, ' || conv_id || ' </search>' END AS next_action, CASE WHEN k = 7 THEN '<information>' || chr(10) || '{prompts.NOTHING_NEW_LAST}' || chr(10) || '</information>' END AS next_observation, CASE WHEN error IS NULL THEN true END AS final_only, CASE WHEN error IS NULL THEN CASE WHEN k >= 8 THEN 0 ELSE 1 END END AS repeated, CASE WHEN error IS NULL THEN CASE WHEN k >= 8 THEN 1 ELSE 2 END END AS stalled, CASE WHEN error IS NULL THEN 'id:d1,id:d2' END AS seen FROM e""")
def carried_states(spark, d):
    c = carry.carried(_v0_rows(spark, d))
    return c.select("conv_id", "error", "origin", "last_action", F.sha2(F.col("last_observation").cast("binary"), 256).alias("last_observation_sha256"), "next_action", "next_observation", "final_only", "repeated", "stalled", F.array_join("seen", ",").alias("seen"))
