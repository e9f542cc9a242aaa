"""Queries of manifests, shards and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, manifest
from .queries import _norm, query, table


def _questions(spark, d):
    """Turns as question rows: some blank answers, a source with blanks around it or none."""
    t = table(spark, d, "conversations")
    source = F.when(F.col("turn") % 7 != 6, F.concat(F.lit(" "), F.upper("role"), F.lit(" ")))
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source_row"),
        F.concat(F.lit(" \t"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("question"),
        F.array(F.lit(" "), F.concat(F.lit(" x "), F.col("turn").cast("string")), F.lit(None).cast("string"), F.lit("\n")).alias("golden_answers"),
        source.alias("data_source"),
    )


@query("""SELECT conv_id * 1000 + turn AS source_row, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS question, 'x ' || turn AS answers, 1 AS n_answers, CASE WHEN turn % 7 <> 6 THEN ' ' || upper(role) || ' ' ELSE 'unknown' END AS data_source FROM conversations""")
def evaluation_manifest(spark, d):
    m = manifest.evaluation_rows(_questions(spark, d))
    return m.select("source_row", "question", F.array_join("golden_answers", "|").alias("answers"), F.size("golden_answers").alias("n_answers"), "data_source")


@query("SELECT conv_id * 1000 + turn AS source_row, lower(role) AS data_source FROM conversations WHERE turn % 7 <> 6 AND role IN ('user', 'system')")
def source_filter(spark, d):
    return manifest.of_sources(_questions(spark, d), ["user", "system"]).select("source_row", "data_source")


@query("""SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(position % 7 AS INT) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('13:' || doc_id), doc_id) - 1 AS position FROM documents)""")
def stride_shards(spark, d):
    return manifest.stride(table(spark, d, "documents").select("doc_id"), "doc_id", 13, 7)


@query(f"""WITH s AS (SELECT doc_id AS source_row, text, source FROM documents WHERE doc_id % 11 <> 10)
SELECT doc_id AS source_row, CASE WHEN doc_id % 11 = 10 THEN 'missing_source_row' WHEN doc_id % 11 = 1 THEN 'question_mismatch' WHEN doc_id % 11 = 2 THEN 'hash_drift' WHEN doc_id % 11 = 3 THEN 'source_drift' END AS error, CASE WHEN doc_id % 11 <> 10 THEN d.lang END AS lang FROM documents d""")
def bound_manifest(spark, d):
    """A manifest whose rows were changed in one thing each; blanks around a question and the case of a source do not count."""
    t, k = table(spark, d, "documents"), F.col("doc_id") % 11
    source = t.where(k != 10).select(F.col("doc_id").alias("source_row"), F.col("text").alias("question"), F.col("source").alias("data_source"), "lang")
    own = F.when(k == 1, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("\n "), "text", F.lit(" ")))
    m = t.select(F.col("doc_id").alias("source_row"), own.alias("question"), F.when(k == 3, "other").otherwise(F.upper("source")).alias("data_source"), F.when(k == 2, F.lit("0")).otherwise(F.sha2(manifest.text.normalize("text").cast("binary"), 256)).alias("question_sha256"))
    return manifest.bound(m, source).select("source_row", "error", "lang")


_POOL = f"""WITH r AS (SELECT doc_id AS source_row, sha256({_norm('text')}) AS h FROM documents), e AS (SELECT *, CASE WHEN source_row % 50 = 7 THEN 'interactive_dev_source_row' WHEN h IN (SELECT h FROM r WHERE source_row % 50 = 7 OR source_row % 71 = 5) THEN 'dev_or_final_question_hash' END AS why FROM r),
x AS (SELECT source_row, h AS question_sha256, coalesce(why, CASE WHEN source_row > min(source_row) FILTER (why IS NULL) OVER (PARTITION BY h) THEN 'duplicate_normalized_question' END) AS exclusion FROM e)"""


def _pool(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("source_row"), F.col("text").alias("question"))
    return manifest.with_exclusion(q, q.where("source_row % 50 = 7"), q.where("source_row % 71 = 5"))


@query(_POOL + " SELECT source_row, question_sha256, exclusion FROM x")
def pilot_pool(spark, d):
    return _pool(spark, d).select("source_row", "question_sha256", "exclusion")


@query(_POOL + " SELECT coalesce(exclusion, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1")
def exclusion_counts(spark, d):
    return _pool(spark, d).groupBy(F.coalesce("exclusion", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE {_norm('text')} NOT IN (SELECT {_norm('text')} FROM documents WHERE doc_id % 71 = 5)")
def questions_not_in_final(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.col("text").alias("question"))
    return manifest.without_questions(q, q.where("doc_id % 71 = 5")).select("doc_id")


@query("""WITH s AS (SELECT *, lang || '/' || source AS key FROM documents) SELECT doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY sha256((CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) + 42) || ':' || doc_id), doc_id) AS INT) AS rank FROM s WHERE lang IS NOT NULL AND source IS NOT NULL QUALIFY rank <= 20""")
def salted_pools(spark, d):
    """The first twenty of each pool, in an order of the pool's own."""
    t = table(spark, d, "documents").select("doc_id", "lang", "source").where("lang is not null and source is not null")
    order = F.struct(manifest.salted_order(42, ["lang", "source"], "doc_id"), "doc_id")
    rank = F.row_number().over(manifest.selection.Window.partitionBy("lang", "source").orderBy(order))
    return t.withColumn("rank", rank).where("rank <= 20").select("doc_id", "rank")


@query("""WITH r AS (SELECT event_id % 4 AS file, event_id AS line, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'q' || user_id END AS q, CASE event_id % 7 WHEN 0 THEN NULL ELSE event_id % 3 <> 0 END AS valid FROM events),
f AS (SELECT q, min(row(file, line)) AS first FROM r WHERE valid AND q <> '' GROUP BY q)
SELECT line, CASE WHEN valid IS NULL THEN 'rejected' WHEN q = '' THEN 'duplicate' WHEN row(file, line) > first THEN 'duplicate' WHEN NOT valid THEN 'rejected' ELSE 'kept' END AS outcome FROM r LEFT JOIN f USING (q)""")
def merged_traces(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    r = e.select((i % 4).alias("file"), i.alias("line"), F.when(i % 13 == 0, " ").otherwise(F.concat(F.lit("q"), F.col("user_id").cast("string"))).alias("question"), F.when(i % 7 != 0, i % 3 != 0).alias("valid"))
    return manifest.merged_traces(r).select("line", "outcome")


@query("""SELECT conv_id * 1000 + turn AS source_row, CASE WHEN turn % 3 = 2 THEN 'empty answer' END AS error, CASE WHEN turn % 3 <> 2 THEN 2 END AS turns, CASE WHEN turn % 3 <> 2 THEN sha256('Answer the given question. Reason inside <think> and </think>, then provide the final answer inside <answer> and </answer>.' || chr(10) || 'Question: ' || conv_id || '|<think>Identify the requested fact and verify the target answer against the question.</think>' || chr(10) || '<answer>' || turn || '</answer>') END AS digest FROM conversations""")
def pilot_examples(spark, d):
    t, turn = table(spark, d, "conversations"), F.col("turn")
    answers = F.when(turn % 3 == 0, F.array(turn.cast("string"), F.lit("other"))).when(turn % 3 == 1, F.array(F.concat(F.lit(" "), turn.cast("string"), F.lit("\n"))))
    p = manifest.pilot_examples(t.select((F.col("conv_id") * 1000 + turn).alias("source_row"), F.col("conv_id").cast("string").alias("question"), answers.alias("golden_answers"), F.col("role").alias("data_source")))
    return p.select("source_row", "error", F.when(F.col("error").isNull(), F.size("conversations")).alias("turns"), F.sha2(F.array_join(F.transform("conversations", lambda x: x["value"]), "|").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN position < 300 THEN 'train' ELSE 'eval' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('17:' || doc_id), doc_id) - 1 AS position FROM documents) WHERE position < 340")
def slice_split(spark, d):
    """Prefix and the slice after it, of the seeded order."""
    m = manifest.selection.seeded_limit(table(spark, d, "documents").select("doc_id"), "doc_id", 340, 17)
    return m.select("doc_id", manifest.sliced(F.col("position"), 300, 40).alias("split"))


@query("SELECT source, count(quality) AS n, CAST(ceil(1000 / nullif(round(avg(quality), 9), 0) * 1.2) AS BIGINT) AS candidates FROM documents JOIN labels USING (doc_id) GROUP BY source")
def cost_projection(spark, d):
    r = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("quality").alias("n"), F.round(F.avg("quality"), 9).alias("rate"))
    return r.select("source", "n", manifest.projected_cost(1000, F.col("rate")).alias("candidates"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'rerun' WHEN quality = 0 THEN 'continued' ELSE 'reused' END AS origin, quality FROM documents LEFT JOIN labels USING (doc_id)")
def rows_to_rerun(spark, d):
    first = table(spark, d, "labels").select("doc_id", "quality")
    return manifest.to_rerun(table(spark, d, "documents").select("doc_id"), first, "doc_id", F.col("quality") == 0)


@query("""SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(2 AS BIGINT), 'repeated'), (5, 0, 'missing'), (8, 1, 'unexpected')) t(shard, n, problem)""")
def shard_index_set(spark, d):
    """Headers of the shards 0 to 7, of which one came twice, one is missing and one is of another run."""
    e = table(spark, d, "events").select((F.col("event_id") % 8).alias("shard")).distinct().where("shard <> 5")
    more = e.sparkSession.createDataFrame([(2,), (8,)], "shard long")
    return integrity.shard_indexes(e.union(more), "shard", 8)


@query("SELECT event_id, CAST(event_id % 4 AS INT) AS own_shard FROM events WHERE event_id % 100 = 3 AND event_id % 4 <> (event_id + 1) % 4")
def rows_in_wrong_shard(spark, d):
    e, i = table(spark, d, "events").select("event_id"), F.col("event_id")
    e = e.withColumn("shard", F.when(i % 100 == 3, (i + 1) % 4).otherwise(i % 4).cast("int"))
    return integrity.in_wrong_shard(e, "event_id", "shard", 4).select("event_id", "own_shard")


@query("SELECT event_id, CAST(2 AS BIGINT) AS n FROM events WHERE event_id % 97 = 0")
def shard_union_duplicates(spark, d):
    e, i = table(spark, d, "events").select("event_id"), F.col("event_id")
    shards = [e.where(manifest.in_shard(i, 4, k) | (F.lit(k == 0) & (i % 97 == 0) & (i % 4 != 0)) | (F.lit(k == 1) & (i % 388 == 0))) for k in range(4)]
    return integrity.union_of_shards(shards, "event_id")[1]


@query("SELECT CAST(position AS BIGINT) AS position, doc_id + 1 AS quick, doc_id AS \"full\" FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('11:' || doc_id), doc_id) - 1 AS position FROM documents) WHERE position < 100 AND position % 10 = 4")
def quick_prefix(spark, d):
    """The quick list is the first hundred of the full one, but for every tenth row."""
    full = manifest.stride(table(spark, d, "documents").select("doc_id"), "doc_id", 11, 1)
    quick = full.where("position < 100").withColumn("doc_id", F.col("doc_id") + (F.col("position") % 10 == 4).cast("int"))
    return integrity.not_a_prefix(quick, full, "position", "doc_id")


@query("SELECT source, CASE WHEN k = 0 THEN 'missing_summary' WHEN k = 1 THEN 'several_summaries' WHEN k = 2 THEN 'wrong_protocol' END AS error FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+$') AS INT) % 5 AS k FROM documents WHERE source IS NOT NULL)")
def checkpoint_summaries(spark, d):
    named = table(spark, d, "documents").where("source is not null").select("source").distinct()
    k = F.regexp_extract("source", "[0-9]+$", 0).cast("int") % 5
    once = named.where(k != 0).select("source", F.when(k == 2, "old").otherwise("new").alias("protocol_id"))
    return integrity.one_to_one(named, once.union(once.where(k == 1)), "source", "new")


@query("SELECT doc_id AS candidate_id, CASE WHEN doc_id % 9 = 1 THEN 'missing_candidate' WHEN doc_id % 9 = 2 THEN 'duplicate_candidate' WHEN doc_id % 9 IN (3, 4) THEN 'not_strict_eligible' WHEN doc_id % 9 = 5 THEN 'checksum_mismatch' END AS error FROM documents")
def selected_candidates(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").select(i)
    c = t.where(i % 9 != 1).select(i.alias("candidate_id"), F.when(i % 9 == 3, "old").otherwise("new").alias("protocol_id"), (i % 9 != 4).alias("strict_sft_eligible"), F.when(i % 9 != 5, "c").alias("protocol_config_sha256"))
    c = c.union(c.where("candidate_id % 9 = 2"))
    return integrity.selected_candidates(t.select(i.alias("candidate_id")), c, "new", "c")


@query("""WITH n AS (SELECT (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '') AS blank, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS twice, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) FROM conversations WHERE role NOT IN ('user', 'assistant')) AS roles)
SELECT x.check, CAST(x.violations AS BIGINT) AS violations, x.violations = 0 AS passed FROM (SELECT unnest([{'check': 'blank_texts', 'violations': blank}, {'check': 'repeated_ids', 'violations': twice}, {'check': 'labels_without_document', 'violations': unknown}, {'check': 'other_roles', 'violations': roles}]) AS x FROM n)""")
def verification_report(spark, d):
    t, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    return integrity.report({
        "blank_texts": t.where("text is null or trim(text) = ''"),
        "repeated_ids": integrity.duplicate_ids(t, "doc_id"),
        "labels_without_document": labels.join(t.select("doc_id"), "doc_id", "left_anti"),
        "other_roles": table(spark, d, "conversations").where("role not in ('user', 'assistant')"),
    })
