"""Queries of the engine over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence, prompts, stats, text
from ..operators import audit, gates, integrity, observation, replay, retrieval, sampling, selection, transfer
from ..sources.shipping import ship
from ..sources.tables import cut

#: Pairs of document and item, to be looked at in full, that are sent to all tasks at most.
MOST_MET = 100_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# The SQL side normalizes by tokens: articles between word borders are the tokens that are articles.
_PUNCTUATION = text.PUNCTUATION.replace("'", "''")
_COLLAPSED = "trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _tokens(c: str) -> str:
    flat = _COLLAPSED.format(f"translate(lower({c}), '{_PUNCTUATION}', '')")
    return f"list_filter(string_split({flat}, ' '), lambda x: x not in ('a', 'an', 'the', ''))"


def _norm(c: str) -> str:
    return f"array_to_string({_tokens(c)}, ' ')"


@query(f"SELECT doc_id, {_norm('text')} AS norm, sha256({_norm('text')}) AS question_hash, {_COLLAPSED.format('lower(text)')} AS ws FROM documents")
def normalize_text(spark, d):
    c = F.col("text")
    t = table(spark, d, "documents").select("doc_id", text.normalize(c).alias("norm"), text.fingerprint(c).alias("ws"))
    return t.select("doc_id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("question_hash"), "ws")


@query(f"SELECT h AS question_hash, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256({_norm('text')}) AS h FROM documents) GROUP BY h")
def dedup_first_by_hash(spark, d):
    return table(spark, d, "documents").groupBy(text.question_hash(F.col("text")).alias("question_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"""SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || {_norm('text')} || ' ' AS t FROM documents) d
JOIN (SELECT item_id, {_norm('text')} AS q FROM benchmark) b ON contains(t, ' ' || q || ' ') AND q <> ''""")
def leakage_contains(spark, d):
    """Documents that hold a whole benchmark item: an equi-join on the item's first words, then containment."""
    width = 4
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    items = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    items = items.withColumn("anchor", F.when(F.size("q") < width, F.get("q", F.lit(0))).otherwise(F.array_join(F.slice("q", 1, width), " ")))
    # Elements by position: a slice would copy the array at each place. The texts stay out of the exploded rows.
    starts = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), lambda k: F.concat_ws(" ", *(F.get(t, k + j) for j in range(width))))
    anchors = text.let(F.col("t"), lambda t: F.array_distinct(F.concat(starts(t), t)))
    places = docs.select("doc_id", F.explode(anchors).alias("anchor"))
    items = F.broadcast(items) if items.count() <= 10_000 else items
    met = places.join(items, "anchor").select("doc_id", "item_id", F.concat(F.lit(" "), F.array_join("q", " "), F.lit(" ")).alias("part")).distinct()
    met = cut(met)
    if met.count() <= MOST_MET:  # else both sides are shuffled
        met = F.broadcast(met)
    whole = docs.select("doc_id", F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("all"))
    return whole.join(met, "doc_id").where(F.col("all").contains(F.col("part"))).select("doc_id", "item_id").distinct()


@query(f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
p AS (SELECT conv_id, turn, {_tokens('text')} AS a, {_tokens('prev')} AS b FROM t WHERE role = 'assistant' AND prev IS NOT NULL),
ca AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS x FROM p) GROUP BY ALL),
cb AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS x FROM p) GROUP BY ALL),
o AS (SELECT ca.conv_id, ca.turn, sum(least(ca.n, cb.n)) AS s FROM ca JOIN cb USING (conv_id, turn, x) GROUP BY ca.conv_id, ca.turn)
SELECT p.conv_id, p.turn, len(a) > 0 AND a = b AS em_v3, a = b AS em_v0,
round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * coalesce(s, 0) / (len(a) + len(b)) END, 9) AS f1_v3,
round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * coalesce(s, 0) / (len(a) + len(b)) END, 9) AS f1_v0
FROM p LEFT JOIN o USING (conv_id, turn)""")
def em_f1_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("prev", F.lag("text").over(w)).where("role = 'assistant' AND prev IS NOT NULL")
    a, g = F.col("text"), F.col("prev")
    return t.select("conv_id", "turn", text.exact_match(a, F.array(g)).alias("em_v3"), text.exact_match(a, F.array(g), guard=False).alias("em_v0"), F.round(text.token_f1(a, g), 9).alias("f1_v3"), F.round(text.token_f1(a, g, 1.0), 9).alias("f1_v0"))


@query("SELECT count(*) AS n, round(avg(CAST(em_v0 AS INT)), 9) AS em_v0, round(avg(CAST(em_v3 AS INT)), 9) AS em_v3, round(avg(CAST(em_v3 AS INT) - CAST(em_v0 AS INT)), 9) AS em_change, round(avg(f1_v3 - f1_v0), 9) AS f1_change, count(*) FILTER (em_v0 AND NOT em_v3) AS lost FROM (" + ORACLE_SQL["em_f1_pairs"] + ")")
def rescoring(spark, d):
    """What the later scorer, in which empty matches nothing, changes of the first one's figures."""
    r = em_f1_pairs(spark, d)
    number = lambda c: F.col(c).cast("int")
    return r.agg(F.count("*").alias("n"), F.round(F.avg(number("em_v0")), 9).alias("em_v0"), F.round(F.avg(number("em_v3")), 9).alias("em_v3"), F.round(F.avg(number("em_v3") - number("em_v0")), 9).alias("em_change"), F.round(F.avg(F.col("f1_v3") - F.col("f1_v0")), 9).alias("f1_change"), F.count_if(F.col("em_v0") & ~F.col("em_v3")).alias("lost"))


_Z2 = stats.Z * stats.Z


@query(f"""WITH r AS (SELECT d.source, d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, count(quality) AS labelled, coalesce(sum(quality), 0) AS good, avg(n_chars) AS mean, var_samp(n_chars) AS var FROM r GROUP BY GROUPING SETS ((), (source), (lang)))
SELECT source, lang, n, labelled, CASE WHEN labelled > 0 THEN round(good * 1.0 / labelled, 9) END AS rate,
round(CASE WHEN labelled = 0 THEN 0 ELSE greatest(0, (good * 1.0 / labelled + {_Z2} / (2 * labelled) - {stats.Z} * sqrt(good * 1.0 / labelled * (1 - good * 1.0 / labelled) / labelled + {_Z2} / (4.0 * labelled * labelled))) / (1 + {_Z2} / labelled)) END, 9) AS wilson_low,
round(CASE WHEN labelled = 0 THEN 0 ELSE least(1, (good * 1.0 / labelled + {_Z2} / (2 * labelled) + {stats.Z} * sqrt(good * 1.0 / labelled * (1 - good * 1.0 / labelled) / labelled + {_Z2} / (4.0 * labelled * labelled))) / (1 + {_Z2} / labelled)) END, 9) AS wilson_high,
round(greatest(0, mean - {stats.Z} * sqrt(coalesce(var, 0) / n)), 4) AS mean_low, round(mean + {stats.Z} * sqrt(coalesce(var, 0) / n), 4) AS mean_high FROM g""")
def rate_summary(spark, d):
    """Overall, by source and by language in one pass of grouping sets."""
    r = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = r.groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.avg("n_chars").alias("mean"), F.var_samp("n_chars").alias("var"))
    n, good = F.col("labelled"), F.col("good")
    low, high = stats.wilson(good / F.nullif(n, F.lit(0)) * n, n)
    m_low, m_high = stats.mean_interval(F.col("mean"), F.col("var"), F.col("n"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "labelled", F.round(good / F.nullif(n, F.lit(0)), 9).alias("rate"), F.round(F.when(n == 0, 0.0).otherwise(low), 9).alias("wilson_low"), F.round(F.when(n == 0, 0.0).otherwise(high), 9).alias("wilson_high"), F.round(m_low, 4).alias("mean_low"), F.round(m_high, 4).alias("mean_high"))


@query("SELECT round(avg(rate), 9) AS macro_rate, round(sum(good) * 1.0 / sum(n), 9) AS micro_rate FROM (SELECT source, avg(quality) AS rate, sum(quality) AS good, count(quality) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def macro_average(spark, d):
    r = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("rate"), F.sum("quality").alias("good"), F.count("quality").alias("n"))
    return r.agg(F.round(F.avg("rate"), 9).alias("macro_rate"), F.round(F.sum("good") / F.sum("n"), 9).alias("micro_rate"))


_FRACTIONS = (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)


@query("WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, n, " + ", ".join(f"max(CASE WHEN k = CAST(round_even((n - 1) * {f}, 0) AS BIGINT) + 1 THEN n_chars END) AS q{round(100 * f)}" for f in _FRACTIONS) + " FROM r GROUP BY lang, n")
def nearest_rank_quantiles(spark, d):
    return sampling.quantiles(table(spark, d, "documents"), ["lang"], "n_chars", _FRACTIONS)


@query("""WITH r AS (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem),
q AS (SELECT max(CASE WHEN k = CAST(round_even((n - 1) * (1.0 / 3), 0) AS BIGINT) + 1 THEN v END) AS a, max(CASE WHEN k = CAST(round_even((n - 1) * (2.0 / 3), 0) AS BIGINT) + 1 THEN v END) AS b FROM r)
SELECT CASE WHEN v <= a THEN 'short' WHEN v <= b THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM r, q GROUP BY 1""")
def tertile_buckets(spark, d):
    """Thresholds come from the whole table, so they are one row that goes to all tasks."""
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("all"), F.col("l_extendedprice").alias("v"))
    q = sampling.quantiles(rows, ["all"], "v", (1 / 3, 2 / 3)).select("q33", "q67")
    v = F.col("v")
    return rows.join(F.broadcast(q)).groupBy(F.when(v <= F.col("q33"), "short").when(v <= F.col("q67"), "medium").otherwise("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT source, lang, n, CAST(f + CASE WHEN rk <= 500 - sf THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT *, sum(f) OVER () AS sf, row_number() OVER (ORDER BY s - f DESC, source, lang) AS rk FROM (SELECT *, 500 * n / CAST(sum(n) OVER () AS DOUBLE) AS s, floor(500 * n / CAST(sum(n) OVER () AS DOUBLE)) AS f FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)))")
def largest_remainder_quotas(spark, d):
    return sampling.quotas(table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), ["source", "lang"], 500)


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT *, 100 * n / CAST(sum(n) OVER () AS DOUBLE) AS s FROM c),
q AS (SELECT lang, floor(s) + CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, lang) <= 100 - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id) AS rank FROM documents)
SELECT doc_id, r.lang, CAST(rank AS INT) AS rank FROM r JOIN q ON r.lang = q.lang WHERE rank <= quota""")
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 100, 7).select("doc_id", "lang", "rank")


def _turns(spark, d):
    e = table(spark, d, "events").where("event_type <> 'signup'")
    k = F.get_json_object("props", "$.k").cast("int")
    ends = F.col("event_type").isin("error", "purchase") & (k < 12)
    e = e.withColumn("episode", F.concat_ws("-", "user_id", F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 345_600)))
    e = e.withColumn("kind", F.when(~ends, "search").when(F.col("event_type") == "error", "error").otherwise("answer"))
    keys = F.array(k % 10, 100 + k % 7, 200 + k % 5)
    return e.select("episode", F.row_number().over(Window.partitionBy("episode").orderBy("ts", "event_id")).alias("turn"), "kind", F.when(F.col("kind") == "search", k % 9).alias("query_key"), keys.alias("doc_keys"), F.when(F.col("kind") == "answer", F.concat(F.lit("The Answer, "), k % 3)).alias("content"))


_FACTS = ("episode", "searches", "executed", "repeated", "progressive", "no_progress", "unique_docs", "termination")


def _judged(e: DataFrame) -> DataFrame:
    """With the reasons against it; the gold answer of an episode is by its user."""
    gold = F.array(F.concat(F.lit("answer "), F.split_part("episode", F.lit("-"), F.lit(1)).cast("long") % 3))
    e = e.withColumn("correct", text.exact_match(F.col("prediction"), gold))
    return replay.reasons(e, F.col("correct"))


def _replay_sql(budget: int, repeat_ends: bool, rounds: int = 5, unfinished: str = "generation_budget") -> str:
    ends = "WHEN seen > 1 AND kind = 'search' THEN 'repeated_search'" if repeat_ends else ""
    return f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type <> 'signup'),
t AS (SELECT user_id || '-' || CAST(floor(epoch(ts) / 345600) AS BIGINT) AS episode, ts, event_id, k, CASE WHEN event_type IN ('error', 'purchase') AND k < 12 THEN CASE event_type WHEN 'error' THEN 'error' ELSE 'answer' END ELSE 'search' END AS kind FROM e),
u AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ts, event_id) AS turn FROM t QUALIFY turn <= {rounds}),
v AS (SELECT *, sum(CASE WHEN kind = 'search' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY turn) AS ns, row_number() OVER (PARTITION BY episode, kind, CASE WHEN kind = 'search' THEN k % 9 END ORDER BY turn) AS seen FROM u),
w AS (SELECT *, CASE WHEN kind = 'error' THEN 'format_error' WHEN kind = 'answer' THEN CASE WHEN ns >= {budget} THEN 'answer_after_search_budget' ELSE 'answer' END {ends} WHEN ns > {budget} THEN 'search_limit' END AS label FROM v),
x AS (SELECT *, min(CASE WHEN label IS NOT NULL THEN turn END) OVER (PARTITION BY episode) AS cut FROM w),
y AS (SELECT *, kind = 'search' AND (cut IS NULL OR turn < cut) AS live FROM x),
dd AS (SELECT episode, min(turn) AS turn, doc FROM (SELECT episode, turn, unnest([k % 10, 100 + k % 7, 200 + k % 5]) AS doc FROM y WHERE live AND seen = 1) GROUP BY episode, doc),
nn AS (SELECT episode, turn, count(*) AS nd FROM dd GROUP BY ALL),
z AS (SELECT y.*, coalesce(nd, 0) AS nd FROM y LEFT JOIN nn USING (episode, turn)),
ep AS (SELECT episode, count(*) FILTER (live) AS searches, count(*) FILTER (live AND seen = 1) AS executed, count(*) FILTER (live AND seen > 1) AS repeated, count(*) FILTER (live AND seen = 1 AND nd > 0) AS progressive, count(*) FILTER (live AND nd = 0) AS no_progress, CAST(sum(nd) AS BIGINT) AS unique_docs, coalesce(max(CASE WHEN turn = cut THEN label END), '{unfinished}') AS termination,
coalesce(max(CASE WHEN turn = cut AND kind = 'answer' THEN k % 3 END) = CAST(split_part(episode, '-', 1) AS BIGINT) % 3, false) AS correct FROM z GROUP BY episode)"""


_REASONS = """, rr AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN NOT starts_with(termination, 'answer') THEN 'missing_answer' WHEN NOT correct THEN 'wrong_answer' END, CASE WHEN termination = 'format_error' THEN 'format_error' END, CASE WHEN searches = 0 THEN 'closed_book_answer' END,
CASE WHEN repeated > 0 THEN 'repeated_search_query' END, CASE WHEN no_progress > 0 THEN 'no_progress_search' END, CASE WHEN NOT starts_with(termination, 'answer') THEN 'terminal:' || termination END], lambda x: x IS NOT NULL))) AS reasons FROM ep)"""
_EP = " SELECT " + ", ".join(_FACTS) + " FROM ep"


@query(_replay_sql(4, False) + _EP)
def episode_replay(spark, d):
    return replay.replay(_turns(spark, d), **replay.V3).select(*_FACTS)


@query(_replay_sql(8, True, 8, "max_rounds") + _EP)
def episode_replay_v0(spark, d):
    return replay.replay(_turns(spark, d), **replay.V0).select(*_FACTS)


@query(_replay_sql(4, False) + _REASONS + " SELECT episode, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM rr")
def strict_reasons(spark, d):
    return _judged(replay.replay(_turns(spark, d), **replay.V3)).select("episode", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query(_replay_sql(4, False) + _REASONS + " SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM rr) GROUP BY reason")
def multi_label_histogram(spark, d):
    return _judged(replay.replay(_turns(spark, d), **replay.V3)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(_replay_sql(4, False) + " SELECT termination, CASE searches WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_plus' END AS bucket, count(*) AS n, round(avg(executed), 9) AS mean_executed FROM ep GROUP BY ALL")
def termination_counts(spark, d):
    e = replay.replay(_turns(spark, d), **replay.V3)
    return e.groupBy("termination", text.search_bucket(F.col("searches")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("executed"), 9).alias("mean_executed"))


@query(f"""SELECT count(*) AS n, round(avg(a.searches - b.searches), 9) AS d_searches, round(avg(CASE WHEN b.termination = 'repeated_search' THEN a.executed - b.executed END), 9) AS d_executed_affected
FROM ({_replay_sql(4, False)} SELECT * FROM ep) a JOIN ({_replay_sql(8, True, 8, 'max_rounds')} SELECT * FROM ep) b USING (episode)""")
def paired_delta(spark, d):
    t = _turns(spark, d)
    a, b = replay.replay(t, **replay.V3).alias("a"), replay.replay(t, **replay.V0).alias("b")
    j = a.join(b, "episode")
    return j.agg(F.count("*").alias("n"), F.round(F.avg(F.col("a.searches") - F.col("b.searches")), 9).alias("d_searches"), F.round(F.avg(F.when(F.col("b.termination") == "repeated_search", F.col("a.executed") - F.col("b.executed"))), 9).alias("d_executed_affected"))


@query("SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, -1) DESC, n_chars, doc_id) AS rk FROM documents LEFT JOIN labels USING (doc_id)) WHERE rk = 1")
def best_per_group(spark, d):
    r = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return sampling.best_of_group(r, ["source"], [F.desc(F.coalesce("quality", F.lit(-1))), F.col("n_chars"), F.col("doc_id")]).select("source", "doc_id", "lang", "n_chars")


@query("SELECT source, em, n, CAST(row_number() OVER (ORDER BY em DESC, chars, source) AS INT) AS rank FROM (SELECT source, round(avg(quality), 9) AS em, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def checkpoint_rank(spark, d):
    """One row for each model, here each source."""
    r = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 9).alias("em"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"))
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("em"), "chars", "source"))).drop("chars")


@query("SELECT event_id, 'missing' AS side FROM events WHERE event_id % 4 = 3 UNION ALL SELECT event_id + 1000000000, 'extra' FROM events WHERE event_id % 1000 = 0")
def shard_merge_checks(spark, d):
    e = table(spark, d, "events").select("event_id")
    merged = e.where("event_id % 4 <> 3").union(e.where("event_id % 1000 = 0").selectExpr("event_id + 1000000000"))
    return integrity.missing_and_extra(e, merged, "event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) <> 10")
def rollout_multiplicity(spark, d):
    return integrity.wrong_multiplicity(table(spark, d, "events"), "user_id", 10)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'rerun' WHEN quality = 1 THEN 'reused' ELSE 'continued' END AS origin FROM documents LEFT JOIN labels USING (doc_id)")
def incremental_reuse(spark, d):
    q = F.col("quality")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.when(q.isNull(), "rerun").when(q == 1, "reused").otherwise("continued").alias("origin"))


@query("SELECT item_id, CAST(r AS INT) AS rollout, 7 + item_id * 4 + r AS seed FROM benchmark, range(4) t(r)")
def rollouts_explode(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rollout")).withColumn("seed", 7 + F.col("item_id") * 4 + F.col("rollout"))


@query(f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents), l AS (SELECT doc_id, len(t) AS length FROM t WHERE len(t) > 0), n AS (SELECT count(*) AS docs, avg(length) AS mean FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * length / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id, n GROUP BY query_id, p.doc_id)
SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def bm25_top3(spark, d):
    index = retrieval.build_index(table(spark, d, "documents").select("doc_id", "text"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.search(index, queries).select("query_id", "doc_id", "rank")


# Whole texts as think and content.
_ACTION = "'<think>' || text || '</think> <' || CASE WHEN turn % 2 = 0 THEN 'search' ELSE 'answer' END || '>' || CASE WHEN turn % 5 = 3 THEN '' ELSE text END || '</' || CASE WHEN turn % 3 = 1 THEN 'answer' WHEN turn % 2 = 0 THEN 'search' ELSE 'answer' END || '>'"


@query("""SELECT conv_id, turn, CASE WHEN NOT ok THEN NULL WHEN turn % 5 = 3 THEN NULL ELSE k END AS kind, CASE WHEN NOT ok THEN 'strict_action_format_error' WHEN turn % 5 = 3 THEN 'empty_' || k END AS error
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'search' ELSE 'answer' END AS k, NOT (turn % 3 = 1 AND turn % 2 = 0) AS ok FROM conversations)""")
def parse_actions(spark, d):
    t = table(spark, d, "conversations").withColumn("action", F.expr(_ACTION)).withColumn("p", text.parse_action(F.col("action")))
    return t.select("conv_id", "turn", "p.kind", "p.error")


@query("""WITH e AS (SELECT conv_id AS episode, turn AS idx, CASE WHEN role = 'assistant' THEN 'observation' WHEN role = 'user' AND turn % 6 < 4 THEN 'search' WHEN role = 'user' THEN 'answer' ELSE role END AS kind FROM conversations),
o AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS a, coalesce(bool_or(kind = 'answer') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM e WINDOW w AS (PARTITION BY episode ORDER BY idx)),
c AS (SELECT *, CASE WHEN kind IN ('search', 'answer') AND (coalesce(b, '') = 'search' OR done) THEN 'candidate_event_order_error' WHEN kind = 'answer' AND a IS NOT NULL THEN 'candidate_answer_not_final' WHEN kind = 'observation' AND (coalesce(b, '') <> 'search' OR done) THEN 'candidate_observation_order_error'
WHEN kind NOT IN ('search', 'answer', 'observation') THEN 'candidate_unknown_event_kind' WHEN a IS NULL AND kind <> 'answer' THEN 'candidate_incomplete_trajectory' END AS code FROM o)
SELECT episode, min_by(code, idx) FILTER (code IS NOT NULL) AS code FROM c GROUP BY episode""")
def event_order_validate(spark, d):
    role = F.col("role")
    kind = F.when(role == "assistant", "observation").when((role == "user") & (F.col("turn") % 6 < 4), "search").when(role == "user", "answer").otherwise(role)
    e = table(spark, d, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("idx"), kind.alias("kind"))
    return replay.order_errors(e)


_STRIP = "regexp_replace({}, '^[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"
_FIRST = f"regexp_replace({_STRIP.format('string_split(text, chr(10))[1]')}, '^\"+|\"+$', '', 'g')"


@query(f"""WITH f AS (SELECT doc_id, text, {_FIRST} AS line, strpos(text, chr(10)) AS pos FROM documents WHERE text IS NOT NULL), g AS (SELECT *, line <> '' AND length(line) <= 300 AS lined FROM f)
SELECT doc_id, CASE WHEN lined THEN line ELSE 'Untitled' END AS title, sha256(CASE WHEN lined AND pos = 0 THEN '' WHEN lined THEN {_STRIP.format('substr(text, pos + 1)')} ELSE {_STRIP.format('text')} END) AS body_sha256 FROM g""")
def hit_titles(spark, d):
    none = F.lit(None).cast("string")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.hit_fields(none, none, F.col("text")).alias("hit"))
    return t.select("doc_id", "hit.title", F.sha2(F.col("hit.body").cast("binary"), 256).alias("body_sha256"))


@query()
def observation_budget(spark, d):
    """All documents, in observations of three of a source, in a seeded order; Arrow batches, held against a
    row-by-row version in the tests."""
    ship(spark)
    # an order of its own for rows that share a doc_id or have none
    docs = table(spark, d, "documents").select("source", "doc_id", "text", F.concat_ws(":", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("id"))
    r = selection.ranked(docs, ["source"], "id", 3).withColumn("part", F.floor((F.col("rank") - 1) / 3))
    top = r.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("x"))
    o = observation.observation_column(F.transform("x.doc_id", lambda i: i.cast("string")), F.col("x.text"))
    o = top.select("source", "part", o.alias("o"))
    return o.select("source", "part", "o.text", "o.tokens", "o.truncated", F.size("o.documents").alias("documents"), "o.error")


@query("""WITH t AS (SELECT l_orderkey, coalesce(list(DISTINCT 'part ' || l_partkey % 40) FILTER (l_linenumber <= 3), []) AS g, coalesce(list(DISTINCT 'part ' || l_partkey % 40) FILTER (l_linenumber >= 2), []) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(g) AS gold, array_to_string(list_sort(list_intersect(g, v)), ',') AS matched, round(len(list_intersect(g, v)) * 1.0 / nullif(len(g), 0), 9) AS recall FROM t""")
def title_coverage(spark, d):
    title, n = F.concat(F.lit("Part  "), (F.col("l_partkey") % 40).cast("string")), F.col("l_linenumber")
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(n <= 3, title)).alias("g"), F.collect_list(F.when(n >= 2, F.upper(title))).alias("v"))
    c = t.select("l_orderkey", evidence.title_coverage(F.col("g"), F.col("v")).alias("c"))
    return c.select("l_orderkey", "c.gold", F.array_join("c.matched", ",").alias("matched"), F.round("c.recall", 9).alias("recall"))


@query(f"""WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), '. ') AS s, turn % 3 - 1 AS i, {_norm("coalesce(text, '')")} AS seen FROM conversations),
p AS (SELECT conv_id, turn, s[CASE WHEN i < 0 THEN i ELSE i + 1 END] AS s, seen FROM t WHERE len(s) > i),
q AS (SELECT conv_id, turn % 2 = 0 AND contains(seen, {_norm('s')}) AS hit FROM p WHERE {_norm('s')} <> '')
SELECT conv_id, coalesce(n, 0) AS gold, coalesce(h, 0) AS visible, round(h * 1.0 / n, 9) AS recall FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (hit) AS h FROM q GROUP BY conv_id) USING (conv_id)""")
def sentence_visibility(spark, d):
    """Gold sentences in the whole text of a visible turn. Titles are turns, so each turn is looked up in itself and a
    long conversation is only a sum."""
    c = F.coalesce("text", F.lit(""))
    title = F.concat(F.lit("Turn "), F.col("turn").cast("string"))
    context = F.array(F.struct(title.alias("title"), F.split(c, r"\. ").alias("sentences")))
    visible = F.filter(F.array(F.struct(F.upper(title).alias("title"), c.alias("text"))), lambda x: F.col("turn") % 2 == 0)
    v = table(spark, d, "conversations").select("conv_id", evidence.sentence_visibility(F.array(title), F.array(F.col("turn") % 3 - 1), context, visible).alias("v"))
    g = v.groupBy("conv_id").agg(F.sum("v.gold").alias("gold"), F.sum("v.visible").alias("visible"))
    return g.withColumn("recall", F.round(evidence.share(F.col("visible"), F.col("gold")), 9))


_TEMPLATE = "Answer the question. Think first.\nQuestion: {question}?\n"


@query("""SELECT conv_id, turn, CASE WHEN coalesce(regexp_replace(text, '\\s', '', 'g'), '') = '' THEN 'empty_question' WHEN turn % 5 = 1 THEN 'missing_dataset_prompt' WHEN turn % 5 = 2 THEN 'invalid_dataset_prompt' WHEN role <> 'user' THEN 'invalid_dataset_prompt_role' WHEN turn % 5 = 3 THEN 'dataset_prompt_drift' END AS error FROM conversations""")
def prompt_drift(spark, d):
    """The rows' own prompts are made from turns: some lack one, some have another role or text."""
    kind, q = F.col("turn") % 5, F.col("text")
    content = F.concat(prompts.render(_TEMPLATE, q), F.when(kind == 3, " ").otherwise(""))
    own = F.when(kind != 1, F.filter(F.array(F.struct(F.col("role").alias("role"), content.alias("content"))), lambda x: kind != 2))
    return table(spark, d, "conversations").select("conv_id", "turn", prompts.prompt_check(own, q, _TEMPLATE)["error"].alias("error"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 6 = 0 THEN 'empty_event' WHEN role = 'user' THEN CASE WHEN turn % 6 = 1 THEN 'invalid_observation_event' END WHEN role = 'assistant' THEN CASE WHEN turn % 6 = 2 THEN 'empty_search' WHEN turn % 6 = 3 THEN 'strict_action_format_error' END ELSE 'unknown_event_kind:' || role END AS error FROM conversations""")
def event_codes(spark, d):
    k, role = F.col("turn") % 6, F.col("role")
    seen = F.when(k == 1, "<information>open").otherwise("<information>x</information>")
    said = F.when(k == 2, "<think>x</think><search> </search>").when(k == 3, "x <answer>y</answer>").otherwise("x</think><answer>y</answer>")
    event = F.when(k == 0, " \n").when(role == "user", seen).otherwise(said)
    kind = F.when(role == "user", "observation").when(role == "assistant", "generated").otherwise(role)
    return table(spark, d, "conversations").select("conv_id", "turn", prompts.event_error(kind, event).alias("error"))


@query("""SELECT doc_id, source, CAST(row_number() OVER (ORDER BY CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END, sha256('11:' || doc_id), doc_id) - 1 AS INT) AS position FROM documents QUALIFY position < 50000""")
def seeded_manifest(spark, d):
    """The evaluation set: 50,000 rows, some sources first."""
    return selection.seeded_limit(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 50_000, 11, ["src2", "src0"], "source")


def _shares_sql(of: str, total: str, name: str) -> str:
    x = f"({total}) * coalesce({of} / nullif(CAST(sum({of}) OVER () AS DOUBLE), 0), 0)"
    return f"SELECT *, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang, source) <= ({total}) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {name} FROM (SELECT *, {x} AS x FROM"


@query(f"""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT count(*) AS all_rows FROM documents),
a AS ({_shares_sql('n', 'SELECT all_rows * 6 // 10 FROM s', 'train')} c)), b AS ({_shares_sql('rest', 'SELECT all_rows // 10 FROM s', 'held')} (SELECT lang, source, train, n - train AS rest FROM a))),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('5:' || doc_id), doc_id) AS rank FROM documents)
SELECT doc_id, CASE WHEN rank <= train THEN 'train' WHEN rank <= train + held THEN 'eval' ELSE 'reserve' END AS split FROM r JOIN b ON r.lang IS NOT DISTINCT FROM b.lang AND r.source IS NOT DISTINCT FROM b.source""")
def train_eval_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    n = rows.count()
    return selection.split(rows, ["lang", "source"], "doc_id", n * 6 // 10, n // 10, 5).select("doc_id", "split")


def _cell_sql(name: str, total: int, where: str) -> str:
    return f"""{name}_x AS (SELECT lang, {total} * (count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS x FROM pool WHERE {where} GROUP BY lang),
{name}_q AS (SELECT lang, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, lang) <= {total} - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_x),
{name} AS (SELECT doc_id, question, bucket FROM (SELECT p.*, quota, row_number() OVER (PARTITION BY p.lang ORDER BY n_chars, doc_id) AS k FROM pool p JOIN {name}_q q ON p.lang = q.lang WHERE {where}) WHERE k <= quota)"""


@query(f"""WITH pool AS (SELECT doc_id, doc_id // 3 AS question, CASE doc_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'three_plus' ELSE 'two' END AS bucket, lang, n_chars FROM documents WHERE lang IS NOT NULL),
{_cell_sql('a', 25, "bucket = 'one'")}, {_cell_sql('b', 15, "bucket = 'three_plus' AND question NOT IN (SELECT question FROM a)")}, {_cell_sql('c', 10, "bucket = 'two' AND question NOT IN (SELECT question FROM a UNION ALL SELECT question FROM b)")}
SELECT doc_id, question, bucket FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def greedy_cells(spark, d):
    """Cells one after the other: a question that one took is out of the later ones."""
    k = F.col("doc_id") % 3
    pool = table(spark, d, "documents").where("lang is not null").select("doc_id", F.floor(F.col("doc_id") / 3).alias("question"), F.when(k == 0, "one").when(k == 1, "three_plus").otherwise("two").alias("bucket"), "lang", "n_chars")
    chosen = selection.fill_cells(pool, ["bucket"], "question", ["lang"], ["n_chars", "doc_id"], {("one",): 25, ("three_plus",): 15, ("two",): 10})
    return chosen.select("doc_id", "question", "bucket")


_CELL_SHARES = {"user": 0.55, "assistant": 0.45}


@query("""WITH p AS (SELECT role, CASE turn WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three_plus' END AS bucket, count(*) AS available FROM conversations GROUP BY ALL),
w AS (SELECT * FROM (VALUES ('user', 'one', 275), ('user', 'two', 165), ('user', 'three_plus', 110), ('assistant', 'one', 225), ('assistant', 'two', 135), ('assistant', 'three_plus', 90)) t(role, bucket, needed))
SELECT role, bucket, needed, coalesce(available, 0) AS available FROM w LEFT JOIN p USING (role, bucket) WHERE coalesce(available, 0) < needed""")
def shortage_report(spark, d):
    turn = F.col("turn")
    pool = table(spark, d, "conversations").select("role", F.when(turn == 0, "one").when(turn == 1, "two").otherwise("three_plus").alias("bucket"))
    targets = selection.cell_targets(1000, _CELL_SHARES, {"one": 0.5, "two": 0.3, "three_plus": 0.2}, {s: {"": 1.0} for s in _CELL_SHARES})
    return selection.shortages(pool, ["role", "bucket"], {k[:2]: n for k, n in targets.items()})


@query(_replay_sql(4, False) + _REASONS + """, tt AS (SELECT count(*) AS n, count(*) FILTER (termination = 'format_error') AS errors, round(avg(CASE WHEN len(reasons) = 0 THEN 1.0 ELSE 0 END), 9) AS strict_rate, round(avg(CASE WHEN searches >= 2 THEN 1.0 ELSE 0 END), 9) AS multi_rate, round(avg(CASE WHEN termination = 'search_limit' THEN 1.0 ELSE 0 END), 9) AS limit_rate FROM rr),
ff AS (SELECT *, list_sort(list_filter([CASE WHEN strict_rate < 0.3 THEN 'strict_rate' END, CASE WHEN multi_rate < 0.5 THEN 'multi_rate' END, CASE WHEN limit_rate > 0.05 THEN 'limit_rate' END], lambda x: x IS NOT NULL)) AS fs FROM tt)
SELECT n, errors, strict_rate, multi_rate, limit_rate, errors = 0 AS operational, array_to_string(fs, ',') AS failures, len(fs) = 0 AS passed FROM ff""")
def pilot_gates(spark, d):
    e = _judged(replay.replay(_turns(spark, d), **replay.V3))
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    t = e.agg(F.count("*").alias("n"), F.count_if(F.col("termination") == "format_error").alias("errors"), rate(F.col("eligible")).alias("strict_rate"), rate(F.col("searches") >= 2).alias("multi_rate"), rate(F.col("termination") == "search_limit").alias("limit_rate"))
    t = gates.quality(t, {"strict_rate": 0.3, "multi_rate": 0.5}, {"limit_rate": 0.05})
    return t.withColumn("operational", gates.operational({"errors": F.col("errors")})).withColumn("failures", F.array_join("failures", ","))


@query(_replay_sql(8, False, 9) + """ SELECT episode, searches, termination, NOT starts_with(termination, 'answer') AS terminal_invalid, starts_with(termination, 'answer') AND no_progress = 0 AS strict, starts_with(termination, 'answer') AND no_progress > 0 AND correct AS recovered FROM ep""")
def episode_replay_v1(spark, d):
    """The second protocol: eight attempts, repeats are answered; whether an episode recovered."""
    e = _judged(replay.replay(_turns(spark, d), **replay.V1))
    return replay.recovery(e, F.col("correct")).select("episode", "searches", "termination", "terminal_invalid", "strict", "recovered")


_CANDIDATES = _replay_sql(4, False) + _REASONS + """, c AS (SELECT split_part(episode, '-', 1) AS question, CASE WHEN executed % 2 = 0 THEN 'multi' ELSE 'single' END AS source, len(reasons) = 0 AS eligible, correct, termination, reasons, searches, executed, repeated, no_progress, unique_docs,
CASE WHEN unique_docs >= 6 THEN 'A' WHEN unique_docs >= 3 THEN 'B' ELSE 'C' END AS evidence, unique_docs > 3 AS grounded, 100 * searches + unique_docs AS tokens FROM rr), r AS (SELECT tokens AS v, row_number() OVER (ORDER BY tokens) AS k, count(*) OVER () AS n FROM c) """
_FUNNEL = {
    "candidate_count": "count(*)",
    "unique_question_count": "count(DISTINCT question)",
    "strict_eligible_count": "count(*) FILTER (eligible)",
    "strict_eligible_rate": "avg(CASE WHEN eligible THEN 1.0 ELSE 0 END)",
    "exact_match": "avg(CASE WHEN correct THEN 1.0 ELSE 0 END)",
    "format_compliance_rate": "avg(CASE WHEN termination <> 'format_error' THEN 1.0 ELSE 0 END)",
    "generation_truncated_rate": "avg(CASE WHEN termination = 'generation_truncated' THEN 1.0 ELSE 0 END)",
    "search_limit_rate": "avg(CASE WHEN termination = 'search_limit' THEN 1.0 ELSE 0 END)",
    "mean_search_actions": "avg(searches)",
    "mean_executions": "avg(executed)",
    "mean_unique_documents": "avg(unique_docs)",
    "multi_search_fraction": "avg(CASE WHEN searches >= 2 THEN 1.0 ELSE 0 END)",
    "correct_after_repeat_or_no_progress": "count(*) FILTER (correct AND (repeated > 0 OR no_progress > 0))",
}
_CELLS = {
    "source": "SELECT source AS key FROM c",
    "termination": "SELECT termination AS key FROM c",
    "searches": "SELECT CAST(searches AS VARCHAR) AS key FROM c",
    "evidence": "SELECT evidence AS key FROM c WHERE source = 'multi'",
    "grounding": "SELECT CASE WHEN grounded THEN 'grounded' ELSE 'ungrounded' END AS key FROM c WHERE source = 'single'",
    "reason": "SELECT unnest(reasons) AS key FROM c",
}


@query(_CANDIDATES + " UNION ALL ".join(
    [f"SELECT 'all' AS section, '{k}' AS key, round(CAST({v} AS DOUBLE), 9) AS value FROM c" for k, v in _FUNNEL.items()]
    + [f"SELECT '{k}', key, CAST(count(*) AS DOUBLE) FROM ({v}) GROUP BY key" for k, v in _CELLS.items()]
    + [f"SELECT 'prompt_tokens', 'q{round(100 * f)}', CAST(max(CASE WHEN k = CAST(round_even((n - 1) * {f}, 0) AS BIGINT) + 1 THEN v END) AS DOUBLE) FROM r" for f in audit.LENGTHS]
    + ["SELECT 'prompt_tokens', 'mean', round(avg(tokens), 9) FROM c"]))
def pilot_audit(spark, d):
    e = _judged(replay.replay(_turns(spark, d), **replay.V3))
    docs, executed = F.col("unique_docs"), F.col("executed")
    c = e.withColumns({
        "question": F.split_part("episode", F.lit("-"), F.lit(1)),
        "source": F.when(executed % 2 == 0, "multi").otherwise("single"),
        "format_compliant": F.col("termination") != "format_error",
        "evidence": F.when(docs >= 6, "A").when(docs >= 3, "B").otherwise("C"),
        "grounded": docs > 3,
        "prompt_tokens": 100 * F.col("searches") + docs,
    })
    return audit.audit(c, "multi", "single").select("section", "key", F.round("value", 9).alias("value"))


@query("""WITH t AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 5 <> 0 AND lang IS NOT NULL AND lang <> '' AS present, doc_id % 7 <> 0 AS format, coalesce(quality, 0) AS em FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE k WHEN 1 THEN 'repeated_search_query' WHEN 0 THEN '' ELSE 'no_new_documents' END AS recoverable, CASE WHEN k = 3 THEN 'empty_search_query' ELSE '' END AS terminal, present AND format AND k <> 3 AS valid, present AND format AND k = 0 AS strict,
em = 1 AND present AND format AND k = 0 AS strict_success, em = 1 AND present AND k IN (1, 2) AS recovered_success, CAST(em AS INT) AS v0_exact_match FROM t""")
def results_taken_over(spark, d):
    """Results of the first protocol that end as the second would; every third ends in a repeat, which changes."""
    k = F.col("doc_id") % 4
    reasons = F.when(k == 1, F.array(F.lit("repeated_search_query"))).when(k == 2, F.array(F.lit("no_new_documents"), F.lit("max_rounds_without_answer"))).when(k == 3, F.array(F.lit("empty_search_query"), F.lit("no_new_documents")))
    r = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    r = r.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("prediction"), F.col("quality").alias("exact_match"), F.col("quality").cast("double").alias("f1"), (F.col("doc_id") % 7 != 0).alias("format_compliant"), reasons.alias("invalid_reasons"), k.alias("search_count"), (k + 1).alias("search_attempt_count"), F.when(F.col("doc_id") % 3 == 0, "repeated_search").otherwise("answer").alias("termination_reason"))
    t = transfer.taken_over(r.where(~transfer.affected(F.col("termination_reason"))))
    return t.select("doc_id", F.array_join("recoverable_reasons", ",").alias("recoverable"), F.array_join("terminal_reasons", ",").alias("terminal"), F.col("valid_trajectory").alias("valid"), F.col("strict_trajectory").alias("strict"), "strict_success", "recovered_success", "v0_exact_match")
