"""Manifests: which questions are evaluated or sampled, and what they are bound to."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import selection


def evaluation_rows(rows: DataFrame) -> DataFrame:
    """source_row, question, golden_answers, data_source: stripped, without blank answers; a missing source is ``unknown``."""
    answers = F.filter(F.transform(F.coalesce("golden_answers", F.array().cast("array<string>")), lambda x: text.strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return rows.select("source_row", text.strip(F.coalesce("question", F.lit(""))).alias("question"), answers.alias("golden_answers"), F.coalesce("data_source", F.lit("unknown")).alias("data_source"))


def in_shard(position: Column, shards: int, shard: int) -> Column:
    """Every so many-th row, by an id or a position from 0."""
    return F.pmod(position, F.lit(shards)) == shard


def stride(rows: DataFrame, id_col: str, seed: int, shards: int) -> DataFrame:
    """Deals rows in a seeded order to shards in turn; adds ``position`` (from 0) and ``shard``."""
    r = selection.ranked(rows.withColumn("_every", F.lit(0)), ["_every"], id_col, seed).drop("_every")
    return r.withColumn("position", F.col("rank") - 1).withColumn("shard", F.pmod(F.col("rank") - 1, F.lit(shards)).cast("int")).drop("rank")


def of_sources(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    return rows.withColumn("data_source", F.lower(text.strip("data_source"))).where(F.col("data_source").isin(*sources))


def bound(manifest: DataFrame, source: DataFrame) -> DataFrame:
    """Manifest rows (source_row, question, data_source, and perhaps question_sha256) with the source's prompt, metadata or
    whatever else it has, and ``error``: missing_source_row, question_mismatch (stripped texts differ), hash_drift (its
    normal form has another digest), source_drift (another data_source, but for case), else null. One equi-join."""
    own = [c for c in source.columns if c not in ("source_row", "question", "data_source")]
    s = source.select("source_row", F.col("question").alias("_question"), F.col("data_source").alias("_source"), F.lit(True).alias("_there"), *own)
    j = manifest.join(s, "source_row", "left")
    blank = lambda c: text.strip(F.coalesce(c, F.lit("")))
    error = F.when(F.col("_there").isNull(), "missing_source_row")
    if "question" in manifest.columns:
        error = error.when(blank("question") != blank("_question"), "question_mismatch")
    if "question_sha256" in manifest.columns:
        error = error.when(~text.question_hash(F.coalesce("_question", F.lit(""))).eqNullSafe(F.col("question_sha256")), "hash_drift")
    error = error.when(F.lower(F.coalesce("_source", F.lit(""))) != F.lower(F.coalesce("data_source", F.lit(""))), "source_drift")
    return j.withColumn("error", error).drop("_question", "_source", "_there")


def with_exclusion(rows: DataFrame, dev: DataFrame, final: DataFrame) -> DataFrame:
    """Rows (source_row, question) with question_sha256 and ``exclusion``, the first that holds of
    interactive_dev_source_row, dev_or_final_question_hash and duplicate_normalized_question (not the first row with
    its question among those that nothing else excludes); null is kept. Of a question that many rows share, one row
    for each task is shuffled to find the first."""
    r = rows.withColumn("question_sha256", text.question_hash(F.coalesce("question", F.lit(""))))
    held = dev.select("question").union(final.select("question")).select(text.question_hash(F.coalesce("question", F.lit(""))).alias("question_sha256")).distinct().withColumn("_held", F.lit(True))
    r = r.join(dev.select("source_row").distinct().withColumn("_dev", F.lit(True)), "source_row", "left").join(held, "question_sha256", "left")
    why = F.when(F.col("_dev"), "interactive_dev_source_row").when(F.col("_held"), "dev_or_final_question_hash")
    r = r.withColumn("exclusion", why).drop("_dev", "_held")
    first = r.where("exclusion is null").groupBy("question_sha256").agg(F.min("source_row").alias("_first"))
    r = r.join(first, "question_sha256", "left")
    again = F.col("exclusion").isNull() & (F.col("source_row") != F.col("_first"))
    return r.withColumn("exclusion", F.coalesce("exclusion", F.when(again, "duplicate_normalized_question"))).drop("_first")


def without_questions(rows: DataFrame, final: DataFrame) -> DataFrame:
    """Rows whose question, in normal form, is in no final row."""
    key = text.normalize(F.coalesce("question", F.lit("")))
    return rows.withColumn("_key", key).join(final.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def pool_seed(seed: int, key: Sequence[str]) -> int:
    """The seed of one pool: salted by the first 8 hex digits of its key's digest."""
    return seed + int(hashlib.sha256("/".join(key).encode()).hexdigest()[:8], 16)


def salted_order(seed: int, keys: Sequence[str], id_col: str) -> Column:
    """A seeded order of each pool of its own: the salt is part of what is hashed."""
    salt = F.conv(F.substring(F.sha2(F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"), 256), 1, 8), 16, 10).cast("long") + seed
    return F.sha2(F.concat_ws(":", salt, F.col(id_col).cast("string")).cast("binary"), 256)


def merged_traces(rows: DataFrame) -> DataFrame:
    """Rows (file, line, question, valid; null valid: the line could not be read) with ``outcome``. The first valid row of a
    question is kept; rows after it are duplicates, whether valid or not, and so are blank questions; other invalid
    rows are rejected and claim nothing."""
    r = rows.withColumn("question", text.strip(F.coalesce("question", F.lit(""))))
    at = F.struct("file", "line")
    first = r.where("valid and question <> ''").groupBy("question").agg(F.min(at).alias("_first"))
    r = r.join(first, "question", "left")
    outcome = F.when(F.col("valid").isNull(), "rejected").when(F.col("question") == "", "duplicate").when(at > F.col("_first"), "duplicate").when(~F.col("valid"), "rejected").otherwise("kept")
    return r.withColumn("outcome", outcome).drop("_first")


#: The texts of the first training pilot.
PILOT_ASK = "Answer the given question. Reason inside <think> and </think>, then provide the final answer inside <answer> and </answer>.\nQuestion: "
PILOT_THINK = "<think>Identify the requested fact and verify the target answer against the question.</think>\n<answer>"
PILOT_LABEL = "oracle_answer_pilot"


def pilot_examples(rows: DataFrame) -> DataFrame:
    """source_row, conversations (array of role, value), data_source, label_type, error: a question with its first
    gold answer in canned turns; without an answer ``empty answer``."""
    answer = text.strip(F.coalesce(F.get("golden_answers", F.lit(0)), F.lit("")))
    ask = F.concat(F.lit(PILOT_ASK), text.strip(F.coalesce("question", F.lit(""))))
    said = F.concat(F.lit(PILOT_THINK), answer, F.lit("</answer>"))
    turns = F.array(F.struct(F.lit("human").alias("role"), ask.alias("value")), F.struct(F.lit("gpt").alias("role"), said.alias("value")))
    return rows.select("source_row", F.when(answer != "", turns).alias("conversations"), F.coalesce("data_source", F.lit("unknown")).alias("data_source"), F.lit(PILOT_LABEL).alias("label_type"), F.when(answer == "", "empty answer").alias("error"))


def sliced(position: Column, train: int, held: int) -> Column:
    """The split of a row by its position from 0: first train, then eval; null beyond."""
    return F.when(position < train, "train").when(position < train + held, "eval")


def projected_cost(target: int, eligible_rate: Column, spare: float = 1.2) -> Column:
    """Candidates that have to be drawn for so many eligible ones, with some to spare; null at a rate of 0."""
    return F.ceil(target / F.nullif(eligible_rate, F.lit(0.0)) * spare)


def to_rerun(rows: DataFrame, results: DataFrame, key: str, affected: Column) -> DataFrame:
    """Manifest rows with the first results, where there are such (left join), and ``origin``: reused (nothing of it
    changes), continued, or rerun (no result)."""
    j = rows.join(results.withColumn("_there", F.lit(True)), key, "left")
    return j.withColumn("origin", F.when(F.col("_there").isNull(), "rerun").when(affected, "continued").otherwise("reused")).drop("_there")


