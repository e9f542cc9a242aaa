"""Checks of shards, headers and splits: each gives the rows that break a rule."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def union_of_shards(shards: Sequence[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with their ``shard``, the ids that are missing or in several rows)."""
    rows = reduce(DataFrame.unionByName, (s.withColumn("shard", F.lit(k)) for k, s in enumerate(shards)))
    return rows, rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


#: Rows of a task that sorts by key. Bytes are no measure: a task of narrow rows that compress well gets very many.
TASK_ROWS = 1 << 20


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, once each: key, side. A key that is null equals none. Both sides are dealt by key to tasks of
    ``TASK_ROWS`` rows and sorted there; no task keeps a table of its keys, neither before nor after."""
    both = expected.select(key, F.lit("missing").alias("side")).union(actual.select(key, F.lit("extra").alias("side")))
    none = both.where(F.col(key).isNull()).distinct()
    dealt = both.where(F.col(key).isNotNull()).repartition(max(1, -(-both.count() // TASK_ROWS)), key)
    # sides are texts, whose least and largest are found in sorted rows
    sides = dealt.groupBy(key).agg(F.min("side").alias("side"), F.max("side").alias("_last"))
    return sides.where(F.col("side") == F.col("_last")).drop("_last").union(none)


def shard_indexes(headers: DataFrame, index: str, shards: int) -> DataFrame:
    """Indexes that are not there exactly once, of 0 to ``shards`` - 1, or are none of these: index, n, problem."""
    want = headers.sparkSession.range(shards).select(F.col("id").alias(index), F.lit(True).alias("_want"))
    got = headers.groupBy(F.col(index).cast("long").alias(index)).agg(F.count("*").alias("n"))
    j = want.join(got, index, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    problem = F.when(F.col("_want").isNull(), "unexpected").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "repeated")
    return j.withColumn("problem", problem).where("problem is not null").drop("_want")


def in_wrong_shard(rows: DataFrame, key: str, shard: str, shards: int) -> DataFrame:
    """Rows that are in another shard than that of their id."""
    return rows.withColumn("own_shard", F.pmod(F.col(key), F.lit(shards)).cast("int")).where(F.col("own_shard") != F.col(shard))


def header_conflicts(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Header fields that are not the same in all shards."""
    wide = headers.agg(*(F.size(F.collect_set(F.coalesce(F.col(k).cast("string"), F.lit("null")))).alias(k) for k in keys))
    return wide.unpivot([], list(keys), "field", "values").where(F.col("values") > 1)


def leaked(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return rows.join(held.select(key).distinct(), key, "left_semi")


def wrong_multiplicity(rows: DataFrame, key: str, times: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != times)


def not_a_prefix(quick: DataFrame, full: DataFrame, position: str, value: str) -> DataFrame:
    """Positions at which the short list is not what the long one has there: position, quick, full."""
    q, f = quick.select(position, F.col(value).alias("quick")), full.select(position, F.col(value).alias("full"))
    return q.join(f, position, "left").where(~F.col("quick").eqNullSafe(F.col("full")))


def one_to_one(named: DataFrame, summaries: DataFrame, key: str, protocol: str) -> DataFrame:
    """Each named model with its summary (key, protocol_id, ...) and ``error``: missing_summary, several_summaries or
    wrong_protocol."""
    s = summaries.groupBy(key).agg(F.count("*").alias("_n"), F.first("protocol_id").alias("_protocol"))
    j = named.join(s, key, "left")
    error = F.when(F.col("_n").isNull(), "missing_summary").when(F.col("_n") > 1, "several_summaries").when(~F.col("_protocol").eqNullSafe(F.lit(protocol)), "wrong_protocol")
    return j.withColumn("error", error).drop("_n", "_protocol")


def selected_candidates(selection: DataFrame, candidates: DataFrame, protocol: str, checksum: str) -> DataFrame:
    """Selected ids with their candidate and ``error``: missing_candidate, duplicate_candidate, not_strict_eligible (or
    of another protocol) or checksum_mismatch; null is fine. ``candidates``: candidate_id, protocol_id,
    strict_sft_eligible, protocol_config_sha256."""
    c = candidates.join(selection.select("candidate_id").distinct(), "candidate_id", "left_semi")
    ok = F.coalesce((F.col("protocol_id") == protocol) & F.col("strict_sft_eligible"), F.lit(False))
    same = F.coalesce(F.col("protocol_config_sha256") == checksum, F.lit(False))
    g = c.groupBy("candidate_id").agg(F.count("*").alias("_n"), F.min(ok).alias("_ok"), F.min(same).alias("_same"))
    error = F.when(F.col("_n").isNull(), "missing_candidate").when(F.col("_n") > 1, "duplicate_candidate").when(~F.col("_ok"), "not_strict_eligible").when(~F.col("_same"), "checksum_mismatch")
    return selection.join(g, "candidate_id", "left").withColumn("error", error).drop("_n", "_ok", "_same")


def drift(own: Mapping, frozen: Mapping) -> dict[str, tuple]:
    """Keys at which a configuration is not what is frozen: (own, frozen)."""
    return {k: (own.get(k), v) for k, v in frozen.items() if own.get(k) != v}


#: Header fields that must agree before a run is resumed, of the teacher's rollouts and of evaluations.
ROLLOUT_KEYS = ("protocol_id", "protocol_config_sha256", "generator_sha256", "state_machine_sha256", "teacher", "input_sha256", "pilot_manifest_sha256", "question_count_requested", "rollouts_per_question", "seed", "shard_index", "num_shards", "retriever_url")


def guard_resume(existing: Mapping | None, wanted: Mapping, keys: Sequence[str] = ROLLOUT_KEYS) -> None:
    """Raises unless the header of what is there agrees with that of the run which is to go on."""
    if existing is None:
        raise ValueError("resume output has no metadata row")
    if found := {k: (existing.get(k), wanted.get(k)) for k in keys if existing.get(k) != wanted.get(k)}:
        raise ValueError(f"refusing unsafe resume; metadata mismatch: {found}")


def guard_output(path: str, below: Sequence[str]) -> None:
    """Raises unless the path is inside a folder of that protocol."""
    parts = PurePath(path).parts
    if not any(tuple(parts[k : k + len(below)]) == tuple(below) for k in range(len(parts))):
        raise ValueError(f"{path} is not under {'/'.join(below)}")


def canonical_hash(rows: Iterable[Mapping], line_ends: bool) -> str:
    """Digest of rows as JSON with sorted keys, one a line; ``line_ends``: a line break after the last row too. Rows are
    taken one by one, so a manifest of any length may be streamed (``toLocalIterator``)."""
    digest, first = hashlib.sha256(), True
    for row in rows:
        line = json.dumps(row, ensure_ascii=False, sort_keys=True)
        digest.update((line + "\n" if line_ends else line if first else "\n" + line).encode())
        first = False
    return digest.hexdigest()


def report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """check, violations, passed: how many rows each check found, all checks in one job."""
    return reduce(DataFrame.union, (v.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check"), "violations", (F.col("violations") == 0).alias("passed")) for k, v in checks.items()))
