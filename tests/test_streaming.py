"""Episodes as a stream give what the batch replay gives."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import replay
from episodica.streaming import episodes, resume

SCHEMA = "episode string, turn int, kind string, query_key string, doc_keys array<string>, failure string, content string"
FACTS = ("episode", "termination", "searches", "executed", "repeated", "progressive", "no_progress", "unique_docs", "prediction")


def some_turns(rng, name):
    for turn in range(1, 6):
        kind = rng.choices(("search", "answer", "error"), (8, 2, 1))[0]
        failure = rng.choice(("empty_search_result", "retrieval_error", "observation_error")) if kind == "search" and rng.random() < 0.05 else "generation_truncated" if kind == "error" and rng.random() < 0.5 else None
        query = rng.choice("abcde") if kind == "search" and rng.random() < 0.95 else None
        yield name, turn, kind, query, [rng.choice("12345678") for _ in range(3)], failure, "said" if kind == "answer" else None


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_equals_batch(spark, tmp_path, batches):
    rng = random.Random(7)
    rows = [r for k in range(150) for r in some_turns(rng, f"e{k}")]
    d = spark.createDataFrame(rows, SCHEMA)
    want = {r["episode"]: tuple(r) for r in replay.replay(d, **replay.V3).select(*FACTS).collect() if r["termination"] != "generation_budget"}
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(batches):  # a later batch has the later turns, and the earlier ones again
        d.where(F.ceil(F.col("turn") * batches / 5) <= k + 1).write.mode("append").parquet(src)
        stream = episodes.advance(spark.readStream.schema(d.schema).parquet(src))
        resume.append(stream, out, ck).awaitTermination()
    got = spark.read.parquet(out).select(*FACTS).collect()
    assert {r["episode"]: tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_running_summary(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 0.5), ("b", 1, 1.0)], "data_source string, exact_match int, f1 double")
    rows.write.parquet(str(tmp_path / "in"))
    s = resume.running_summary(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("running").collect()} == {("a", 2, 0.5, 0.75), ("b", 1, 1.0, 1.0)}
