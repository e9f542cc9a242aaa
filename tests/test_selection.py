import pytest
from pyspark.sql import functions as F

from episodica.functions import evidence, prompts
from episodica.operators import gates, replay, selection
from episodica.sources import jsonl


def test_rounded_quotas():
    assert selection.rounded_quotas(5, {"a": 0.5, "b": 0.5}) == {"a": 3, "b": 2}  # 2.5 rounds to 2 twice
    assert selection.rounded_quotas(3, {"a": 0.5, "b": 0.5}) == {"a": 1, "b": 2}  # 1.5 rounds to 2 twice
    assert sum(selection.rounded_quotas(1000, {"a": 0.7, "b": 0.3}).values()) == 1000


def test_ranked_is_the_order(spark):
    rows = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2))
    got = selection.ranked(rows, ["g"], "id", 9).collect()
    want = {}
    import hashlib

    for r in sorted(got, key=lambda r: hashlib.sha256(f"9:{r['id']}".encode()).hexdigest()):
        want[r["g"]] = want.get(r["g"], 0) + 1
        assert r["rank"] == want[r["g"]]
    assert len(got) == 500


def test_fill_cells(spark):
    pool = spark.createDataFrame([(q, s, q % 3, q % 7) for q in range(40) for s in ("x", "y")], "q long, s string, stratum long, rank long")
    got = selection.fill_cells(pool, ["s"], "q", ["stratum"], ["rank", "q"], {("x",): 12, ("y",): 10}).collect()
    x, y = ({r["q"] for r in got if r["s"] == s} for s in "xy")
    assert len(x) == 12 and len(y) == 10 and not x & y
    # 14, 13, 13 of 40 rows: 4.2, 3.9, 3.9 of 12
    assert sorted(sum(r["s"] == "x" and r["stratum"] == k for r in got) for k in range(3)) == [4, 4, 4]
    with pytest.raises(ValueError, match="cell"):
        selection.fill_cells(pool, ["s"], "q", ["stratum"], ["rank", "q"], {("x",): 30, ("y",): 20})
    assert selection.fill_cells(pool, ["s"], "q", ["stratum"], ["rank"], {}).count() == 0


def test_cell_targets():
    got = selection.cell_targets(18_000, {"hotpotqa": 0.7, "nq": 0.3}, {"one": 0.4, "two": 0.35, "three_plus": 0.25}, {"hotpotqa": {"A": 0.85, "B": 1 - 0.85}, "nq": {"grounded": 0.9, "ungrounded": 1 - 0.9}})
    assert sum(got.values()) == 18_000 and got["nq", "one", "grounded"] == 1944


def test_quality_gate(spark):
    rates = spark.createDataFrame([(0.5, 0.05, None)], "a double, b double, c double")
    assert gates.quality(rates, {"a": 0.5}, {"b": 0.05}).first()["passed"]
    assert gates.quality(rates, {"a": 0.51, "c": 0.1}, {"b": 0.04}).first()["failures"] == ["a", "b", "c"]
    assert not gates.quality(rates, {}, {}).first()["passed"]


def visibility(spark, titles, ids, context, visible):
    row = spark.createDataFrame([(titles, ids, context, visible)], "t array<string>, i array<int>, c array<struct<title: string, sentences: array<string>>>, v array<struct<title: string, text: string>>")
    return row.select(evidence.sentence_visibility(*map(F.col, "ticv")).alias("x")).select("x.*").first()


@pytest.mark.parametrize(("at", "text", "want"), [(0, "Before. The first one, here.", (1, 1, 1.0)), (0, "nothing", (1, 0, 0.0)), (-1, "second", (1, 1, 1.0)), (2, "x", (0, 0, None)), (-3, "x", (0, 0, None))])
def test_sentence_visibility(spark, at, text, want):
    assert tuple(visibility(spark, ["Some  Title"], [at], [("some title", ["First one here", "Second"])], [("SOME title", text)])) == want


def test_title_coverage(spark):
    row = spark.createDataFrame([(["A  b", "a B", " ", "c"], ["a b", None])], "g array<string>, v array<string>")
    got = row.select(evidence.title_coverage(F.col("g"), F.col("v")).alias("x")).first()["x"]
    assert (got["gold"], got["matched"], got["recall"]) == (2, ["a b"], 0.5)
    sharp = row.select(evidence.title_coverage(F.array(F.lit("STRASSE"), F.lit("ΟΔΟΣ")), F.array(F.lit("Straße"), F.lit("οδος"))).alias("x")).first()["x"]
    assert sharp["recall"] == 1.0
    none = row.select(evidence.title_coverage(F.lit(None).cast("array<string>"), F.col("v")).alias("x")).first()["x"]
    assert (none["gold"], none["recall"]) == (0, None)


def test_model_input(spark):
    build = lambda p, t, **k: spark.range(1).select(prompts.model_input(F.lit(p), F.lit(t).cast("string"), **k)).first()[0]
    assert build("<user>q</user><think>\n", "<think>a</think><search>b</search>") == "<user>q</user><think>\na</think><search>b</search>\n\n<think>\n"
    assert build("p<think>\n", None) == "p<think>\n"
    assert build("p", "t", reminder=F.lit(" now ")) == "pt\n\nnow\n\n<think>\n"


def episode(spark, *turns, budget=4):
    rows = [("e", i, *t, *(None,) * (4 - len(t))) for i, t in enumerate(turns)]
    t = spark.createDataFrame(rows, "episode string, turn int, kind string, query_key string, doc_keys array<string>, failure string")
    return replay.reasons(replay.replay(t, budget), F.lit(True)).first()


@pytest.mark.parametrize(("failure", "executed"), [("retrieval_error", 1), ("empty_search_result", 2), ("observation_error", 2)])
def test_failed_search_counts(spark, failure, executed):
    got = episode(spark, ("search", "a", ["1"]), ("search", "b", [], failure), ("answer",))
    assert (got["searches"], got["executed"], got["termination"], got["eligible"]) == (2, executed, failure, False)


def test_other_ends(spark):
    assert episode(spark, ("search", None, []), ("answer",))["termination"] == "empty_search"
    assert episode(spark, ("error", None, None, "generation_truncated"))["termination"] == "generation_truncated"
    cached = episode(spark, ("search", "a", ["1"]), ("search", "a", [], "retrieval_error"), ("answer",))
    assert (cached["termination"], cached["searches"], cached["executed"]) == ("answer", 2, 1)
    last = episode(spark, *[("search", str(i), [str(i)]) for i in range(4)], ("search", None, []))
    assert (last["termination"], last["searches"]) == ("search_limit", 4)


def test_numbered_lines(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = jsonl.numbered(spark, str(p))
        assert all(r["value"] == f"line {r['line']}" for r in lines.collect()) and lines.count() == 5000
        hits = spark.createDataFrame([("17",), ("9999",)], "doc_id string")
        assert {r["doc_id"]: r["contents"] for r in jsonl.fetch_lines(hits, lines).collect()} == {"17": "line 17", "9999": None}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
