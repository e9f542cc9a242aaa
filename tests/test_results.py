"""Scenarios of the protocols, turn by turn, and a sequential replay of random episodes."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import manifest, replay, results, validation

SCHEMA = "episode string, turn int, kind string, query_key string, doc_keys array<string>, failure string, content string"


def search(query, *docs, failure=None):
    return "search", query, list(docs), failure, None


def said(kind, content):
    return kind, None, [], None, content


def table(spark, episodes):
    rows = [(name, k, *t) for name, turns in episodes.items() for k, t in enumerate(turns, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def golds(spark, episodes, answers=("Paris",), source="nq"):
    return spark.createDataFrame([(name, list(answers), source) for name in episodes], "episode string, golden_answers array<string>, data_source string")


def test_second_protocol(spark):
    eight = [search(f"q{k}", f"d{k}") for k in range(8)]
    episodes = {
        "repeat": [search("q", "1"), search("q"), said("answer", "paris!")],
        "same documents": [search("a", "1"), search("b", "1"), said("answer", "Paris")],
        "repeat at the end": [*eight[:7], search("q0"), said("answer", "Paris")],
        "one too many": [*eight, search("more", "x")],
        "all eight": [*eight, said("answer", "Paris")],
        "malformed": [search("q", "1"), said("error", "Paris")],
        "without end": [search("q", "1")],
    }
    r = {x["episode"]: x for x in results.result_v1(replay.replay(table(spark, episodes), **replay.V1), golds(spark, episodes)).collect()}
    x = r["repeat"]
    assert (x["search_count"], x["search_attempt_count"], x["repeated"], x["recovered_success"], x["strict_trajectory"], x["recorded"]) == (1, 2, 1, True, False, ["repeated_search_query"])
    x = r["same documents"]
    assert (x["search_count"], x["redundant"], x["recorded"], x["valid_trajectory"], x["recovered_success"]) == (2, 1, ["no_new_documents"], True, True)
    x = r["repeat at the end"]
    assert (x["termination"], x["final_answer_opportunity"], x["recovered_success"], x["search_attempt_count"]) == ("answer_after_search_budget", True, True, 8)
    x = r["one too many"]
    assert (x["termination"], x["search_attempt_count"], x["recorded"], x["terminal_invalid"]) == ("search_limit", 8, ["search_after_search_budget"], True)
    x = r["all eight"]
    assert (x["search_count"], x["search_attempt_count"], x["strict_success"]) == (8, 8, True)
    x = r["malformed"]
    assert (x["termination"], x["exact_match"], x["format_compliant"], x["valid_trajectory"], x["recorded"]) == ("format_error", 1, False, False, ["malformed_or_ambiguous_action"])
    assert r["without end"]["recorded"] == ["generation_budget_exhausted_without_answer"]


def test_first_protocol(spark):
    episodes = {"repeat": [search("q", "1"), search("q")], "without end": [search(f"q{k}", f"d{k}") for k in range(8)], "ninth": [search(f"q{k}", f"d{k}") for k in range(9)], "empty": [search(None)], "fine": [search("q", "1"), said("answer", "Paris")]}
    r = {x["episode"]: x for x in results.result_v0(replay.replay(table(spark, episodes), **replay.V0), golds(spark, episodes)).collect()}
    assert [(r[k]["termination"], r[k]["recorded"]) for k in episodes] == [("repeated_search", ["repeated_search_query"]), ("max_rounds", ["max_rounds_without_answer"]), ("max_rounds", ["max_rounds_without_answer"]), ("invalid_search", ["empty_search_query"]), ("answer", [])]
    assert [(r[k]["search_count"], r[k]["search_attempt_count"], r[k]["invalid_tool_call"]) for k in episodes] == [(1, 2, True), (8, 8, True), (8, 8, True), (0, 1, True), (1, 1, False)]


def test_third_protocol(spark):
    four = [search(f"q{k}", f"d{k}") for k in range(4)]
    episodes = {"budget": [*four, said("answer", "Paris")], "closed": [said("answer", "Paris")], "wrong": [search("q", "1"), said("answer", "Rome")], "cut off": [search("q", "1"), ("error", None, [], "generation_truncated", "Paris")], "limit": [*four, search("q9", "x")]}
    g = golds(spark, episodes, source="hotpotqa").withColumn("supporting_titles", F.array(F.lit("D0"), F.lit("d9")))
    seen = F.transform("visible", lambda x: F.struct(x.alias("title"), F.concat(F.lit("in Paris, "), x).alias("text")))
    r = {x["episode"]: x for x in results.result_v3(replay.replay(table(spark, episodes), **replay.V3), g, seen).collect()}
    x = r["budget"]
    assert (x["termination"], x["reasons"], x["support_recall"], x["evidence_grade"], x["grounded"], x["generations"]) == ("answer_after_search_budget", [], 0.5, "B", True, 5)
    assert r["closed"]["reasons"] == ["closed_book_answer"] and r["wrong"]["reasons"] == ["wrong_answer"] and r["closed"]["evidence_grade"] == "C"
    assert r["cut off"]["reasons"] == ["format_error", "generation_truncated", "missing_answer", "terminal:generation_truncated"] and r["cut off"]["exact_match"] == 0
    assert (r["limit"]["searches"], r["limit"]["reasons"]) == (4, ["missing_answer", "terminal:search_limit"])


def sequential(turns, budget, rounds, ends_at_repeat, empty, unfinished):
    """One turn after the other, with the state of an episode."""
    keys, docs, n = set(), set(), {"searches": 0, "executed": 0, "repeated": 0, "progressive": 0, "no_progress": 0}
    for kind, query, found, failure, _ in turns[:rounds]:
        if kind == "error":
            return n | {"termination": failure or "format_error", "unique_docs": len(docs)}
        if kind == "answer":
            return n | {"termination": "answer_after_search_budget" if n["searches"] >= budget else "answer", "unique_docs": len(docs)}
        if n["searches"] >= budget:
            return n | {"termination": "search_limit", "unique_docs": len(docs)}
        if query in keys and ends_at_repeat:
            return n | {"termination": "repeated_search", "unique_docs": len(docs)}
        n["searches"] += 1
        if query is None:
            return n | {"termination": empty, "unique_docs": len(docs)}
        if query in keys:
            n["repeated"] += 1
            n["no_progress"] += 1
            continue
        if failure:
            n["executed"] += failure in replay.RETURNED
            return n | {"termination": failure, "unique_docs": len(docs)}
        keys.add(query)
        n["executed"] += 1
        n["progressive" if set(found) - docs else "no_progress"] += 1
        docs |= set(found)
    return n | {"termination": unfinished, "unique_docs": len(docs)}


@pytest.mark.parametrize(("rules", "plain"), [(replay.V0, (8, 8, True, "invalid_search", "max_rounds")), (replay.V1, (8, 9, False, "invalid_search", "generation_budget")), (replay.V3, (4, 5, False, "empty_search", "generation_budget"))])
def test_replay_is_sequential(spark, rules, plain):
    rng = random.Random(3)

    def turn():
        x = rng.random()
        if x < 0.06:
            return "error", None, [], rng.choice((None, "generation_truncated")), None
        if x < 0.15:
            return said("answer", "x")
        return search(rng.choice("abcdefghijk") if rng.random() < 0.96 else None, *(rng.choice("123456") for _ in range(2)), failure=rng.choice(("empty_search_result", "retrieval_error", "observation_error")) if rng.random() < 0.05 else None)

    episodes = {f"e{k}": [turn() for _ in range(rng.randint(1, 11))] for k in range(300)}
    got = {r["episode"]: r for r in replay.replay(table(spark, episodes), **rules).collect()}
    for name, turns in episodes.items():
        want = sequential(turns, *plain)
        assert {k: got[name][k] for k in want} == want, (name, turns)
    assert len({r["termination"] for r in got.values()}) >= 6


def test_conditional_means_are_null(spark):
    """Where no answer is right, there is no mean over right answers; a null source is a group of its own."""
    episodes = {"e": [search("q", "1"), said("answer", "Rome")]}
    r = results.result_v3(replay.replay(table(spark, episodes), **replay.V3), golds(spark, episodes, source=None))
    s = {(x["grouping"], x["key"], x["metric"]): x["value"] for x in results.summary(r, results.measures_v3(), ["data_source"], {"termination": "termination"}).collect()}
    assert s["all", "all", "mean_search_actions_correct"] is None and s["all", "all", "mean_search_actions_wrong"] == 1.0 and s["data_source", "None", "examples"] == 1.0
    assert s["all", "all", "termination:answer"] == 1.0 and s["all", "all", "support_recall"] is None


def test_empty_tables(spark):
    none = table(spark, {"e": [search("q", "1")]}).limit(0)
    e = replay.replay(none, **replay.V3)
    assert e.count() == 0 and results.result_v3(e, golds(spark, ["e"])).count() == 0
    rows = spark.createDataFrame([(1, "q", "s")], "source_row int, question string, data_source string")
    assert manifest.with_exclusion(rows.limit(0), rows, rows).count() == 0 and manifest.with_exclusion(rows, rows.limit(0), rows.limit(0)).first()["exclusion"] is None


def test_tool_progress_with_a_parser(spark):
    t = spark.createDataFrame([("<search>q</search><information>i</information>",), (None,), ("<search>q</search>",)], "t string")
    bad = lambda c: F.when(c.contains("i"), "odd")
    assert [r[0] for r in t.select(validation.tool_progress(F.col("t"), bad)).collect()] == ["invalid tool-use sequence: odd", "no search turn", "search/information turn count mismatch"]
