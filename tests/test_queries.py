import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from oracle import DATA, duck, rows

from episodica.operators import retrieval
from episodica.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_observation_budget(spark):
    got = QUERIES["observation_budget"](spark, DATA).collect()
    assert got and all(r["tokens"] <= 768 and len(r["text"]) == r["tokens"] for r in got)


def plain_observation(hits, most=768):
    """Top hits (title, body) within so many characters, in full rounds of equal shares, then one off the longest."""
    hits = [((t or "").strip() or "Untitled", (b or "").strip()) for t, b in hits]

    def build(limits):
        bodies = [b[:n].strip() for (_, b), n in zip(hits, limits, strict=True)]
        return "\n".join(["<information>", *(f"Doc {k}(Title: {t})" + (b and f" {b}") for k, ((t, _), b) in enumerate(zip(hits, bodies, strict=True), 1)), "</information>"])

    limits, want = [0] * len(hits), [len(b) for _, b in hits]
    left = most - len(build(limits))
    while left > 0 and (active := [i for i, n in enumerate(want) if limits[i] < n]):
        share = max(1, left // len(active))
        for i in active:
            add = min(share, want[i] - limits[i], left)
            limits[i], left = limits[i] + add, left - add
    while len(build(limits)) > most:
        limits[limits.index(max(limits))] -= 1
    return build(limits), len(build(limits)), limits != want


def test_observations_of_all_documents(spark):
    order = lambda r: hashlib.sha256(f"3:{r['doc_id']}:{hashlib.sha256(r['text'].encode()).hexdigest()}".encode()).hexdigest()
    of = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=order):
        of[r["source"]].append((str(r["doc_id"]), r["text"]))
    got = {(r["source"], r["part"]): (r["text"], r["tokens"], r["truncated"]) for r in QUERIES["observation_budget"](spark, DATA).collect()}
    want = {(s, k): plain_observation(x[3 * k : 3 * k + 3]) for s, x in of.items() for k in range(math.ceil(len(x) / 3))}
    assert got == want
    assert sum(text.count("\nDoc ") for text, _, _ in got.values()) >= sum(map(len, of.values()))


def test_observation_rows_without_id_or_text(spark, tmp_path):
    docs = [(1, "x"), (1, "y"), (None, "z"), (None, None), (2, " \n"), (3, "a" * 2000), (4, " b" * 2000)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["observation_budget"](spark, str(tmp_path)).collect()
    assert len(got) == 3 and sum(r["text"].count("\nDoc ") for r in got) == len(docs)
    assert sum(r["text"].count("(Title: Untitled)") for r in got) == 2 and all(r["tokens"] <= 768 for r in got)


def test_bm25_of_odd_rows_in_slices_and_blocks(spark, tmp_path, monkeypatch):
    """Shared and missing doc_ids, equal texts, texts without a word, and item_ids of several rows."""
    import duckdb

    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("red green blue river stone The a cat's Dog, x1 x2 x3".split()) for _ in range(n))
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", " ... ", "red stone river", *(say(rng.randrange(1, 30)) for _ in range(20))])) for _ in range(150)]
    docs += [(k, "blue river") for k in range(100, 140)]
    items = [(k // 2 if k < 12 else k, say(rng.randrange(1, 6))) for k in range(30)] + [(50, None), (51, "nowhere"), (52, "the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(ORACLE_SQL["bm25_top3"]).fetchall())
    for limits in ({}, {"BLOCK": 5, "SLICE": 4, "BAG_ROWS": 3}):
        for k, v in limits.items():
            monkeypatch.setattr(retrieval, k, v)
        got = QUERIES["bm25_top3"](spark, str(tmp_path))
        assert sorted(tuple(r[c] for c in ("query_id", "doc_id", "rank")) for r in got.collect()) == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # no pairs of query and document are made as rows
    assert len(want) > 60


def conversations(spark, path, turns):
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def plain_action(raw):
    found = re.fullmatch(r"\s*<think>(.*?)</think>\s*(?:<search>(?P<search>.*?)</search>|<answer>(?P<answer>.*?)</answer>)\s*", raw, re.I | re.S)
    if not found:
        return None, "strict_action_format_error"
    kind = "search" if found["search"] is not None else "answer"
    think, content = found[1].strip(), found[kind].strip()
    if not think or not content:
        return None, "empty_think" if not think else f"empty_{kind}"
    if any(re.search(r"</?(?:think|search|answer|information)>", x, re.I) for x in (think, content)):
        return None, "forbidden_protocol_tag_in_action_content"
    return kind, None


def test_parse_actions_of_whole_texts(spark, tmp_path):
    far = "x" * 70
    texts = [f"{far}\n\n two\t lines ", f"{far} <information> late", f"{far}</think> late", f"{far}</ANSWER>", f"{far} <Think> late", f" \n{far}</search>\n", f"{far} ~ < > </none>"]
    turns = [t for t in texts for _ in range(10)]
    got = {r["turn"]: (r["kind"], r["error"]) for r in QUERIES["parse_actions"](spark, conversations(spark, tmp_path, turns)).collect()}
    want = {}
    for k, t in enumerate(turns):
        kind = "answer" if k % 2 else "search"
        want[k] = plain_action(f"<think>{t}</think> <{kind}>{'' if k % 5 == 3 else t}</{'answer' if k % 3 == 1 else kind}>")
    assert got == want and len({e for _, e in got.values()}) == 5


def test_visible_sentences_after_the_first_sixty_characters(spark, tmp_path):
    turns = ["One. Two.", "One. Two.", f"{'long ' * 20}. Second one. Last", f"{'long ' * 20}. x. Late one, here", f"{'long ' * 20}. Second. Last"]
    got = QUERIES["sentence_visibility"](spark, conversations(spark, tmp_path, turns)).collect()
    assert [tuple(r) for r in got] == [(1, 5, 3, 0.6)]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
