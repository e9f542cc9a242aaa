import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.functions import evidence, stats, text
from episodica.operators import compiled, integrity, manifest, observation, replay, sampling
from episodica.plans import protocol
from episodica.sources import jsonl
from episodica.streaming import resume


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("p", "golds", "want"), [("", ["!!!", "The A"], False), ("---", ["!!!"], False), ("NYC", ["New York", "NYC"], True), ("January 2, 2001", ["January 2 2001"], True), ("42", ["42"], True)])
def test_exact_match(spark, p, golds, want):
    assert one(spark, text.exact_match(F.lit(p), F.array(*map(F.lit, golds)))) is want


def test_f1(spark):
    f1 = lambda a, b, e=0.0: one(spark, text.token_f1(F.lit(a), F.lit(b), e))
    assert f1("", "!!!") == 0.0 and f1("", "!!!", 1.0) == 1.0 and f1("x", "") == 0.0
    assert f1("w b b c", "b b b d") == pytest.approx(0.5)


@pytest.mark.parametrize(("s", "kind", "error"), [("reason</think><search>query</search>", "search", None), ("x <think>a</think><answer>b</answer>", None, "strict_action_format_error"), ("<think>a <information> b</think><answer>c</answer>", None, "forbidden_protocol_tag_in_action_content"), ("<think>a</think><search> </search>", None, "empty_search"), ("<think> </think><answer>b</answer>", None, "empty_think"), (None, None, "strict_action_format_error")])
def test_parse_action(spark, s, kind, error):
    got = one(spark, text.parse_action(F.lit(s).cast("string")))
    assert (got["kind"], got["error"]) == (kind, error)


def test_articles_and_accents(spark):
    assert one(spark, text.normalize(F.lit("The éan  a cat, an\tend"))) == "éan cat end"


def test_masked_turns(spark):
    got = one(spark, text.masked_turns(F.lit("a<information>b</information>c")))
    assert [tuple(x) for x in got] == [("gpt", "a"), ("human", "<information>b</information>"), ("gpt", "c")]


def test_wilson(spark):
    low, high = stats.wilson(F.lit(0), F.lit(10))
    assert one(spark, low) == 0 and one(spark, high) == pytest.approx(0.2775401687666166)
    low, high = stats.wilson(F.lit(341), F.lit(399))
    assert one(spark, low) == pytest.approx(0.816669231517481) and one(spark, high) == pytest.approx(0.8858401418938053)


def test_nearest_rank(spark):
    assert [one(spark, stats.nearest_rank(F.lit(n), 0.5)) - 1 for n in (2, 4, 6)] == [0, 2, 2]


@pytest.mark.parametrize(("sizes", "budget", "limits"), [((300, 300, 300), 240, (52, 53, 53)), ((2000, 2000, 2000), 768, (228, 229, 229)), ((10, 300, 300), 240, (10, 74, 74))])
def test_observation(sizes, budget, limits):
    got, n, cut = observation.observation([f"T{k}" for k in (1, 2, 3)], [c * s for c, s in zip("xyz", sizes, strict=True)], observation.Characters(), budget)
    assert cut and n == len(got) <= budget
    assert tuple(got.count(c) for c in "xyz") == limits


def test_compile():
    chars = observation.Characters()
    ids, labels, ends, error = compiled.compile_pieces(["ab", "cd", "e"], [False, True, False], chars)
    assert error is None and labels == [-100, -100, 99, 100, -100] and len(ids) == 5 and ends == [2, 4, 5]
    assert compiled.compile_pieces(["x" * 8192], [True], chars)[3] is None
    assert compiled.compile_pieces(["x" * 8193], [True], chars)[3] == "sequence_overflow"
    assert compiled.compile_pieces(["x"], [False], chars)[3] == "empty_supervision"

    class Pairs(observation.Characters):
        def encode(self, text):
            return [hash(text[k : k + 2]) for k in range(0, len(text), 2)]

    assert compiled.compile_pieces(["abc", "d"], [True, True], Pairs())[3] == "segment_tokenization_mismatch"


def test_pieces(spark):
    """One opener and one reminder, both masked; the model's own opener is not there twice."""
    events = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("generated", "<think>a</think><search>q</search>"), ("observation", "<information>x</information>"), ("generated", "<think>b</think><answer>c</answer>"))))
    for opener, instruction, kinds in ((True, " Now. ", ["prompt", "generated", "separator", "observation", "separator", "final_answer_instruction", "separator", "action_prefix", "generated"]), (False, "Now.", ["prompt", "generated", "separator", "observation", "separator", "generated"])):
        frame = spark.range(1).select(compiled.pieces(F.lit("<user>u</user><assistant><think>\n"), events, opener, instruction, 1).alias("p")).select("p.*")
        p = frame.first()
        assert p["error"] is None and [x["kind"] for x in p["pieces"]] == kinds
        whole = "".join(x["text"] for x in p["pieces"])
        assert whole.count("<think>") == 2 and whole.count("Now.") == int(opener)
        c = frame.select(compiled.compiled(F.col("pieces")).alias("c")).select("c.*", compiled.mask_error(F.col("c")).alias("wrong")).first()
        assert c["wrong"] is None and "".join(map(chr, c["input_ids"])) == whole and c["token_count"] == len(whole)
        learnt = "".join(chr(x) for x in c["labels"] if x != -100)
        assert learnt == "".join(x["text"] for x in p["pieces"] if x["supervised"]) and all(s["supervised"] == (s["kind"] == "generated") for s in c["spans"])
    bad = spark.range(1).select(compiled.pieces(F.lit("p"), F.array(F.struct(F.lit("remark").alias("kind"), F.lit("x").alias("text")))).alias("p")).first()["p"]
    assert bad["error"] == "unknown_event_kind:remark"


def test_allocate():
    assert sampling.allocate(10, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}) == {"a": 4, "b": 3, "c": 3}


def test_replay_budget(spark):
    kinds = ["search"] * 4 + ["answer"]
    t = spark.createDataFrame([("e", k + 1, x, k if x == "search" else None, [k], "Paris" if x == "answer" else None) for k, x in enumerate(kinds)] + [("f", k + 1, "search", k, [k], None) for k in range(5)] + [("g", 1, "search", 1, [1], None), ("g", 2, "search", 1, [1], None), ("g", 3, "answer", None, [], "Rome")], "episode string, turn int, kind string, query_key int, doc_keys array<int>, content string")
    got = {r["episode"]: r for r in replay.reasons(replay.replay(t), F.col("prediction") == "Paris").collect()}
    assert got["e"]["termination"] == "answer_after_search_budget" and got["e"]["eligible"] and got["e"]["searches"] == 4
    assert got["f"]["termination"] == "search_limit" and got["f"]["searches"] == 4
    assert got["g"]["executed"] == 1 and got["g"]["repeated"] == 1 and got["g"]["reasons"] == ["no_progress_search", "repeated_search_query", "wrong_answer"]
    assert got["f"]["reasons"] == ["missing_answer", "terminal:search_limit"]
    ended = {r["episode"]: r["termination"] for r in replay.replay(t, 8, repeat_ends=True).collect()}
    assert ended["g"] == "repeated_search"


def test_checks(spark):
    h = spark.createDataFrame([("p", 1), ("p", 2)], "name string, seed int")
    assert [r["field"] for r in integrity.header_conflicts(h, ["name", "seed"]).collect()] == ["seed"]
    assert integrity.duplicate_ids(h, "name").count() == 1 and integrity.leaked(h, h.where("seed = 1"), "seed").count() == 1


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"type": "result", "id": 1}\n\n{"type": "metadata", "id": 2}\n{bad\n')
    s = T.StructType([T.StructField("id", T.LongType())])
    assert sorted(r["id"] for r in jsonl.lenient(spark, str(p), s).collect()) == [1, 2]
    good, bad = jsonl.counted(spark, str(p), s)
    assert good.count() == 2 and bad.first()["rejected"] == 1
    with pytest.raises(Exception):
        jsonl.strict(spark, str(p), s).collect()
    p.write_text('{"type": "result", "id": 1}\n{"type": "metadata", "id": 2}\n')
    found = jsonl.tagged(spark, str(p), {"result": s, "metadata": s})
    assert [r["id"] for r in found["result"].collect()] == [1]
    p.write_text('{"type": "other"}\n')
    with pytest.raises(Exception, match="unknown row type"):
        jsonl.tagged(spark, str(p), {"result": s})["result"].collect()


def test_protocol(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "limits": {"x": 1, "y": 2}}))
    child = {"extends": "a.json", "extends_sha256": jsonl.file_sha256(tmp_path / "a.json"), "overrides": {"limits": {"x": 3}}, "id": "b"}
    (tmp_path / "b.json").write_text(json.dumps(child))
    assert protocol.inherited(tmp_path / "b.json") == {"id": "b", "limits": {"x": 3, "y": 2}}
    (tmp_path / "b.json").write_text(json.dumps(child | {"limits": {"y": 5}}))
    assert protocol.inherited(tmp_path / "b.json") == {"id": "b", "limits": {"x": 1, "y": 5}}
    (tmp_path / "a.json").write_text("{}")
    with pytest.raises(ValueError, match="not the parent"):
        protocol.inherited(tmp_path / "b.json")


def test_frozen_protocol():
    good = {"schema_version": 1, "human_version": "R3.10", "protocol_id": "x_v3_10_0", "prompt": {}, "retrieval": {"top_k": 3}, "interaction": {"max_search_actions": 4}, "token_budget": {"initial_prompt_tokens": 512, "max_model_len": 8192, "max_new_tokens_per_action": 768, "max_observation_tokens": 768, "max_new_tokens_final_action": 1280}}
    assert protocol.checked(good) == good
    for change in ({"human_version": "R4.0"}, {"protocol_id": "x_v3_1_0"}, {"retrieval": {"top_k": 5}}, {"interaction": {"max_search_actions": 5}}, {"token_budget": good["token_budget"] | {"max_observation_tokens": 512}}, {"token_budget": good["token_budget"] | {"max_new_tokens_final_action": 1600}}, {"token_budget": good["token_budget"] | {"max_new_tokens_final_action": 700}}):
        with pytest.raises(ValueError):
            protocol.checked(good | change)
    with pytest.raises(ValueError, match="lacks"):
        protocol.checked({k: v for k, v in good.items() if k != "prompt"})


def test_resume(spark, tmp_path):
    s = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType())])
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for ids in ([1, 1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id long").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").json(src)
        resume.append(resume.once(resume.results(spark, src, s), "id", "at"), out, ck).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_resume_of_old_and_returning_ids(spark, tmp_path):
    s = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType())])
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    runs = [[(1, "2024-01-01"), (2, "2024-01-10")], [(3, "2024-01-02"), (4, "2024-02-01")], [(1, "2024-02-02"), (4, "2023-01-01"), (5, "2020-01-01")], [(2, "2024-03-01"), (6, "2024-03-01")]]
    for rows in runs:
        spark.createDataFrame(rows, "id long, at string").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").json(src)
        resume.append(resume.once(resume.results(spark, src, s), "id", "at"), out, ck).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6]


def fields(spark, title, body, contents):
    got = one(spark, text.hit_fields(*(F.lit(x).cast("string") for x in (title, body, contents))))
    return got["title"], got["body"]


def test_hit_fields(spark):
    assert fields(spark, None, None, "One line only") == ("One line only", "")
    assert fields(spark, None, None, '\t"Title"\nbody text\n') == ("Title", "body text")
    assert fields(spark, "T", None, "whole\ncontents ") == ("T", "whole\ncontents")
    assert fields(spark, "T", " own ", "other") == ("T", "own")
    assert fields(spark, " T ", None, None) == ("T", "")
    assert fields(spark, None, "own", None) == ("Untitled", "own")
    assert fields(spark, None, None, "x" * 301 + "\nrest") == ("Untitled", "x" * 301 + "\nrest")
    assert fields(spark, None, None, '""\nrest') == ("Untitled", '""\nrest')
    assert fields(spark, None, None, "a\r\nb\x0bc\u2028d") == ("a", "b\nc\nd")


def test_evidence_grade(spark):
    grade = lambda titles, sentences: one(spark, text.evidence_grade(F.lit(True), F.lit(titles).cast("double"), F.lit(sentences).cast("double"), F.lit(True)))
    assert [grade(1.0, None), grade(1.0, 1.0), grade(1.0, 0.5), grade(0.5, 1.0), grade(0.0, 1.0), grade(None, None)] == ["A", "A", "B", "B", "C", "C"]


def test_fallback_answer(spark):
    assert one(spark, text.fallback_answer(F.lit("<answer>a</answer> or <ANSWER>\n b \n</ANSWER>"))) == "b"
    assert one(spark, text.fallback_answer(F.lit("nothing"))) is None


def shared_in_rounds(sizes, room):
    """What is left of a round's equal shares goes to the next round."""
    out = [0] * len(sizes)
    while room > 0 and (active := [i for i, s in enumerate(sizes) if out[i] < s]):
        share = max(1, room // len(active))
        for i in active:
            give = min(share, sizes[i] - out[i], room)
            out[i], room = out[i] + give, room - give
    return out


def test_water_fill():
    assert observation.water_fill([324, 42, 371], 134) == [46, 42, 46]
    rng = random.Random(1)
    for _ in range(2000):
        sizes = [rng.choice([0, rng.randint(1, 400)]) for _ in range(rng.randint(1, 3))]
        room = rng.randint(0, 900)
        assert observation.water_fill(sizes, room) == shared_in_rounds(sizes, room)


def test_observation_errors():
    fit = lambda *a, **k: observation.fitted(*a, observation.Characters(), **k)
    assert fit([], [])["error"] == "empty_search_result" and fit(["x" * 900], ["y"])["error"] == "observation_headers_exceed_budget"
    found = fit(["a", None, "c", "d"], ["1" * 600, " 2 ", "3" * 600, "4"])
    assert found["error"] is None and found["tokens"] <= 768 and [x["rank"] for x in found["documents"]] == [1, 2, 3]
    assert [x["body_truncated"] for x in found["documents"]] == [True, False, True] and found["documents"][1]["title"] == "Untitled"


def test_multiset_overlap(spark):
    rng = random.Random(2)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abce") for _ in range(rng.randint(0, 9))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text.overlap(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == sum((Counter(r["a"]) & Counter(r["b"])).values()) for r in got) and len(got) == 200


def test_quantiles_over_ranges(spark):
    rng = random.Random(4)
    rows = [(k % 3 or None, rng.choice([0, -5, 1, 2, 3, rng.randint(-50, 10**9)])) for k in range(3000)]
    got = {r["g"]: r for r in sampling.quantiles(spark.createDataFrame(rows, "g int, v long"), ["g"], "v", (0.0, 0.33, 0.5, 1.0)).collect()}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g)
        assert (r["n"], r["q0"], r["q33"], r["q50"], r["q100"]) == (len(v), v[0], v[round((len(v) - 1) * 0.33)], v[round((len(v) - 1) * 0.5)], v[-1])


def test_guards():
    head = dict.fromkeys(integrity.ROLLOUT_KEYS, 1)
    integrity.guard_resume(head, head | {"more": 2})
    for existing in (None, head | {"seed": 2}, {}):
        with pytest.raises(ValueError):
            integrity.guard_resume(existing, head)
    integrity.guard_output("/x/outputs/v3/y/run.jsonl", ("outputs", "v3"))
    with pytest.raises(ValueError):
        integrity.guard_output("/x/v3/outputs/run.jsonl", ("outputs", "v3"))
    assert integrity.drift({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == {"b": (2, 3), "c": (None, 4)}
    rows = [{"b": "é", "a": 1}, {"a": None}]
    text_ = '{"a": 1, "b": "é"}\n{"a": null}'
    assert integrity.canonical_hash(rows, False) == hashlib.sha256(text_.encode()).hexdigest()
    assert integrity.canonical_hash(rows, True) == hashlib.sha256((text_ + "\n").encode()).hexdigest()
    assert manifest.pool_seed(42, ("hotpotqa", "bridge", "hard")) == 42 + int(hashlib.sha256(b"hotpotqa/bridge/hard").hexdigest()[:8], 16)


def test_sinks(spark, tmp_path):
    s = T.StructType([T.StructField("id", T.LongType())])
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{oops\n')
    with pytest.raises(Exception, match=r"corrupt JSONL in .*bad.jsonl: \{oops"):
        jsonl.strict(spark, str(tmp_path / "bad.jsonl"), s).collect()
    (tmp_path / "good.jsonl").write_text('{"id": 1}\n \n{"id": 2}\n')
    assert sorted(r["id"] for r in jsonl.strict(spark, str(tmp_path / "good.jsonl"), s).collect()) == [1, 2]
    d = spark.createDataFrame([("b", 2, "train"), ("a", 1, "eval"), ("c", 3, "train")], "candidate_id string, search_action_count long, split string")
    jsonl.write_jsonl(d, str(tmp_path / "sorted"), ["split", "candidate_id"])
    assert [json.loads(x)["candidate_id"] for f in (tmp_path / "sorted").glob("part-*") for x in f.read_text().splitlines()] == ["a", "b", "c"]
    jsonl.write_jsonl(d, str(tmp_path / "plain"))
    assert jsonl.strict(spark, str(tmp_path / "plain"), d.schema).count() == 3
    wide = d.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in jsonl.TRAINING.fields if f.name not in d.columns))
    jsonl.write_splits(wide, str(tmp_path / "splits"), schema=jsonl.TRAINING)
    back = jsonl.read_counted(spark, str(tmp_path / "splits"), 3)
    assert back.columns[:-1] == jsonl.TRAINING.fieldNames() and dict(back.dtypes)["search_action_count"] == "smallint" and {r["split"] for r in back.collect()} == {"train", "eval"}
    with pytest.raises(ValueError, match="3 rows; 4"):
        jsonl.read_counted(spark, str(tmp_path / "splits"), 4)
    jsonl.write_descriptor(tmp_path / "dataset_info.json", {"one": "train.jsonl"})
    assert json.loads((tmp_path / "dataset_info.json").read_text()) == {"one": {"file_name": "train.jsonl", "formatting": "sharegpt", "columns": {"messages": "conversations"}}}
    m = jsonl.melted(spark.createDataFrame([("g", 1, 2.5)], "k string, a int, b double"), ["k"], ["a", "b"])
    assert sorted(tuple(r) for r in m.collect()) == [("g", "a", 1.0), ("g", "b", 2.5)]
    h = spark.createDataFrame([(1, "x")], "b int, a string")
    assert h.select(jsonl.row_hash(h).alias("h")).first()["h"] == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_best_f1_and_grounding(spark):
    assert one(spark, text.best_f1(F.lit("b c"), F.array(F.lit("x"), F.lit("c b d")))) == pytest.approx(0.8)
    assert one(spark, text.best_f1(F.lit("b"), F.array().cast("array<string>"))) == 0.0
    seen = F.array(F.lit("It was the New"), F.lit("York, of course."))
    assert one(spark, evidence.answer_grounded(F.lit("new york"), seen)) is True and one(spark, evidence.answer_grounded(F.lit("The"), seen)) is False


def test_document_key(spark):
    assert one(spark, text.document_key(F.lit("7"), F.lit("x"))) == "id:7"
    assert one(spark, text.document_key(F.lit(None).cast("string"), F.lit("x"))) == "content:" + hashlib.sha256(b"x").hexdigest()


def watched(folder):
    # made here, so that workers get it by value
    class Watched(observation.Characters):
        """Writes down by how many MB its process has grown since the first call."""

        def __init__(self, folder):
            self.folder, self.calls, self.first = str(folder), 0, None

        def encode(self, text):
            if self.calls % 100 == 0:
                import os

                with open("/proc/self/statm") as f:
                    now = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
                self.first = self.first or now
                with open(f"{self.folder}/{os.getpid()}", "a") as f:
                    f.write(f"{now - self.first}\n")
            self.calls += 1
            return super().encode(text)

    return Watched(folder)


def test_a_worker_holds_a_slice_of_the_tokens(spark, tmp_path):
    body = F.concat(F.lit(" "), F.repeat(F.lit("x"), 2000), F.col("id").cast("string"))
    c = compiled.compiled(F.array(compiled.piece(body, "generated", True)), watched(tmp_path))["token_count"]
    got = spark.range(0, 6000, 1, 1).select(c.alias("n")).agg(F.count("n").alias("n"), F.max("n").alias("most")).first()
    grown = [float(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert tuple(got) == (6000, 2005) and len(grown) > 50 and max(grown) < 80


def test_observations_come_in_slices_of_a_batch(monkeypatch):
    import pyarrow as pa

    calls, real = [], observation.fitted
    monkeypatch.setattr(observation, "fitted", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: lambda *columns: f(iter([columns])))
    titles, bodies = pa.array([["t", "u"]] * 1000), pa.array([["x" * 1500, None]] * 1000)
    out = observation.observation_column(titles, bodies)
    first = next(out)
    assert len(first) <= 200 and len(calls) == len(first)
    rest = [first, *out]
    assert sum(map(len, rest)) == 1000 and {x["tokens"] for part in rest for x in part.to_pylist()} == {768}


def test_missing_and_extra_keys_are_sorted_not_kept(spark, monkeypatch):
    monkeypatch.setattr(integrity, "TASK_ROWS", 100, raising=False)
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "id long").repartition(3)
    expected, actual = [*range(500), *range(50), None, None], [*range(100, 600), *[550] * 40, None]
    got = integrity.missing_and_extra(frame(expected), frame(actual), "id")
    want = [*((k, "missing") for k in range(100)), *((k, "extra") for k in range(500, 600)), (None, "missing"), (None, "extra")]
    assert sorted(map(tuple, got.select("id", "side").collect()), key=repr) == sorted(want, key=repr)
    assert not re.search(r"HashAggregate\(keys=\[id#\d+L?\]", got._jdf.queryExecution().executedPlan().toString())
    assert got.rdd.getNumPartitions() >= (len(expected) + len(actual)) // 100
