"""The pipeline's stages, each against a plain version of what it decides on its own input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from oracle import DATA
from test_operators import brute_components, fill
from tokenizers import Tokenizer

from episodica.llm import langid
from episodica.llm.common import DOCUMENT_COLUMNS


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, DATA).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert tuple(docs.columns) == DOCUMENT_COLUMNS
        assert len(after) == docs.count() and all(before[i] == r for i, r in after.items())
        if name == "quality":
            assert all(len(re.findall("[^\x20\x09-\x0d]+", r["text"])) >= 50 for r in after.values()) and len(after) > 0.7 * len(before)
        elif name == "language":
            assert len(after) >= 0.98 * len(before)
        elif name == "dedup":
            found, _ = brute_components({i: r["text"] for i, r in before.items()}, 5)
            assert set(after) == set(found.values())
        else:
            words = lambda rows: sum(len(r["text"].split()) for r in rows.values())
            assert 0.75 * words(before) <= words(after) <= words(before)
    packs = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packs} == set(after)


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0


def test_dedup_of_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c, d, e, x, y, z = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(8))
    near = lambda t: t + " tail"
    rows = [(3, a), (7, a), (7, b), (1, x), (2, near(x)), (2, y), (9, c), (9, c), (8, near(c)), (5, d), (5, near(d)), (6, z), (6, ""), (None, a), (None, a), (None, e), (None, e), (None, None), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], schema)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    found, _ = brute_components({k: t or "" for k, (_, t) in enumerate(ordered)}, 5)
    want = sorted((-1 if i is None else i, t or "") for i, t in (ordered[k] for k in set(found.values())))
    for parts in (1, 7):
        out = pipeline.dedup(spark, docs.repartition(parts), DATA)
        assert tuple(out.columns) == DOCUMENT_COLUMNS
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in out.collect()) == want
    assert {(3, a), (7, b), (1, x), (2, y), (8, near(c)), (6, z), (6, ""), (-1, e), (-1, "")} <= set(want) and len(want) == 11


def test_mix_of_rows_without_ids(spark):
    """The budget holds where rows have no doc_id or share one; equal rows are decided one by one."""
    rows = [(None, "w " * 15) for _ in range(40)] + [(5, "w " * 15)] * 10 + [(k, "x " * 15) for k in range(100, 110)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.mix(spark, docs, DATA)
    assert tuple(out.columns) == DOCUMENT_COLUMNS and out.count() == 48


def test_stages_on_odd_tables(spark):
    """Nulls in all columns, empty and blank texts, repeated rows and columns of clashing names; then no rows at all."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(90))
    a, long = text(), " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, a, "en", "src0", 1), (1, a, "en", "src0", 1), (None, a, None, None, None), (None, None, None, None, None), (2, "", "en", None, 0), (3, " \n", None, "src1", 2), (4, long, "en", "src0", 9), (5, text(), None, None, None), (None, text(), "fr", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as row", "2 as TEXT", "3 as component_id", "4 as kept", "5 as n_tokens")
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert tuple(docs.columns) == DOCUMENT_COLUMNS, name
        sizes.append(docs.count())
    assert sizes[:3] == [6, 6, 4]
    packs = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(r["start"] == 0 for r in packs) == sizes[3]
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0), DATA).count() == 0, name


WORD = "[^\x20\x09-\x0d]+"


def plain_quality(text):
    words, chars = re.findall(WORD, text), len("".join(re.findall(WORD, text)))
    covered = {}
    for n in (3, 5, 7, 10):
        windows, seen, hit = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)], set(), set()
        count = Counter(windows)
        for k, x in enumerate(windows):
            if count[x] > 1 if n == 3 else x in seen:
                hit.update(range(k, k + n))
            seen.add(x)
        covered[n] = len(hit) if n == 3 else sum(len(words[k]) for k in hit)
    lines, repeated = set(), 0
    for line in (x for x in text.split("\n") if re.search(WORD, x)):
        repeated += len("".join(re.findall(WORD, line))) if line in lines else 0
        lines.add(line)
    most = {5: 0.15, 7: 0.13, 10: 0.10}
    return len(words) >= 50 and 2 * covered[3] <= len(words) and repeated <= 0.2 * chars and all(covered[n] <= m * chars for n, m in most.items())


def plain_mix(rows):
    """Budgets level by level, then each leaf's documents in the order of their digests until its rest is spent."""
    tokens = {i: len(re.findall(WORD, r["text"])) for i, r in rows.items()}
    path = {i: (f"domain{zlib.crc32(r['source'].encode()) % 4}", r["lang"], r["source"]) for i, r in rows.items()}
    supply = Counter()
    for i, p in path.items():
        for k in range(4):
            supply[p[:k]] += tokens[i]
    budget = {(): float(int(sum(tokens.values()) * pipeline.MIX_SHARE))}
    weights = pipeline.MIX_WEIGHTS
    for k in range(3):
        for parent in [p for p in supply if len(p) == k]:
            budget |= fill(budget[parent], {p: (supply[p], weights.get("/".join(p), weights.get(p[-1], 1.0))) for p in supply if p[:-1] == parent and len(p) == k + 1})
    leaves, taken = defaultdict(list), set()
    for i, p in path.items():
        leaves[p].append(i)
    for p, ids in leaves.items():
        rest = int(budget[p] + 1e-6)
        whole = int(rest >= supply[p])
        ids.sort(key=lambda i, whole=whole: hashlib.md5(f"20240:{whole}:{i}".encode()).hexdigest())
        taken |= {i for i, at in zip(ids, accumulate((tokens[i] for i in ids), initial=0)) if whole or at < rest}
    return taken


def assert_packed(packs, rows):
    library, cover = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in packs:
        cover[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(cover) == set(rows)
    for i, spans in cover.items():
        ids, at = np.array([*library.encode(rows[i]["text"], add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc in sorted(spans):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)


def test_stage_verdicts(spark):
    """The kept ids of each stage, and the rows of run(), by plain rules; languages by the same model on the driver."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality":
            want = {i for i, r in before.items() if plain_quality(r["text"])}
        elif name == "language":
            model = langid.train(docs)
            x = {i: langid.features(r["text"]) for i, r in before.items()}
            want = {i for i, v in x.items() if v is not None and model.predict(v)[1] >= langid.MIN_SCORE}
        elif name == "dedup":
            want = set(brute_components({i: r["text"] for i, r in before.items()}, 5)[0].values())
        else:
            want = plain_mix(before)
        docs = stage(spark, docs, DATA).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) == want, name
    assert 0 < len(after) < len(before)
    assert_packed(pipeline.STAGES[-1][1](spark, docs, DATA).collect(), after)
    assert_packed(pipeline.run(spark, DATA).collect(), after)
