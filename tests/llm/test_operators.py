"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import DATA, duck, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episodica.llm import chat, fingerprints, langid, licenses, mixing, neardup, packing, repetition, sharding, tokencount
from episodica.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "fingerprints": fingerprints.fingerprint_documents,
    "tokens": lambda d: tokencount.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), with_prefixes=True),
    "quality": repetition.repetition_quality,
    "language": langid.predict_languages,
    "mix": mixing.select_mix,
    "shards": sharding.shard_documents,
    "packs": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json"), with_ids=True),
    "licenses": licenses.scan_licenses,
    "duplicates": neardup.near_duplicates,
}


def odd_rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    long = " ".join(rng.choices(words, k=40_000))
    base = " ".join(rng.choices(words, k=80))
    texts = [None, "", " \n\t", "one", "a b", base, base, base + " x", long, "é中\U0001f600 <|endoftext|> it's  12\n\n ok", "!!!", "MIT license " * 3]
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, 1), (None, None, None, None, None), (7, "other text of the same id", "de", "s1", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(odd_rows(), SCHEMA)
    # Columns whose names clash with outputs, inputs in another case, and working names.
    return d.select("*", *(F.lit(1).alias(c) for c in ("TEXT", "kept", "key", "n_tokens", "shard", "range", "component_id", "at", "domain", "window")))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    out = OPERATORS[name](odd).collect()
    docs = [r["doc_id"] for r in out]
    if name == "mix":
        assert set(docs) <= {r[0] for r in odd_rows()}
    elif name == "packs":
        assert Counter(r["doc_id"] for r in out if r["start"] == 0) == Counter(r[0] for r in odd_rows())
    else:
        assert Counter(docs) == Counter(r[0] for r in odd_rows())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_odd_values(spark, odd):
    """What the operators say of null, blank, long, repeated and odd texts, row by row."""
    texts = defaultdict(list)
    for r in odd_rows():
        texts[r[0]].append(r[1] or "")
    byte, word = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))

    def same(name, columns, of):
        got, want = defaultdict(list), {}
        for r in OPERATORS[name](odd).collect():
            if name != "packs" or r["start"] == 0:
                got[r["doc_id"]].append(tuple(r[c] for c in columns))
        for i, found in texts.items():
            want[i] = sorted(map(of, found))
        assert {i: sorted(x) for i, x in got.items()} == want, name

    same("tokens", ("n_bytes", "n_tokens"), lambda t: (len(t.encode()), len(byte.encode(t, add_special_tokens=False).ids)))
    same("packs", ("doc_tokens",), lambda t: (len(word.encode(t, add_special_tokens=False).ids) + 1,))
    same("quality", ("n_words", "word_chars"), lambda t: (len(w := re.findall("[^\x20\x09-\x0d]+", t)), sum(map(len, w))))
    same("licenses", ("n_words", "n_base"), lambda t: (len(w := re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())), sum(w[k : k + 2] == ["mit", "license"] for k in range(len(w)))))
    same("shards", ("size", "text_crc32"), lambda t: (len(t.encode()) + 1, zlib.crc32(t.encode())))
    same("fingerprints", ("n_chars",), lambda t: (len(t),))


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def collected(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_fingerprints(spark, docs):
    found = {r["doc_id"]: r for r in collected(spark, "op1_fingerprints")}
    ids = sorted(docs)
    marks = defaultdict(set)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, cut = docs[a], len(docs[a]) // 4
        edited = t[: len(t) - cut] + docs[b][:cut]
        assert found[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        seen: set[str] = set()
        assert fingerprints.signature(edited, np.array(fingerprints.parse(edited, seen))).tobytes() == np.frombuffer(__import__("base64").b64decode(found[a]["edited_fingerprint"]), "<u4").tobytes()
        marks[t].add(found[a]["fingerprint"])
        assert 0 <= found[a]["near_next"] <= 1
    assert all(len(x) == 1 for x in marks.values())
    assert np.mean([r["near_edited"] - r["near_next"] for r in found.values()]) > 0.3


def phrases(text):
    out, seen, i = [], set(), 0
    for j in range(1, len(text) + 1):
        if text[i:j] not in seen:
            seen.add(text[i:j])
            out.append(j)
            i = j
    return out


def plain_mark(text):
    """The 128 smallest phrase hashes, in plain integers."""
    top, base, out, i = (1 << 64) - 1, 0x9E3779B97F4A7C15, set(), 0
    for end in phrases(text):
        h, power = 0, 1
        for c in text[i:end]:
            x = ord(c) * 0xBF58476D1CE4E5B9 & top
            h = (h + (x ^ x >> 31) * power) & top
            power = power * base & top
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & top
        h ^= h >> 29
        h = (h + (end - i) * 0xA0761D6478BD642F) & top
        out.add((h * 0x94D049BB133111EB & top) >> 32)
        i = end
    return sorted(out)[:128]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted({*a, *b})[:128]
    return sum(x in set(a) and x in set(b) for x in both) / len(both)


def test_fingerprints_by_plain_integers(spark, docs):
    import base64

    found = {r["doc_id"]: r for r in collected(spark, "op1_fingerprints")}
    ids = sorted(docs)
    for a, b in list(zip(ids, ids[1:] + ids[:1], strict=True))[::5]:
        t, cut = docs[a], len(docs[a]) // 4
        own, edited, following = plain_mark(t), plain_mark(t[: len(t) - cut] + docs[b][:cut]), plain_mark(docs[b])
        assert np.frombuffer(base64.b64decode(found[a]["fingerprint"]), "<u4").tolist() == own
        assert np.frombuffer(base64.b64decode(found[a]["edited_fingerprint"]), "<u4").tolist() == edited
        assert (found[a]["near_edited"], found[a]["near_next"]) == (plain_likeness(own, edited), plain_likeness(own, following))


def test_parse(docs):
    assert all(fingerprints.parse(t, set()) == phrases(t) for t in [*docs.values(), "", "aaaaaaa", "abababab"])


def test_stored_all():
    """Whole slices of odd texts, prefix by prefix, as the library counts them."""
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(12)
    library, counter = Tokenizer.from_file(path), tokencount.PrefixCounter(path)
    parts = [*" \n\t\r\x0b\x00'srevlldmtaZé1２!< 　\xa0\u2028語", "<|endoftext|>", "  ", "   ", "'re", "\n ", " \n", " the", " the", " and", "x" * 50, "語" * 90, "!?" * 300, " \x85 "]
    for _ in range(120):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(6)]
        counts, at = counter.stored_all(pa.array(["shift me", *texts])[1:])
        for t, a, b in zip(texts, at, at[1:], strict=False):
            assert counts[a:b].tolist() == counter.prefixes(t)
            ends = range(len(t) + 1) if len(t) < 60 else (len(t),)
            assert [counts[a + k] for k in ends] == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in ends]


def test_stored_prefix_counts(spark, docs):
    library, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    rows = collected(spark, "op2_token_counts")
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        t, at = docs[r["doc_id"]], np.frombuffer(r["prefix_counts"], "<u4")
        assert len(at) == len(t) + 1 and r["n_tokens"] == at[-1] and r["fit_chars"] == max(k for k, c in enumerate(at) if c <= 1024)
        for k in (0, 1, len(t), r["fit_chars"], *(rng.randint(0, len(t)) for _ in range(4))):
            assert k > len(t) or at[k] == len(library.encode(t[:k], add_special_tokens=False).ids)
    counter = tokencount.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [*" \n\t'srevlldmtaZé1２!< 　語\x1c", "<|endoftext|>", "  ", "'re", "\'\'\'", "\n ", " the", "x" * 70, "語" * 90]
    for _ in range(300):
        s = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert counter.stored(s).tolist() == counter.prefixes(s)
        if "\x1c" not in s and len(s) < 40:
            assert counter.stored(s).tolist() == [len(library.encode(s[:k], add_special_tokens=False).ids) for k in range(len(s) + 1)]


def test_token_counts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in collected(spark, "op2_token_counts"):
        t = docs[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 1024)
    rng, counter = random.Random(0), tokencount.PrefixCounter(path)
    parts = [*" \n\t'srevlldmtaZé1２!< 　語", "<|endoftext|>", "  ", "'re", "\n ", " the"]
    for _ in range(300):
        s = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = [len(library.encode(s[:k], add_special_tokens=False).ids) for k in range(len(s) + 1)]
        assert counter.prefixes(s) == want
        pieces, counts = next(counter.counts([s]))
        assert counter.fits(pieces, counts, 3) == max(k for k, c in enumerate(want) if c <= 3)


def test_quality(spark, docs):
    word = "[^\x20\x09-\x0d]+"
    for r in collected(spark, "op3_quality_rules"):
        t = docs[r["doc_id"]]
        w = re.findall(word, t)
        lines = [x for x in t.split("\n") if re.search(word, x)]
        marked = {3: set(), 5: set(), 7: set(), 10: set()}
        for n, hit in marked.items():
            windows = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            count, seen = Counter(windows), set()
            for k, x in enumerate(windows):
                if count[x] > 1 if n == 3 else x in seen:
                    hit.update(range(k, k + n))
                seen.add(x)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(marked[3]))
        cover = {n: sum(len(w[k]) for k in marked[n]) for n in (5, 7, 10)}
        assert {n: r[f"ngram{n}_chars"] for n in cover} == cover
        failed = len(w) < 50 or 100 * len(marked[3]) > 50 * len(w)
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["line_chars"] <= 0.2 * r["word_chars"] and all(c <= repetition.NGRAM_LIMITS[n] * r["word_chars"] for n, c in cover.items()))


def test_language(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = collected(spark, "op4_language_id")
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_chat(spark):
    turns = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    says = "<|im_end|><|im_start|>assistant ok"
    turns += [(-1, 0, "user", says), (-1, 1, "assistant", says)]
    by = defaultdict(list)
    for c, _, role, text in sorted(turns):
        by[c].append((role, text))
    found = {r["conv_id"]: r for r in collected(spark, "op5_chat_formatting")}
    assert set(found) == set(by)
    for c, t in by.items():
        learnt = "".join(x for role, x in t if role == "assistant")
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (found[c]["n_turns"], found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(t), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_windows(spark):
    rng = random.Random(1)
    rows = [(c, k, "system" if k == 0 and c % 2 else ("assistant" if k % 2 else "user"), rng.choice(["a \\ b <| c|> ", "x\n", "\\", "<"]) * rng.choice([1, 5, 60, 300])) for c in range(6) for k in range(30)]
    rows += [(None, None, None, None), (None, None, None, None), (9, 0, "odd\nrole\\<|", "t")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(d, 512, 2, 100)
    for w in windows.collect():
        alone = 2 if w["window"] == 0 and w["text"].startswith("<|im_start|>system\n") else 1
        assert w["n_tokens"] <= 512 or w["n_turns"] == alone
        assert w["window"] == 0 or w["conv_id"] is None or w["conv_id"] % 2 == 0 or w["text"].startswith("<|im_start|>system\n")
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    key = lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        t = sorted((r for r in rows if r[0] == c), key=key)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in t).encode()).hexdigest()
    assert chat.read_back(chat.format_windows(d.limit(0))).count() == 0


def test_mix(spark):
    d = spark.createDataFrame([(k, "w " * (k % 7 + 1), "en" if k % 3 else "de", f"s{k % 5}", 0) for k in range(300)], SCHEMA)
    rows = mixing.select_mix(d, 0.7, {"en": 3.0, "s1": 2.0}, max_epochs=2).collect()
    total = sum(k % 7 + 1 for k in range(300))
    by = defaultdict(list)
    for r in rows:
        by[r["domain"], r["lang"], r["source"]].append(r)
    assert all(sum(r["take_tokens"] for r in x) == x[0]["leaf_budget"] for x in by.values())
    assert abs(sum(x[0]["leaf_budget"] for x in by.values()) - int(total * 0.7)) <= len(by)
    assert max(Counter((r["doc_id"], r["epoch"]) for r in rows).values()) == 1


def fill(budget, kids):
    """Shares by weight up to supply, by rounds."""
    out = dict.fromkeys(kids, 0.0)
    open_ = set(kids)
    while open_ and budget > 1e-9:
        w = sum(kids[k][1] for k in open_)
        full = {k for k in open_ if kids[k][0] - out[k] <= budget * kids[k][1] / w}
        for k in full or open_:
            give = kids[k][0] - out[k] if full else budget * kids[k][1] / w
            out[k] += give
            budget -= give if full else 0
        if not full:
            break
        open_ -= full
    return out


def test_mix_budgets(spark):
    leaves = [("a", "en", "x", 100), ("a", "en", "y", 10), ("a", "de", "x", 5), ("b", "en", "x", 7), ("b", "fr", "z", 900)]
    got = {tuple(r[:3]): r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 0.5, {"fr": 0.25}, 1).collect()}
    top = fill(511, {"a": (115, 1), "b": (907, 1)})
    a, b = fill(top["a"], {"en": (110, 1), "de": (5, 1)}), fill(top["b"], {"en": (7, 1), "fr": (900, 0.25)})
    en = fill(a["en"], {"x": (100, 1), "y": (10, 1)})
    want = {("a", "en", "x"): en["x"], ("a", "en", "y"): en["y"], ("a", "de", "x"): a["de"], ("b", "en", "x"): b["en"], ("b", "fr", "z"): b["fr"]}
    assert got == {k: int(v + 1e-6) for k, v in want.items()}


def test_mix_query(spark):
    """The query's rows, each leaf read document by document in the order of its epochs' digests."""
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    tokens = {i: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for i, r in rows.items()}
    path = {i: (f"domain{zlib.crc32((r['source'] or '').encode()) % 4}", r["lang"] or "", r["source"] or "") for i, r in rows.items()}
    supply = Counter()
    for i, p in path.items():
        for k in range(4):
            supply[p[:k]] += 2 * tokens[i]
    budget, weights = {(): float(int(sum(tokens.values()) * 0.6))}, {"en": 3.0, "domain1": 0.5, "src0": 2.0}
    for k in range(3):
        for parent in [p for p in supply if len(p) == k]:
            budget |= fill(budget[parent], {p: (supply[p], weights.get("/".join(p), weights.get(p[-1], 1.0))) for p in supply if p[:-1] == parent and len(p) == k + 1})
    want = set()
    for p in set(path.values()):
        spent, most = 0, int(budget[p] + 1e-6)
        for epoch in range(2):
            for i in sorted((i for i in rows if path[i] == p), key=lambda i, e=epoch: hashlib.md5(f"20240:{e}:{i}".encode()).hexdigest()):
                if spent < most:
                    want.add((i, epoch, spent, min(tokens[i], most - spent), most))
                    spent += tokens[i]
    got = collected(spark, "op6_mixing")
    assert {(r["doc_id"], r["epoch"], r["position"], r["take_tokens"], r["leaf_budget"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == tokens[r["doc_id"]] and (r["domain"], r["lang"], r["source"]) == path[r["doc_id"]] for r in got)


def test_mix_without_ids(spark):
    """Rows without doc_id, and rows that share one, count each: budgets are spent exactly, in whole epochs and in part."""
    d = spark.createDataFrame([(None if k % 2 else k % 4, "w " * (k % 7), "en", "s0", 0) for k in range(200)], SCHEMA)
    rows = mixing.select_mix(d, 1.5, max_epochs=2).collect()
    total = sum(k % 7 for k in range(200))
    assert sum(r["take_tokens"] for r in rows) == rows[0]["leaf_budget"] == int(total * 1.5)
    assert max(Counter((r["row"], r["epoch"]) for r in rows).values()) == 1 and sum(r["epoch"] == 0 for r in rows) == 200
    at = sorted((r["position"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))


def test_shards(spark, docs):
    rows = collected(spark, "op7_sharding")
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    most = max(len(t.encode()) for t in docs.values())
    assert max(size.values()) - min(size[k] for k in range(16)) <= 2 * most


def test_shards_against_order(spark):
    """The law by brute force: records in order of their keys, each in the shard that holds its group's middle, or, of a
    group over a fiftieth of a shard, its own."""
    rng = random.Random(6)
    texts = [("c" * 9_000 if k % 5 == 0 else f"t{k % 700}" * rng.randint(1, 40)) for k in range(3000)]
    d = spark.createDataFrame([(k if k % 11 else None, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA)
    got = Counter((r["doc_id"], r["size"], r["shard"]) for r in sharding.shard_documents(d).collect())
    keyed = sorted((hashlib.md5(t.encode()).hexdigest(), f"{k:016x}" if k % 11 else "~", k if k % 11 else None, len(t) + 1) for k, t in enumerate(texts))
    total, at, groups = sum(x[3] for x in keyed), 0, defaultdict(list)
    for digest, _, i, size in keyed:
        groups[digest].append((at, i, size))
        at += size
    want = Counter()
    for rows in groups.values():
        whole = sum(x[2] for x in rows)
        for start, i, size in rows:
            middle = 2 * rows[0][0] + whole if whole <= 0.02 * total / 16 else 2 * start + size
            want[i, size, min(15, middle * 16 // (2 * total))] += 1
    assert got == want


def test_shards_hot(spark):
    d = spark.createDataFrame([(k, "hot" if k % 3 else f"t{k}", None, None, 0) for k in range(6000)], SCHEMA)
    rows = sharding.shard_documents(d).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(rows) == 6000 and max(size.values()) <= 1.05 * min(size.values())


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    cover, place = defaultdict(list), defaultdict(list)
    for r in collected(spark, "op8_packing"):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, end in [*((v, len(ids[k])) for k, v in cover.items()), *((v, None) for v in place.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert end is None or at == end
    lengths = [sum(n for _, n in v) for v in place.values()]
    assert set(cover) == set(ids) and max(lengths) <= 4096 and all(n & (n - 1) == 0 for n in lengths)


def test_word_ids():
    """Ids of odd texts, as the library gives them for the whole text."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(11)
    library, words = Tokenizer.from_file(path), packing.WordIds(path)
    parts = [*" \n\t\r\x0b\x0c\x1c'sStTrReEvVlLmMdD09aZé×÷ßÿÀµİſK!<>|_-~\xa0\u0301\u2003\u3000語²½", "'re", "'LL", "<|endoftext|>", "<|", "|>", "e\u0301", "\r\n", " the", "</w>", "x" * 50, "語" * 30]
    for _ in range(300):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(10)]
        ids, bounds = words.of(pa.array(["shift me", *texts])[1:])
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan():
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.choice([1, 5, 300, 700, 2049, 4096, 9000]) for _ in range(rng.randint(0, 40))]
        sequences = packing.plan(lengths)
        seen = Counter()
        for s in sequences:
            assert 0 < sum(x[2] for x in s) <= 4096
            for d, start, n in s:
                seen.update((d, k) for k in range(start, start + n))
        assert len(seen) == sum(lengths) and max(seen.values(), default=1) == 1


def test_licenses(spark, docs):
    for r in collected(spark, "op9_license_scans"):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]])
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        found = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def license_words(rng, vocabulary):
    """Notices, changed and spread ones among other words."""
    words = []
    while len(words) < rng.randint(0, 400):
        t = rng.choice(licenses.TEMPLATES)[1].split()
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t[k:k] = rng.choices(vocabulary, k=rng.choice((5, 30, 50)))
        words += t if rng.random() < 0.4 else rng.choices(vocabulary, k=9)
    return [x.encode() for x in words]


def test_license_join_is_exact():
    """Against every block that starts at any word."""
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    frequency = Counter(tuple(x.encode() for x in rng.choices(vocabulary, k=2)) for _ in range(500))
    index = licenses.Index(licenses.TEMPLATES, 0.8, frequency, 64)
    joined = 0
    for _ in range(60):
        words = license_words(rng, vocabulary)
        got = index.matches(words)
        joined += len(got)
        for t, (_, notice) in enumerate(licenses.TEMPLATES):
            x = licenses.shingles_of(licenses.words_of(notice))
            size = max(64, -(-3 * len(notice.split()) // 2))
            held = {p: len(x & licenses.shingles_of(words[p : p + size])) / len(x) for p in range(len(words))}
            want = {p: c for p, c in held.items() if c >= 0.8 - 1e-9}
            mine = [(a, b, c) for a, b, k, c in got if k == t]
            assert max((c for *_, c in mine), default=0) == max(want.values(), default=0)
            for a, b, c in mine:
                assert b - a <= size and len(x & licenses.shingles_of(words[a:b])) / len(x) == c >= 0.8 - 1e-9
            starts = sorted(want)
            assert len(mine) >= sum(k == 0 or p - starts[k - 1] > size for k, p in enumerate(starts))
    assert joined > 50


def test_license_labels(spark):
    body = dict(reversed([(label, t) for label, t in licenses.TEMPLATES]))
    full = {label: max((t for x, t in licenses.TEMPLATES if x == label), key=len) for label in body}
    isc = next(t for label, t in licenses.TEMPLATES if label == "isc").split()
    spread = " ".join([*isc[:10], *(f"z{k}" for k in range(40)), *isc[10:]])
    texts = [*full.values(), *(f"{'q ' * k}{spread}" for k in (0, 16, 31)), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "licensed under nothing", None, ""]
    d = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    # These two hold a phrase of the general one, whose label stays.
    assert [got[k]["labels"] for k in range(len(full))] == [{"lgpl": "gpl,lgpl", "agpl": "agpl,gpl"}.get(x, x) for x in full]
    assert [got[len(full) + k]["labels"] for k in range(8)] == ["isc", "isc", "isc", "cc-by-nc", "cc-by", "", "", ""]
    assert all((r["score"] > 0) == bool(r["labels"]) for r in got.values())


def brute_components(texts, words=2, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_duplicates(spark, docs):
    want, sizes = brute_components(docs)
    got = {r["doc_id"]: r for r in collected(spark, "op10_near_duplicates")}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_duplicate_buckets_in_blocks(spark, monkeypatch):
    """Buckets that are split into many blocks lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng, texts = random.Random(8), {}
    for family in range(2):
        base = [f"f{family}w{k}" for k in range(120)]
        for _ in range(70):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.randint(3, 11)):
                w[k] = f"r{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], SCHEMA)
    want = brute_components(texts)[0]
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, words=2).collect()} == want and 2 < len(set(want.values())) < 140


def test_duplicate_families(spark):
    """Families whose members are near the threshold to each other, so that chains matter."""
    rng = random.Random(5)
    texts = {}
    for family in range(4):
        base = [f"f{family}w{rng.randrange(200)}" for _ in range(120)]
        for _ in range(60):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.randint(0, 9)):
                w[k] = f"r{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, words=2).collect()}
    assert got == brute_components(texts)[0]
