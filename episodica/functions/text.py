"""Text functions of answers, queries and model actions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation, which normalization drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: An article that no letter, digit or underscore touches; the boundary of any regex engine would differ on accents.
ARTICLE = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
#: Tags of the action grammar.
TAGS = ("think", "search", "answer", "information")


def let(value: Column, f) -> Column:
    """f of a value that is made once, however often f uses it; lambdas would make it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}|{SPACE}\z", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize(c: Column) -> Column:
    """Lower case, without punctuation and articles, single spaces."""
    return collapse(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), ARTICLE, " "))


def fingerprint(c: Column) -> Column:
    """Lower case and single spaces; punctuation stays."""
    return collapse(F.lower(c))


def title_key(c: Column) -> Column:
    """Titles that differ in case alone are one, also in the letters that lower case leaves apart: final sigma, long and
    sharp s. (Ligatures and Greek letters with more than one mark stay as they are.)"""
    return collapse(F.replace(F.translate(F.lower(c), "\u03c2\u017f", "\u03c3s"), F.lit("\u00df"), F.lit("ss")))


def question_hash(c: Column) -> Column:
    return F.sha2(normalize(c).cast("binary"), 256)


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def exact_match(prediction: Column, golds: Column, guard: bool = True) -> Column:
    """Any gold equals the prediction after normalization. With the guard, empty matches nothing."""
    hit = lambda p: F.exists(golds, lambda g: normalize(g) == p) & ((p != "") if guard else F.lit(True))
    return F.coalesce(let(normalize(prediction), hit), F.lit(False))


def counted(a: Column) -> Column:
    """Sorted array of (token, n) of an array of tokens: what is equal stands together once it is sorted."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda k: F.transform(k, lambda at, j: F.struct(F.get(s, at).alias("token"), (F.coalesce(F.get(k, j + 1), n) - at).alias("n"))))

    return let(F.array_sort(a), runs)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets: each side is counted once, and both are merged."""

    def shared(m: Column) -> Column:
        places = F.when(F.size(m) > 1, F.sequence(F.lit(1), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        least = lambda i: F.when(F.get(m, i)["token"] == F.get(m, i - 1)["token"], F.least(F.get(m, i)["n"], F.get(m, i - 1)["n"])).otherwise(0)
        return F.aggregate(places, F.lit(0), lambda n, i: n + least(i))

    return let(F.array_sort(F.concat(counted(a), counted(b))), shared)


def token_f1(prediction: Column, gold: Column, both_empty: float = 0.0) -> Column:
    """Harmonic mean of token precision and recall. ``both_empty`` is what two empty sides score: 0 in the
    later protocol, 1 in the first."""


    def score(x):
        n, m = F.size(x["a"]), F.size(x["b"])
        return F.when((n == 0) & (m == 0), both_empty).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * overlap(x["a"], x["b"]) / (n + m))

    return let(F.struct(tokens(prediction).alias("a"), tokens(gold).alias("b")), score)


def best_f1(prediction: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def restore_think(c: Column) -> Column:
    """Put the opening tag first where there is only the closing one."""
    t = strip(c)
    return F.when(F.lower(t).contains("</think>") & ~F.lower(t).contains("<think>"), F.concat(F.lit("<think>"), t)).otherwise(t)


def parse_action(c: Column) -> Column:
    """struct(kind, think, content, canonical, error) of a model's turn: one think block, then one search or answer."""
    full = r"(?isu)\A\s*<think>(.*?)</think>\s*<(search|answer)>(.*?)</\2>\s*\z"
    text = F.coalesce(restore_think(c), F.lit(""))
    ok = text.rlike(full)
    part = lambda k: strip(F.regexp_extract(text, full, k))
    think, kind, content = part(1), F.lower(F.regexp_extract(text, full, 2)), part(3)
    inner = r"(?i)</?(think|search|answer|information)>"
    error = F.when(~ok, "strict_action_format_error").when(think == "", "empty_think").when(content == "", F.concat(F.lit("empty_"), kind)).when(think.rlike(inner) | content.rlike(inner), "forbidden_protocol_tag_in_action_content")
    good = error.isNull()
    canonical = F.concat(F.lit("<think>"), think, F.lit("</think><"), kind, F.lit(">"), content, F.lit("</"), kind, F.lit(">"))
    return F.struct(*(F.when(good, x).alias(name) for x, name in ((kind, "kind"), (think, "think"), (content, "content"), (canonical, "canonical"))), error.alias("error"))


def fallback_answer(c: Column) -> Column:
    """The last answer block of malformed text, stripped; null if there is none."""
    return strip(F.try_element_at(tag_contents(c, "answer"), F.lit(-1)))


def tag_contents(c: Column, tag: str) -> Column:
    """What all blocks of a tag hold, each stripped."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1)), strip)


def normalize_segment(c: Column) -> Column:
    """The first protocols' clean-up: tags in back quotes become bracketed words, and a turn that closes a think
    block without opening one is given the opener. Case matters."""
    t = F.regexp_replace(c, r"`<(/?(?:think|search|information|answer))>`", "[$1]")
    return F.when(t.contains("</think>") & ~t.contains("<think>"), F.concat(F.lit("<think>"), t)).otherwise(t)


def loose_action(c: Column) -> Column:
    """struct(kind, content) of the first protocols' action: any think block, even an empty one, then one search or
    answer, whose content may be empty and hold tags; both null if the text is no such thing."""
    block = r"(?isu)\A\s*<think>.*?</think>\s*(?:<search>(.*?)</search>|<answer>(.*?)</answer>)\s*\z"
    t = F.coalesce(c, F.lit(""))
    opened = F.regexp_extract(t, r"(?isu)\A\s*<think>.*?</think>\s*<(search|answer)>.*</\1>\s*\z", 1)
    said = F.concat(F.regexp_extract(t, block, 1), F.regexp_extract(t, block, 2))
    good = t.rlike(block)
    return F.struct(F.when(good, F.lower(opened)).alias("kind"), F.when(good, strip(said)).alias("content"))


def masked_turns(c: Column) -> Column:
    """Split a trace at its information blocks: array of (role, value), blocks as human, the rest as gpt; what is
    blank is left out, all else is stripped."""
    block = r"(?is)<information>.*?</information>"
    said = F.split(c, block)
    seen = F.regexp_extract_all(c, F.lit(f"({block})"), F.lit(1))
    pairs = F.flatten(F.transform(F.arrays_zip(said.alias("gpt"), seen.alias("human")), lambda x: F.array(F.struct(F.lit("gpt").alias("role"), strip(x["gpt"]).alias("value")), F.struct(F.lit("human").alias("role"), strip(x["human"]).alias("value")))))
    return F.filter(pairs, lambda x: F.coalesce(x["value"], F.lit("")) != "")


def masked_conversation(question: Column, trace: Column) -> Column:
    """struct(turns, error): the question as human, then the trace's masked turns, which must end with gpt."""
    turns = F.concat(F.array(F.struct(F.lit("human").alias("role"), question.alias("value"))), masked_turns(trace))
    ends = F.when(F.try_element_at(turns, F.lit(-1))["role"] != "gpt", "trajectory ends with evidence turn")
    return F.struct(F.when(ends.isNull(), turns).alias("turns"), ends.alias("error"))


def document_key(doc_id: Column, text: Column) -> Column:
    return F.when(F.coalesce(F.trim(doc_id), F.lit("")) != "", F.concat(F.lit("id:"), doc_id)).otherwise(F.concat(F.lit("content:"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)))


#: What ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def hit_fields(title: Column, text: Column, contents: Column) -> Column:
    """struct(title, body). Without a title, the first line of the contents is it, without quotes around, if it is
    neither empty nor longer than 300, and the other lines are the body; else all contents are. With a title, the
    contents are the body only where there is no text. No title at all is ``Untitled``."""
    given, own, raw = (F.coalesce(c, F.lit("")) for c in (strip(title), strip(text), contents))
    first = F.regexp_replace(strip(F.split(raw, LINE_END, 2)[0]), '\\A"+|"+\\z', "")
    others = F.coalesce(F.get(F.split(raw, LINE_END, 2), F.lit(1)), F.lit(""))
    lined = (given == "") & (raw != "") & (first != "") & (F.length(first) <= 300)
    whole = (raw != "") & ((given == "") | (own == ""))
    body = F.when(lined, strip(F.regexp_replace(others, LINE_END, "\n"))).when(whole, strip(raw)).otherwise(own)
    name = F.when(given != "", given).when(lined, first).otherwise("Untitled")
    return F.struct(name.alias("title"), body.alias("body"))


def hit_content(title: Column, text: Column, contents: Column, most: int = 1800) -> Column:
    """The first protocol's passage: the contents, else title and text in two lines, of which the first so many
    characters; null if there is nothing."""
    both = strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return F.left(F.nullif(F.coalesce(F.nullif(contents, F.lit("")), both), F.lit("")), F.lit(most))


def search_bucket(n: Column, zero: bool = True) -> Column:
    """zero, one, two, three_plus; selection knows no zero and calls it three_plus."""
    return F.when(n == 1, "one").when(n == 2, "two").when(F.lit(zero) & (n == 0), "zero").otherwise("three_plus")


def evidence_grade(multi_hop: Column, title_recall: Column, sentence_recall: Column, grounded: Column) -> Column:
    """A: all gold titles (one at least) and, where known, all sentences were seen; B: any title; C: none.
    Single-hop sources are grounded or ungrounded."""
    hop = F.when((title_recall == 1) & (F.coalesce(sentence_recall, F.lit(1.0)) == 1), "A").when(title_recall > 0, "B").otherwise("C")
    return F.when(multi_hop, hop).otherwise(F.when(grounded, "grounded").otherwise("ungrounded"))


#: Names of sources that mean another.
SOURCE_ALIASES = {"hotpot_qa": "hotpotqa", "natural_questions": "nq"}


def source_name(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SOURCE_ALIASES.items() for x in kv)), s), s)


def quality_bucket(source: Column, grade: Column, grounded: Column) -> Column:
    """The grade of the multi-hop source (none is C), else whether the answer is grounded."""
    return F.when(source_name(source) == "hotpotqa", F.coalesce(grade, F.lit("C"))).otherwise(F.when(grounded, "grounded").otherwise("ungrounded"))


def trajectory_tokens(prompts: Column) -> Column:
    """The longest of an episode's prompts, 0 if there is none."""
    return F.coalesce(F.array_max(prompts), F.lit(0))


def or_unknown(c: Column) -> Column:
    """Types and levels that are missing or empty are ``unknown``."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
