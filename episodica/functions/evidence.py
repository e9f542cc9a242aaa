"""How much of the gold evidence an episode's visible documents hold, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize, title_key


def share(part: Column, whole: Column) -> Column:
    """Null where there is nothing to find."""
    return part / F.nullif(whole, F.lit(0))


def title_coverage(gold: Column, visible: Column) -> Column:
    """struct(gold, matched, recall) of two arrays of titles, alike up to case and white space. Blank gold
    titles do not count; a null array is an empty one."""
    keys = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: title_key(F.coalesce(t, F.lit("")))))
    pair = F.struct(F.array_remove(keys(gold), "").alias("gold"), keys(visible).alias("seen"))

    def count(x: Column) -> Column:
        hit = F.array_sort(F.array_intersect(x["gold"], x["seen"]))
        return F.struct(F.size(x["gold"]).alias("gold"), hit.alias("matched"), share(F.size(hit), F.size(x["gold"])).alias("recall"))

    return let(pair, count)


def sentence_visibility(titles: Column, sentence_ids: Column, context: Column, visible: Column) -> Column:
    """struct(gold, visible, recall) of gold sentences, named by title and index.

    ``context``: array of (title, sentences), of equal titles the last counts; ``visible``: array of (title, text).
    A negative index counts from the end; one that is out of range, or a blank sentence, is no gold sentence. A
    sentence is visible if its normal form is within that of its title's visible text.
    """
    none = F.lit(None).cast("string")
    n = F.least(F.size(titles), F.size(sentence_ids))
    pairs = F.zip_with(F.slice(titles, 1, n), F.slice(sentence_ids, 1, n), lambda t, i: F.struct(title_key(t).alias("key"), i.alias("at")))

    def found(p: Column) -> Column:
        sentences = F.try_element_at(F.filter(context, lambda c: title_key(c["title"]) == p["key"]), F.lit(-1))["sentences"]
        place = F.when(p["at"] < 0, F.size(sentences) + p["at"]).otherwise(p["at"]).cast("int")
        sentence = F.coalesce(normalize(F.when(place >= 0, F.get(sentences, place))), none)
        text = normalize(F.array_join(F.transform(F.filter(visible, lambda v: title_key(v["title"]) == p["key"]), lambda v: v["text"]), " "))
        return F.struct(sentence.alias("s"), text.contains(sentence).alias("hit"))

    gold = F.filter(F.transform(pairs, found), lambda x: F.coalesce(x["s"], F.lit("")) != "")
    return let(gold, lambda g: F.struct(F.size(g).alias("gold"), F.size(F.filter(g, lambda x: x["hit"])).alias("visible"), share(F.size(F.filter(g, lambda x: x["hit"])), F.size(g)).alias("recall")))


def answer_grounded(answer: Column, evidence: Column) -> Column:
    """The normal form of the answer is not empty and is within that of the joined evidence (array of texts)."""
    return let(normalize(answer), lambda a: (a != "") & normalize(F.array_join(evidence, " ")).contains(a))
