"""Traces compiled to tokens of which only what the model said is learnt.

The pieces of a trace are put together as columns; the tokenizer alone runs in Python, by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts, text
from .observation import Characters, Tokenizer, by_rows
from .sampling import quantiles

SEQUENCE_TOKENS = 8192
IGNORED = -100
#: The opener that the environment gives, and what stands between events.
OPENER, BETWEEN = "<think>\n", "\n\n"


def piece(value: Column, kind: str | Column, learnt: bool | Column = False) -> Column:
    return F.struct(value.alias("text"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(learnt) if isinstance(learnt, bool) else learnt).alias("supervised"))


def pieces(rendered: Column, events: Column, opener: bool = False, instruction: str | None = None, searches: int = 4) -> Column:
    """struct(pieces, error) of a rendered prompt and its events (array of (kind, text)).

    A prompt that ends in an opener takes that of a first generated event. With ``opener`` the environment gives each
    generated event after an observation its opener, and, with an ``instruction``, says it before an answer that comes
    after so many searches; both are masked like the prompt, the separators and the observations.
    """
    none = F.array().cast("array<struct<text:string,kind:string,supervised:boolean>>")
    strip_opener = lambda t: F.regexp_replace(t, r"(?i)\A\s*<think>", "")
    e = F.transform(events, lambda x: F.struct(x["kind"].alias("kind"), text.strip(F.coalesce(x["text"], F.lit(""))).alias("text"), F.when(x["kind"] == "generated", text.parse_action(x["text"])["kind"]).alias("action")))

    def laid(all_: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            generated, first = x["kind"] == "generated", k == 0
            after = F.get(all_, k - 1)["kind"] == "observation"
            given = F.lit(opener) & generated & ~first & F.coalesce(after, F.lit(False))
            body = F.when(given | (first & generated & rendered.rlike(r"(?i)<think>\s*\z")), strip_opener(x["text"])).otherwise(x["text"])
            out = [F.when(~first, F.array(piece(F.lit(BETWEEN), "separator"))).otherwise(none)]
            if opener and instruction:
                asked = F.size(F.filter(F.slice(all_, 1, k), lambda y: F.coalesce(y["action"] == "search", F.lit(False))))
                says = F.array(piece(F.lit(instruction.strip()), "final_answer_instruction"), piece(F.lit(BETWEEN), "separator"))
                out.append(F.when(F.coalesce(x["action"] == "answer", F.lit(False)) & (asked >= searches), says).otherwise(none))
            out.append(F.when(given, F.array(piece(F.lit(OPENER), "action_prefix"))).otherwise(none))
            return F.concat(*out, F.array(piece(body, x["kind"], generated)))

        bare = F.exists(F.transform(all_, lambda x, k: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), F.get(all_, k - 1)["kind"].alias("before"))), lambda x: F.coalesce((x["kind"] == "generated") & (x["before"] == "observation"), F.lit(False)) & ~x["text"].rlike(r"(?i)\A\s*<think>"))
        error = F.when(F.lit(opener) & bare, "generated_action_missing_canonical_think")
        return F.struct(F.concat(F.array(piece(rendered, "prompt")), F.flatten(F.transform(all_, one))).alias("pieces"), error.alias("error"))

    own = F.get(F.array_compact(F.transform(events, lambda x: prompts.event_error(x["kind"], x["text"]))), F.lit(0))
    done = text.let(F.coalesce(e, F.array().cast("array<struct<kind:string,text:string,action:string>>")), laid)
    return text.let(F.struct(own.alias("own"), done.alias("done")), lambda x: F.struct(x["done"]["pieces"].alias("pieces"), F.coalesce(x["own"], x["done"]["error"]).alias("error")))


def compile_pieces(texts: Sequence[str], learnt: Sequence[bool], tokenizer: Tokenizer, limit: int = SEQUENCE_TOKENS, ignored: int = IGNORED) -> tuple[list[int], list[int], list[int], str | None]:
    """(ids, labels, ends of the pieces, error) of a text's pieces."""
    ids: list[int] = []
    labels: list[int] = []
    ends: list[int] = []
    for t, flag in zip(texts, learnt, strict=True):
        own = tokenizer.encode(t)
        ids += own
        labels += own if flag else [ignored] * len(own)
        ends.append(len(ids))
    if tokenizer.encode("".join(texts)) != ids:
        return ids, labels, ends, "segment_tokenization_mismatch"
    return ids, labels, ends, "sequence_overflow" if len(ids) > limit else "empty_supervision" if all(x == ignored for x in labels) else None


ENCODED = T.StructType([*(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "labels", "ends")), T.StructField("error", T.StringType())])


def compiled(parts: Column, tokenizer: Tokenizer | None = None, limit: int = SEQUENCE_TOKENS, ignored: int = IGNORED) -> Column:
    """struct(input_ids, attention_mask, labels, token_count, supervised_token_count, spans, error) of pieces. Errors, with null
    for all else: segment_tokenization_mismatch (the pieces' tokens are not those of the whole text),
    sequence_overflow and empty_supervision."""
    tok = tokenizer or Characters()

    def encode(texts: list, learnt: list) -> tuple:
        *numbers, error = compile_pieces(texts, learnt, tok, limit, ignored)
        return (None, None, None, error) if error else (*(np.array(x, np.int32) for x in numbers), None)

    c = by_rows(encode, ENCODED)(F.transform(parts, lambda p: p["text"]), F.transform(parts, lambda p: p["supervised"]))

    def whole(x: Column) -> Column:
        ok = x["error"].isNull()
        spans = F.transform(F.arrays_zip(parts.alias("p"), x["ends"].alias("end")), lambda y, k: F.struct(y["p"]["kind"].alias("kind"), F.coalesce(F.get(x["ends"], k - 1), F.lit(0)).alias("start"), y["end"].alias("end"), y["p"]["supervised"].alias("supervised")))
        return F.struct(
            x["input_ids"].alias("input_ids"),
            F.transform(x["input_ids"], lambda i: F.lit(1).cast("tinyint")).alias("attention_mask"),
            x["labels"].alias("labels"),
            F.when(ok, F.size(x["input_ids"])).alias("token_count"),
            F.when(ok, F.size(F.filter(x["labels"], lambda y: y != ignored))).alias("supervised_token_count"),
            F.when(ok, spans).alias("spans"),
            x["error"].alias("error"),
        )

    return text.let(c, whole)


def mask_error(c: Column, ignored: int = IGNORED) -> Column:
    """What is wrong with the masks of a compiled trace: tensor_length_mismatch, masked_span_supervised or
    generated_span_masked; null if nothing is, or nothing was compiled."""
    n = F.size(c["input_ids"])
    own = lambda s: F.slice(c["labels"], s["start"] + 1, s["end"] - s["start"])
    return (
        F.when(c["input_ids"].isNull(), None)
        .when((n != F.size(c["labels"])) | (n != F.size(c["attention_mask"])), "tensor_length_mismatch")
        .when(F.exists(c["spans"], lambda s: ~s["supervised"] & F.exists(own(s), lambda x: x != ignored)), "masked_span_supervised")
        .when(F.exists(c["spans"], lambda s: s["supervised"] & F.exists(own(s), lambda x: x == ignored)), "generated_span_masked")
    )


def span_tokens(c: Column, *kinds: str) -> Column:
    """Tokens in spans of these kinds: ``observation`` is the information, ``prompt`` and ``separator`` the prompt."""
    of = F.filter(c["spans"], lambda s: s["kind"].isin(*kinds))
    return F.aggregate(F.coalesce(of, F.array().cast("array<struct<kind:string,start:int,end:int,supervised:boolean>>")), F.lit(0), lambda n, s: n + s["end"] - s["start"])


LENGTHS = (0.5, 0.9, 0.95, 0.99, 1.0)


def split_statistics(rows: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """split, metric, value: of each split, counts, means, nearest-rank quantiles of the lengths, and how many rows each value
    of ``labels`` has. ``rows``: split, token_count, supervised_token_count, information_token_count."""
    n = F.col("token_count")
    g = rows.groupBy("split").agg(
        F.count("*").cast("double").alias("count"),
        F.avg(n).alias("mean_tokens"),
        F.avg("supervised_token_count").alias("mean_supervised_tokens"),
        F.avg(F.col("supervised_token_count") / n).alias("mean_supervised_fraction"),
        F.avg("information_token_count").alias("mean_information_tokens"),
        F.avg(F.col("information_token_count") / n).alias("mean_information_mask_fraction"),
    )
    out = g.unpivot(["split"], [c for c in g.columns if c != "split"], "metric", "value")
    q = quantiles(rows, ["split"], "token_count", LENGTHS).drop("n")
    out = out.union(q.select("split", *(F.col(c).cast("double").alias(c) for c in q.columns if c != "split")).unpivot(["split"], [c for c in q.columns if c != "split"], "metric", "value"))
    for c in labels:
        out = out.union(rows.groupBy("split", c).agg(F.count("*").cast("double").alias("value")).select("split", F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("None"))).alias("metric"), "value"))
    return out
