"""Observations within a token budget.

A tokenizer is anything with ``encode(text) -> list[int]`` and ``decode(ids) -> str``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

OBSERVATION_TOKENS, TOP = 768, 3
#: Rows, and characters in them, that a Python worker has as objects at once. A longer row comes alone.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 18


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int]) -> str: ...


class Characters:
    """One token for each code point."""

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


def by_rows(f: Callable[..., Sequence], kind: T.StructType) -> Callable[..., Column]:
    """f of each row's values (arrays), which gives the fields of ``kind``, as a column. Batches are taken and given back in
    slices: beside the batch that has come, a worker holds one slice."""
    fields = list(to_arrow_type(kind))

    def made(rows: list[Sequence]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, a.type) for x, a in zip(zip(*rows, strict=True), fields, strict=True)], fields=fields)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows, chars = [], 0
            for row in zip(*columns, strict=True):
                values = [x.as_py() for x in row]
                size = sum(len(x) for v in values for x in v if isinstance(x, str))
                if rows and (len(rows) == SLICE_ROWS or chars + size > SLICE_CHARS):
                    yield made(rows)
                    rows, chars = [], 0
                rows.append(f(*values))
                chars += size
            if rows:
                yield made(rows)

    return F.arrow_udf(run, kind)


def water_fill(sizes: list[int], room: int) -> list[int]:
    """Share room evenly among what still wants some; what the division leaves goes to the first, one each."""
    out, open_ = [0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_ and room > 0:
        each = max(1, room // len(open_))
        for i in open_:
            give = min(each, sizes[i] - out[i], room)
            out[i] += give
            room -= give
        open_ = [i for i in open_ if out[i] < sizes[i]]
    return out


def fitted(titles: Sequence[str | None], bodies: Sequence[str | None], tokenizer: Tokenizer, budget: int = OBSERVATION_TOKENS, top: int = TOP) -> dict:
    """text, tokens, truncated and documents of the first ``top`` hits: all titles, and bodies cut to what the budget
    leaves; while the whole is too long, the longest body (the first of equals) loses a token. ``error`` instead:
    empty_search_result, observation_headers_exceed_budget or observation_cannot_fit_budget."""
    names = [(t or "").strip() or "Untitled" for t in titles[:top]]
    texts = [(b or "").strip() for b in bodies[:top]]
    ids = [tokenizer.encode(b) for b in texts]
    nothing = {"text": None, "tokens": None, "truncated": None, "documents": None}
    if not names:
        return nothing | {"error": "empty_search_result"}
    seen = lambda limits: [tokenizer.decode(x[:n]).strip() if n else "" for x, n in zip(ids, limits, strict=True)]

    def build(limits):
        parts = (f"Doc {k}(Title: {t})" + (f" {b}" if b else "") for k, (t, b) in enumerate(zip(names, seen(limits), strict=True), 1))
        return "\n".join(("<information>", *parts, "</information>"))

    size = lambda limits: len(tokenizer.encode(build(limits)))
    sizes = [len(x) for x in ids]
    if (heads := size([0] * len(ids))) > budget:
        return nothing | {"error": "observation_headers_exceed_budget"}
    limits = water_fill(sizes, budget - heads)
    while (n := size(limits)) > budget:
        if not any(limits):
            return nothing | {"error": "observation_cannot_fit_budget"}
        limits[max(range(len(limits)), key=lambda i: limits[i])] -= 1
    documents = [{"rank": k, "title": t, "original_text": b, "visible_text": v, "original_body_tokens": s, "visible_body_tokens": m, "body_truncated": m < s} for k, (t, b, v, s, m) in enumerate(zip(names, texts, seen(limits), sizes, limits, strict=True), 1)]
    return {"text": build(limits), "tokens": n, "truncated": limits != sizes, "documents": documents, "error": None}


def observation(titles: Sequence[str | None], bodies: Sequence[str | None], tokenizer: Tokenizer, budget: int = OBSERVATION_TOKENS) -> tuple[str, int, bool]:
    """(text, tokens, truncated) of all hits; raises where they do not fit."""
    found = fitted(titles, bodies, tokenizer, budget, len(titles))
    if found["error"]:
        raise ValueError(found["error"])
    return found["text"], found["tokens"], found["truncated"]


DOCUMENT = T.StructType([T.StructField("rank", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("title", "original_text", "visible_text")), *(T.StructField(c, T.IntegerType()) for c in ("original_body_tokens", "visible_body_tokens")), T.StructField("body_truncated", T.BooleanType())])
OBSERVATION = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("truncated", T.BooleanType()), T.StructField("documents", T.ArrayType(DOCUMENT)), T.StructField("error", T.StringType())])


def observation_column(titles: Column, bodies: Column, budget: int = OBSERVATION_TOKENS, tokenizer: Tokenizer | None = None, top: int = TOP) -> Column:
    """struct(text, tokens, truncated, documents, error), by Arrow batches: the cutting is sequential."""
    tok = tokenizer or Characters()

    def fill(t: list, b: list) -> list:
        found = fitted(t, b, tok, budget, top)
        return [found[c] for c in OBSERVATION.names]

    return by_rows(fill, OBSERVATION)(titles, bodies)
