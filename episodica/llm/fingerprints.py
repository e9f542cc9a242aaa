"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of a growing dictionary: each phrase is the shortest piece that is new.
The phrases' hashes are a set, and the smallest of them are its signature; the share of the smallest of
two texts' hashes that both have estimates how much of their dictionaries they share, which is how well one
compresses the other.

An edited text keeps the front of its document, so it shares that part of the parse: only the edited tail
is parsed again.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pick, slices, struct, text_or_empty
from .repetition import DOWN, UP, spans

SIZE = 128
#: Documents that share a range of doc_id; more ranges than this many are never made.
RANGE_ROWS, MOST_RANGES = 2048, 20_000


def parse(text: str, seen: set[str], start: int = 0) -> list[int]:
    """Ends of the phrases from ``start`` on. ``seen`` holds the phrases before and gets the new ones. All
    shorter fronts of a phrase are phrases, so the search for its end may begin in the middle."""
    ends, n, i = [], len(text), start
    while i < n:
        j = i + 3
        if j > n:
            j = n
        p = text[i:j]
        if p in seen:
            while p in seen:
                if j == n:
                    return ends
                j += 1
                p = text[i:j]
        else:
            q = text[i : j - 1]
            while q and q not in seen:
                p = q
                j -= 1
                q = text[i : j - 1]
        seen.add(p)
        ends.append(j)
        i = j
    return ends


def signature(text: str, ends: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest distinct 32-bit phrase hashes, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points *= np.uint64(0xBF58476D1CE4E5B9)
    points ^= points >> np.uint64(31)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * UP.upto(len(points)), out=prefix[1:])
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    h = spans(prefix, starts, ends, DOWN.upto(len(points) + 1))
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The estimated share of common phrases: 1 for two empty texts, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float(np.count_nonzero(np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)) / len(both))


class Parsed:
    def __init__(self, doc_id: int | None, text: str, size: int):
        self.doc_id, self.text, self.size = doc_id, text, size
        self.seen: set[str] = set()
        self.ends = parse(text, self.seen)
        self.mark = signature(text, np.array(self.ends, np.int64), size) if text else np.zeros(0, np.uint32)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its signature. Uses up the dictionary."""
        n = len(self.text)
        cut = n - n // 4
        text = self.text[:cut] + following[: n // 4]
        if text == self.text:
            return text, self.mark
        keep = bisect_right(self.ends, cut)
        at = [0, *self.ends]
        for k in range(keep, len(self.ends)):
            self.seen.discard(self.text[at[k] : at[k + 1]])
        ends = self.ends[:keep] + parse(text, self.seen, at[keep])
        return text, signature(text, np.array(ends, np.int64), self.size)


def coded(mark: np.ndarray) -> str:
    return base64.b64encode(mark.astype("<u4").tobytes()).decode()


def fingerprint_documents(docs: DataFrame, size: int = SIZE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare both, and it with the next document's.

    The next document is that of the next doc_id (null first, rows of one doc_id by their text); after the last
    comes the first. Rows are dealt to ranges of doc_id and read in order; the first row of each range is
    also sent to the end of the range before it, so no range needs another.

    Null texts are empty; an empty text has no phrases: it is 1 like another empty one and 0 like any other. A
    table of one row is its own next. Repeated rows follow each other. An empty table gives no rows. A very long text
    is parsed whole by one task, which holds its phrases; the phrases of two documents at most are held at a time.
    All rows of one doc_id, and all without one, are read by one task, in a stream sorted on disk. Other columns, also of clashing names, are not read.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"), F.coalesce("doc_id", F.lit(least)).alias("at"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // range_rows))
    found = rows.select(F.percentile_approx("at", [k / ranges for k in range(1, ranges)] or [0.5], max(10_000, 10 * ranges)).alias("q")).first()["q"] or []
    borders = np.unique(np.array(found, np.int64)) if ranges > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, at.to_numpy(), "right").astype(np.int32))

    # The least doc_id of each range that has rows: as many rows as there are ranges.
    firsts = sorted((r["r"], r["least"]) for r in rows.groupBy(range_of("at").alias("r")).agg(F.min("at").alias("least")).collect())
    used = [r for r, _ in firsts]
    before = {least: used[k - 1] for k, (_, least) in enumerate(firsts)}
    starts = np.array(sorted(before), np.int64)
    to = np.array([before[x] for x in starts.tolist()], np.int64)

    @F.pandas_udf("array<int>")
    def places(at: pd.Series) -> pd.Series:
        """2 * range, and for the first of a range 2 * the range before + 1."""
        a = at.to_numpy()
        own = 2 * np.searchsorted(borders, a, "right")
        k = np.searchsorted(starts, a).clip(0, len(starts) - 1)
        also = np.where(starts[k] == a, 2 * to[k] + 1, -1)
        return pd.Series([np.array([x, y], np.int32) if y >= 0 else np.array([x], np.int32) for x, y in zip(own, also, strict=True)])

    schema = struct("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_phrases long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, held_range, out = None, None, []

        def pair(one, following):
            n_phrases = len(one.ends)
            text, mark = one.edited(following.text)
            return one.doc_id, len(one.text), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), coded(one.mark), coded(mark), likeness(one.mark, mark, size), likeness(one.mark, following.mark, size), n_phrases

        def batch_of(rows):
            return pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)

        for batch in batches:
            for part in slices(batch):
                for doc_id, text, place in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held is None and place & 1:
                        continue
                    current = Parsed(doc_id, text, size)
                    if held is not None and place >> 1 == held_range:
                        out.append(pair(held, current))
                    held, held_range = (None, None) if place & 1 else (current, place >> 1)
                    if len(out) >= 1024:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    dealt = rows.select("doc_id", "text", F.explode(places("at")).alias("place"))
    ordered = dealt.withColumn("r", F.shiftright("place", 1)).repartition("r").sortWithinPartitions("r", "place", "doc_id", "text")
    return ordered.select("doc_id", "text", "place").mapInArrow(run, schema)
