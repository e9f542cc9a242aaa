"""Quality rules by repetition coverage.

Rolling hashes in numpy give each word, each line and each window of n words a 64-bit value; sorting them
finds those that a text has before, and the code points of the words that they cover are added up. Texts
are judged one at a time in the task that reads them: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import accepted, map_slices, pick, text_or_empty

#: Most of the word characters that repeated windows of so many words may cover.
NGRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Most of the word characters that repeated lines may hold.
LINE_LIMIT = 0.20
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of a 64-bit number, as many as were asked for so far; long runs are not kept."""

    def __init__(self, base: int, keep: int = 1 << 20):
        self.base, self.keep, self.known = np.uint64(base), keep, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.known):
            grown = np.full(max(n, min(self.keep, 2 * len(self.known))), self.base, np.uint64)
            grown[0] = 1
            np.multiply.accumulate(grown, out=grown)
            if n > self.keep:
                return grown[:n]
            self.known = grown
        return self.known[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)
#: A random 64-bit value for each byte.
MIX = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from sums of value[i] * BASE^i: moved down to exponent 0, then mixed."""
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * UP.upto(len(values)), out=out[1:])
    return out


def seen_before(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash whether it is there twice or more, and whether an equal one stands before it."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def covered(marks: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words in a marked window of n words."""
    edges = np.zeros(words + 1, np.int64)
    edges[: len(marks)] += marks
    edges[n : n + len(marks)] -= marks
    return np.cumsum(edges[:-1]) > 0


def measure(text: str, lengths: tuple[int, ...]) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters of repeated lines, characters
    covered by repeated windows of each length)."""
    raw = text.encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8)
    symbols = sum(raw.count(c) for c in SYMBOLS)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return 0, 0, symbols, 0, 0, 0, *(0 for _ in lengths)
    points = np.zeros(len(a) + 1, np.int64)
    np.cumsum((a & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    prefix, down = prefix_sums(MIX[a]), DOWN.upto(len(a) + 1)
    words = spans(prefix, starts, ends, down)
    breaks = np.flatnonzero(a == 10)
    line_starts, line_ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(a)]))
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = last > first
    _, again = seen_before(spans(prefix, line_starts[full], line_ends[full], down))
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=sums[1:])
    line_chars = int((sums[last[full]] - sums[first[full]])[again].sum())
    rolled, down, at = prefix_sums(words), DOWN.upto(n + 1), np.arange(n + 1)

    def hit(length: int, first_too: bool) -> np.ndarray:
        if n <= length:
            return np.zeros(n, bool)
        twice, later = seen_before(spans(rolled, at[: n - length + 1], at[length:], down))
        marks = twice if first_too else later
        return covered(marks, length, n) if marks.any() else np.zeros(n, bool)

    return n, int(chars.sum()), symbols, int(again.sum()), int(hit(3, True).sum()), line_chars, *(int(chars[hit(k, False)].sum()) for k in lengths)


def judged(text: str | None, ngram_limits: dict[int, float], line_limit: float, min_words: int) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_chars, cover...)"""
    n, chars, symbols, dup_lines, repeat, line_chars, *cover = measure(text or "", tuple(ngram_limits))
    failed = n < min_words or 100 * repeat > 50 * n
    kept = not failed and line_chars <= line_limit * chars and all(c <= most * chars for most, c in zip(ngram_limits.values(), cover, strict=True))
    return n, chars, symbols, dup_lines, repeat, failed, kept, line_chars, *cover


def accepted_quality(docs: DataFrame, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that ``repetition_quality`` keeps."""
    return accepted(docs, lambda: lambda texts: [judged(t, ngram_limits, line_limit, min_words)[6] for t in texts])


def repetition_quality(docs: DataFrame, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """Repetition measures and a verdict for every whole text.

    ``n_dup_lines``: lines with a word that equal an earlier line; ``n_repeat_words``: words in 3-word windows
    that the text has twice or more, the first included; ``line_chars`` and ``ngram<n>_chars``: word characters
    in repeated lines, and in n-word windows that stand earlier in the text. ``base_failed``: fewer than
    ``min_words`` words, or more than half of the words repeat. ``kept``: neither that nor any share of
    characters above its limit.

    Null and empty texts have no words, so they fail. A null doc_id is kept; repeated rows give repeated rows; an
    empty table gives none. Very long texts are measured whole. Other columns, also of clashing names, are not read.
    """
    def make():
        def f(batch):
            rows = [judged(t, ngram_limits, line_limit, min_words) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return f

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", *(f"ngram{k}_chars" for k in ngram_limits))
    kinds = {"base_failed": "boolean", "kept": "boolean"}
    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return map_slices(rows, make, "doc_id long, " + ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names))
