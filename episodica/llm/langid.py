"""Hierarchical language identification.

A text's letters, in runs, give hashed counts of 1 to 4 letters in a row; their square roots, scaled to
length 1, are its features. Linear support vector machines tell the families apart, one against the rest;
within the family that wins, one machine for each pair of languages votes. The machines are trained on the
driver on a bounded sample of labelled documents, whose features the executors make from whole texts; all
documents are then predicted where they are read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import accepted, map_slices, pick

DIMENSIONS = 1 << 13
ORDERS = 4
#: Labelled documents that the machines are trained on: for each language, and in all.
LANGUAGE_ROWS, SAMPLE_ROWS = 300, 4000
#: Which languages belong together. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he mt am",
}
UND = "und"
#: A filter lets pass what is at least as sure.
MIN_SCORE = 0.35


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members.split()), f"own {lang}")


def held_out(doc_id: Column) -> Column:
    """One of four documents, by the checksum of its id as text, is never learnt from. (Null: learnt from.)"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def features(text: str | None) -> np.ndarray | None:
    """None if there is no letter."""
    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[np.minimum(a, 0xFFFF)]
    for i in np.flatnonzero(a > 0xFFFF):
        letter[i] = chr(a[i]).isalpha()
    if not letter.any():
        return None
    before = np.concatenate(([True], letter[:-1]))
    a = np.where(letter, a, 32)[letter | before].astype(np.uint32)
    a = np.concatenate(([32], a, [32])).astype(np.uint32)
    counts, h = np.zeros(DIMENSIONS), np.zeros(len(a), np.uint32)
    for n in range(1, ORDERS + 1):
        h = (h[: len(a) - n + 1] + a[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=DIMENSIONS)
        if len(a) == n:
            break
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss), the last one the bias, by dual coordinate
    descent."""
    rng = np.random.default_rng(0)
    w, a = np.zeros(x.shape[1] + 1, np.float32), np.zeros(len(x))
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norm = (x * x).sum(1)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * float(w @ x[i]) - 1
            new = min(max(a[i] - g / norm[i], 0.0), c)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-3:
            break
    return w


class Model:
    """families: their languages; columns of weights: one for each family (if there are several), then one for
    each pair of languages of a family, positive for the first."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs)
        names = sorted(set(langs))
        self.families = [[x for x in names if family_of(x) == f] for f in sorted({family_of(x) for x in names})]
        columns = []
        if len(self.families) > 1:
            columns += [train_svm(x, np.where(np.isin(y, f), 1, -1)) for f in self.families]
        self.pairs: dict[tuple[str, str], int] = {}
        for f in self.families:
            for a, b in combinations(f, 2):
                of = np.isin(y, (a, b))
                self.pairs[a, b] = len(columns)
                columns.append(train_svm(x[of], np.where(y[of] == a, 1, -1)))
        self.weights = np.stack(columns, 1) if columns else np.zeros((DIMENSIONS + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margin = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-3 * margin.astype(np.float64)))
        if len(self.families) > 1:
            k = int(np.argmax(margin[: len(self.families)]))
            family, score = self.families[k], float(sure[k])
        else:
            family, score = self.families[0], 1.0
        votes = dict.fromkeys(family, 0.0)
        for a, b in combinations(family, 2):
            p = float(sure[self.pairs[a, b]])
            votes[a] += (p > 0.5) + p / 1e3
            votes[b] += (p <= 0.5) + (1 - p) / 1e3
        best = max(family, key=lambda f: votes[f])
        own = [float(sure[k]) if a == best else 1 - float(sure[k]) for (a, b), k in self.pairs.items() if best in (a, b)]
        return best, score * (sum(own) / len(own) if own else 1.0)


def train(docs: DataFrame, language_rows: int = LANGUAGE_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``language_rows`` labelled documents of each language and ``sample_rows`` in all; None
    if there are none. The sample is drawn by hash, the same each time."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, min(language_rows, sample_rows // len(counts)))
    chance = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2 * each / n))))
    draw = F.xxhash64("doc_id", F.lit(11))
    drawn = labelled.where(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < chance[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, F.col("doc_id"), F.crc32(F.col("text").cast("binary"))))
    sample = drawn.select("lang", "text", rank.alias("rank")).where(F.col("rank") <= each)

    def make():
        def f(batch):
            found = [features(t) for t in batch.column(1).to_pylist()]
            return {"lang": batch.column(0), "x": [None if x is None else x.astype(np.float16).tobytes() for x in found]}

        return f

    rows = [r for r in map_slices(sample.select("lang", "text"), make, "lang string, x binary").collect() if r["x"] is not None]
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    return Model(np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in rows]), [r["lang"] for r in rows])


def accepted_languages(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is one that was learnt, with a score of at least ``min_score``. Where nothing
    is labelled, nothing can be learnt and so nothing be rejected but texts without a letter."""
    model = train(pick(docs, "doc_id", "text", "lang"))

    def verdict(text):
        x = features(text)
        return x is not None and (model is None or model.predict(x)[1] >= min_score)

    return accepted(docs, lambda: lambda texts: [verdict(t) for t in texts])


def predict_languages(docs: DataFrame, language_rows: int = LANGUAGE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The language of every whole text, learnt from the labelled documents that are not held out.

    ``score``: the family's certainty times that of the language within it. A text that is null or has no letter
    is ``und`` with score 0, and so is every text if nothing is labelled. A null doc_id is kept; repeated rows
    give repeated rows; an empty table gives none. Very long texts are read whole, each by itself; what is kept of
    one is its counts. Other columns, also of clashing names, are not read.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    model = train(rows, language_rows, sample_rows)

    def make():
        def f(batch):
            found = [features(t) for t in batch.column(2).to_pylist()]
            said = [(UND, 0.0) if x is None or model is None else model.predict(x) for x in found]
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [a for a, _ in said], "score": [b for _, b in said]}

        return f

    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_slices(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")
