"""Near-duplicates by a multi-index Hamming join over min-hash signatures.

A document is the set of its shingles. Documents of equal sets are one class, which goes on as its smallest
doc_id. A class has a signature of CHUNKS x CHUNK symbols of 16 bits. Two signatures that differ in fewer than
2 * CHUNKS symbols have, by pigeonhole, a chunk in which at most one symbol differs; each class is put in
one bucket for each chunk and each symbol of it that is left out, so all such pairs meet in a bucket. (At the
threshold of 0.8 a pair misses all its chunks with a chance of 2 in a million.)

In a bucket each class is first compared with the bucket's smallest one only; links that hold are merged. What
is then still in different components of one bucket is compared in full, by bitmaps that cannot miss a link; a
large bucket is split into blocks, and each pair of blocks is compared by itself, so that no bucket is one task's. So
a family of copies brings about as many pairs as it has members, and yet no link between different components
is lost. All links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, dropped, map_slices, pick, written

WORDS = 5
#: Percent of two sets' union that they share.
PERCENT = 80
CHUNKS, CHUNK = 10, 5
SYMBOLS = CHUNKS * CHUNK
#: Two bits of each symbol travel with the bucket rows. Pairs at the threshold differ there in 7.5 of 50 places,
#: with a deviation of 2.5; unrelated ones in 37.
MOST_APART = 24
#: So many ids, 8 MB, are sent to all executors to find their texts.
MOST_SENT = 1_000_000
#: Each set also has a bitmap of 64 x MAPS bits, which hold the parity of its shingles' counts. Two bitmaps differ
#: in no more bits than the sets do in shingles, so a pair whose bitmaps differ too much is no link.
MAPS = 16
BITMAP = [f"m{k}" for k in range(MAPS)]
MEMO_WORDS = 60_000
#: Classes of one bucket that are compared with each other at once.
BLOCK = 512

_rng = np.random.default_rng(20_240)
MULTIPLY = _rng.integers(0, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, SYMBOLS, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted 64-bit hashes of a text's distinct shingles of consecutive words."""

    def __init__(self, words: int):
        self.words, self.memo = words, Memo(MEMO_WORDS, xxhash.xxh3_64_intdigest)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, n)
        width = min(self.words, n)
        out = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            out = mixed(out * STEP + h[k : n - width + 1 + k])
        return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value of each hash function."""
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 4096):
        part = shingles[k : k + 4096, None] * MULTIPLY
        part += ADD
        part >>= np.uint64(32)
        np.minimum(low, part.min(0), out=low)
    return low.astype(np.uint16)


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2), its signature and its bitmap."""

    def make():
        shingles = Shingles(words)

        def f(batch):
            n, d1, d2, signature, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles.of(text)
                n.append(len(s))
                d1.append(int(signed(s.sum(keepdims=True))[0]) if len(s) else 0)
                d2.append(int(signed(mixed(s).sum(keepdims=True))[0]) if len(s) else 0)
                signature.append(minima(s).tobytes() if len(s) else None)
                bits.append(np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) % (64 * MAPS), minlength=64 * MAPS) & 1))
            maps = np.stack(bits).view(np.int64)
            return {"doc_id": batch.column(0), "n_shingles": n, "d1": d1, "d2": d2, "signature": signature} | {m: maps[:, k] for k, m in enumerate(BITMAP)}

        return f

    return map_slices(docs, make, "doc_id long, n_shingles long, d1 long, d2 long, signature binary, " + ", ".join(f"{m} long" for m in BITMAP))


def bucket_rows(classes: DataFrame) -> DataFrame:
    """A row for each class, chunk and symbol left out: key, id, n, and two bits of each symbol (b1, b2)."""

    def make():
        places = [[c * CHUNK + k for k in range(CHUNK) if k != out] for c in range(CHUNKS) for out in range(CHUNK)]
        salt = np.arange(len(places), dtype=np.uint64) * STEP

        def f(batch):
            rows = batch.num_rows
            s = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(rows, SYMBOLS).astype(np.uint64)
            keys = np.empty((rows, len(places)), np.uint64)
            for j, at in enumerate(places):
                packed = s[:, at[0]] | s[:, at[1]] << np.uint64(16) | s[:, at[2]] << np.uint64(32) | s[:, at[3]] << np.uint64(48)
                keys[:, j] = mixed(packed + salt[j])
            half = SYMBOLS // 2
            shift = np.arange(half, dtype=np.uint64) * np.uint64(2)
            bits = [((s[:, k : k + half] & np.uint64(3)) << shift).sum(1).astype(np.int64) for k in (0, half)]
            wide = lambda c: np.repeat(c, len(places))
            return {"key": keys.ravel().view(np.int64), "id": wide(batch.column(0).to_numpy()), "n": wide(batch.column(1).to_numpy()), "b1": wide(bits[0]), "b2": wide(bits[1])}

        return f

    return map_slices(classes, make, "key long, id long, n long, b1 long, b2 long")


def apart(a: str, b: str) -> Column:
    """In how many places the two bits of two rows' symbols differ."""
    pairs = 0x5555555555555555

    def half(c: str) -> Column:
        x = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(pairs)))

    return half("b1") + half("b2")


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes allow the share, and the signatures are near."""
    x, y = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (apart(a, b) <= MOST_APART)


def can_link(a: str, b: str, percent: int) -> Column:
    """The bitmaps differ in no more bits than linked sets of these sizes can in shingles."""
    differ = sum((F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))) for m in BITMAP[1:]), F.bit_count(F.col(f"{a}m0").bitwiseXOR(F.col(f"{b}m0"))))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share ``percent`` of their union."""

    def make():
        shingles = Shingles(words)
        return lambda batch: {"doc_id": batch.column(0), "s": [signed(shingles.of(t)) for t in batch.column(1).to_pylist()]}

    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "neardup-ids")
    if ids.count() <= MOST_SENT:  # else texts are shuffled
        ids = F.broadcast(ids)
    sets = written(map_slices(docs.join(ids, "doc_id", "left_semi"), make, "doc_id long, s longs"), "neardup-sets")
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"{x}s")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("as", "bs"))
    links = written(both.where(100 * shared >= percent * (F.size("as") + F.size("bs") - shared)).select("a", "b").distinct(), "neardup-links")
    dropped(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable over links (a, b), for all ids with a link. Each round takes
    the smallest label among neighbours, then the label's label."""
    both = written(links.union(links.select("b", "a")).toDF("id", "next"), "neardup-edges")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("next")).alias("component")), "neardup-labels")
    while True:
        told = both.join(labels.select(F.col("id").alias("next"), F.col("component").alias("c")), "next").groupBy("id").agg(F.min("c").alias("c"))
        low = labels.join(told, "id").select("id", F.least("component", "c").alias("low"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = written(low.join(jump, "low").select("id", F.least("low", "far").alias("component"), "old"), "neardup-labels")
        changed = new.where(F.col("component") != F.col("old")).limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            dropped(both)
            return labels.select("id", "component")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of documents that share ``percent`` of the union of their sets of ``words``-word shingles.

    Words are split at ASCII white space, A to Z in lower case. A text of fewer words is one shingle; one without
    words, or null, is empty and linked with nothing. ``component_id``: the smallest doc_id reachable;
    ``kept``: the document has that id; ``n_shingles``: its set's size.

    Rows of one doc_id count as one document with several texts. A row without doc_id is linked with nothing: its
    component_id is null and it is kept. An empty table gives no rows. Very long texts are read whole. Other columns, also of clashing names, are not read.
    """
    rows = pick(docs, "doc_id", "text")
    marked = written(signatures(rows, words), "neardup-signatures")
    digest = ["n_shingles", "d1", "d2"]
    classes = marked.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("signature", *BITMAP)))
    classes = written(classes, "neardup-classes")
    buckets = bucket_rows(classes.select("id", F.col("n_shingles").alias("n"), "signature"))
    # The smallest class of each bucket with several, summed up before the shuffle; then on each row of such a bucket.
    heads = buckets.groupBy("key").agg(F.min(F.struct("id", "n", "b1", "b2")).alias("head"), F.max("id").alias("last")).where("head.id < last")
    heads = heads.select("key", *(F.col(f"head.{c}").alias(f"h_{c}") for c in ("id", "n", "b1", "b2")))
    shared = written(buckets.join(heads, "key"), "neardup-buckets")
    tried = written(shared.where((F.col("id") != F.col("h_id")) & may_link("", "h_", percent)).select(F.col("h_id").alias("a"), F.col("id").alias("b")).distinct(), "neardup-tried")
    links = confirmed(tried, rows, words, percent)
    labels = components(links)
    # What meets in a bucket and is not in one component yet.
    member = shared.select("key", "id", "n", "b1", "b2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_keys = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x < y").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    member = written(member.join(mixed_keys, "key").join(classes.select("id", *BITMAP), "id"), "neardup-members")
    # Each row goes to all pairs of blocks (lo, hi) that its own block is in.
    member = member.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["key", "lo", "hi"]
    member = member.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    left, right = (member.select(*place, *(F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "b1", "b2", "component", "block", *BITMAP))) for x in "ab")
    once = (F.col("lo") == F.col("hi")) | (F.col("a_block") != F.col("b_block"))
    across = left.join(right, place).where(once & (F.col("a_component") < F.col("b_component")) & may_link("a_", "b_", percent) & can_link("a_", "b_", percent))
    more = across.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = written(more, "neardup-more")
    links = links.union(confirmed(more, rows, words, percent))
    labels = components(links)
    ids = classes.select(*digest, "id").join(labels, "id", "left").select(*digest, F.coalesce("component", "id").alias("found"))
    found = marked.select("doc_id", *digest).join(ids, digest, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
