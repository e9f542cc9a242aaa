"""Sharding by sampled splitters, in DataFrame functions alone.

Records are ordered by a key that starts with their text's digest, so equal texts stand together. Keys are
drawn with a chance in proportion to their size; quantiles of the draw split the key space into many small
ranges of like size, and ranges that turn out overfull are drawn from again, more densely, and subdivided. The
ranges' exact sizes, summed up in order, say where each range begins among all bytes, and each range then
places its own records: shards are equal slices of all bytes in key order. Only the key and size of a record
are shuffled, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, pick, written

SHARDS = 16
#: Records that share a range; there are never fewer or more ranges than these.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 250_000, 64, 4096
#: Keys drawn for each range, at most; and how much fuller than the mean a range may be.
DRAWS, OVERFULL = 16, 3
#: A group of equal texts of at most this share of a shard's bytes stays in one shard, whatever the table's size: the
#: law is about bytes, and a larger group, kept whole, could alone be more than a shard.
WHOLE_GROUP = 0.02
#: Times that overfull ranges are subdivided, at most; what then is still overfull is sorted on disk by its task.
ROUNDS = 8


def splitters_below(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or before the key, by bisection."""
    if not splitters:
        return F.lit(0)
    array = F.array(*map(F.lit, splitters))
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda k, s: F.when(F.get(array, k + s - 1) <= key, k + s).otherwise(k))


#: Hex digits of the text's digest, with which a key begins.
DIGEST = 32


def quantiles(drawn: list[str], n: int) -> list[str]:
    """n - 1 of the drawn keys at equal distances. The first of one text is put before all its copies, so that
    only groups with several splitters are cut."""
    drawn, out, last = sorted(drawn), [], ""
    for k in range(1, n):
        if drawn:
            key = drawn[k * len(drawn) // n]
            out.append(key[:DIGEST] if key[:DIGEST] != last else key)
            last = key[:DIGEST]
    return sorted(set(out))


def draw(records: DataFrame, total: int, draws: int) -> list[str]:
    """Keys of records, each drawn with the chance draws * size / total; the draw is by hash, so it repeats."""
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 52)) / float(1 << 52)
    rows = records.where(chance < F.col("size") * (draws / max(1, total))).select("key").distinct().collect()
    return [r["key"] for r in rows]


def ranged(records: DataFrame, splitters: list[str]) -> DataFrame:
    return records.withColumn("range", splitters_below(F.col("key"), splitters))


def find_splitters(records: DataFrame, total: int, ranges: int) -> list[str]:
    splitters = quantiles(draw(records, total, DRAWS * ranges), ranges)
    for _ in range(ROUNDS):
        sizes = {r["range"]: r["bytes"] for r in ranged(records, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("n") > 1).collect()}
        over = {k: b for k, b in sizes.items() if b > OVERFULL * total / ranges}
        if not over or len(splitters) >= 2 * MOST_RANGES:
            break
        more = set(splitters)
        drawn: dict[int, list[str]] = {k: [] for k in over}
        inside = ranged(records, splitters).where(F.col("range").isin(list(over)))
        edges = ["", *splitters]
        for key in draw(inside, total, 4 * DRAWS * ranges):
            k = next(i for i in sorted(over, reverse=True) if edges[i] <= key)
            drawn[k].append(key)
        for k, keys in drawn.items():
            more.update(quantiles(keys, -(-over[k] * ranges // total)))
        if more == set(splitters):
            break
        splitters = sorted(more)
    return splitters


def shard_documents(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS, whole_group: float = WHOLE_GROUP) -> DataFrame:
    """Put every document into a shard; the law is ``bytes``: shards' sizes are near equal.

    ``size``: UTF-8 bytes of the text and 1; ``slot``: the record's place in its shard, gapless from 0;
    ``grown_shard`` is null, as this law moves records when shards are added. Equal texts stay in one shard,
    unless they are more than ``whole_group`` of one (a fiftieth): then they are cut where shards end. So a shard is
    off the mean by that share and one text at most; at 0 every group may be cut, at 1 those of up to a shard are
    whole and shards may be off by a group.

    Very long texts are records like any other; only their size and digest are kept. Other columns, also of clashing
    names, are not read. Null texts have the size 1 and the checksum 0. A null doc_id comes last of its text. Repeated rows each get
    a slot of their own; which of them gets which makes no difference. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    records = written(
        pick(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.concat(F.md5(text.cast("binary")), F.coalesce(F.lpad(F.lower(F.hex("doc_id")), 16, "0"), F.lit("~"))).alias("key"),
        ),
        "shard-records",
    )
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, n // range_rows))
    splitters = find_splitters(records, total, ranges)
    # A row for each range, at most a few thousand.
    sums = ranged(records, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sums.select("range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in (("bytes", "bytes_at"), ("n", "rows_at")))))
    inside = Window.partitionBy("range").orderBy("key", "doc_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "digest")
    placed = (
        ranged(records, splitters)
        .join(offsets, "range")
        .withColumn("digest", F.substring("key", 1, DIGEST))
        .withColumn("start", F.col("bytes_at") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("row", F.col("rows_at") + F.row_number().over(inside) - 1)
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("whole", F.col("group_size") <= whole_group * total / shards)
        .withColumn("middle", F.when(F.col("whole"), 2 * F.col("group_start") + F.col("group_size")).otherwise(2 * F.col("start") + F.col("size")))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / (2 * max(1, total)))).cast("int"))
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-placed")
    dropped(records)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first")))  # a row for each shard
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
