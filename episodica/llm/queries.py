"""The corpus operators' queries over the driver's tables, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_windows, read_back
from .common import pick, table
from .fingerprints import fingerprint_documents
from .langid import predict_languages
from .licenses import scan_licenses
from .mixing import select_mix
from .neardup import near_duplicates
from .packing import pack
from .repetition import repetition_quality
from .sharding import shard_documents
from .tokencount import count_tokens


#: Weights of the mix, by name or path: half of the tokens English, less of one domain, more of one source.
MIX_WEIGHTS = {"en": 3.0, "domain1": 0.5, "src0": 2.0}


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_prefixes=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "<|im_end|><|im_start|>assistant ok"
    turn = F.col("id")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_windows(turns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS).drop("row")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_token_counts, op3_quality_rules, op4_language_id, op5_chat_formatting, op6_mixing, op7_sharding, op8_packing, op9_license_scans, op10_near_duplicates)}

#: How many words a repeated window has, in the quality rules, and the SQL of its words from the one at hand on.
_WINDOWS = (3, 5, 7, 10)


def _window(n: int) -> str:
    words = ", ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    return f"CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN concat_ws(' ', {words}) END AS g{n}"


_SPACE = "\\x20\\x09-\\x0D"
_ROWS = "PARTITION BY doc_id ORDER BY p"
_OP3 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, regexp_extract_all(text, '[^{_SPACE}]+') AS ws FROM d), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM l),
g AS (SELECT doc_id, p, length(w) AS c, {', '.join(map(_window, _WINDOWS))} FROM w WINDOW o AS ({_ROWS})),
m AS (SELECT doc_id, p, c, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS m3, {', '.join(f'g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY p) > 1 AS m{n}' for n in _WINDOWS[1:])} FROM g),
h AS (SELECT doc_id, c, {', '.join(f'bool_or(m{n}) OVER ({_ROWS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS h{n}' for n in _WINDOWS)} FROM m),
a AS (SELECT doc_id, count(*) AS n_words, CAST(sum(c) AS BIGINT) AS word_chars, count(*) FILTER (h3) AS n_repeat_words, {', '.join(f'CAST(coalesce(sum(c) FILTER (h{n}), 0) AS BIGINT) AS ngram{n}_chars' for n in _WINDOWS[1:])} FROM h GROUP BY doc_id),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
y AS (SELECT doc_id, length(regexp_replace(line, '[{_SPACE}]+', '', 'g')) AS c, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) > 1 AS again FROM x),
b AS (SELECT doc_id, count(*) FILTER (again AND c > 0) AS n_dup_lines, CAST(coalesce(sum(c) FILTER (again), 0) AS BIGINT) AS line_chars FROM y GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, line_chars, {', '.join(f'coalesce(ngram{n}_chars, 0) AS ngram{n}_chars' for n in _WINDOWS[1:])} FROM d LEFT JOIN a USING (doc_id) JOIN b USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_chars <= 0.20 * word_chars AND ngram5_chars <= 0.15 * word_chars AND ngram7_chars <= 0.13 * word_chars AND ngram10_chars <= 0.10 * word_chars AS kept FROM r"""

_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, CAST(i AS BIGINT))) AS t"


def _crc(h: str, n: str) -> str:
    """The checksum of n bytes, whose hex digits are in the list h, by the table t."""
    byte = f"16 * (strpos('0123456789ABCDEF', {h}[i]) - 1) + strpos('0123456789ABCDEF', {h}[i + 1]) - 1"
    return f"xor(list_reduce(list_transform(range(1, 2 * ({n}), 2), lambda i: {byte}), lambda v, b: xor(v >> 8, t[CAST(xor(v, b) & 255 AS INT) + 1]), 4294967295), 4294967295)"


def _shares(level: int) -> str:
    """CTEs that share the budgets of a level's parents among its nodes: all below the water line get what they have."""
    path = ("domain", "lang", "source")[: level + 1]
    own, up = ", ".join(path), "PARTITION BY " + (", ".join(path[:-1]) or "1")
    weight = "CASE " + path[-1] + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.items()) + " ELSE 1.0 END"
    order = f"{up} ORDER BY supply / w, {own}"
    return f"""n{level} AS (SELECT {own}, sum(supply) AS supply, any_value(budget) AS budget, CAST({weight} AS DOUBLE) AS w FROM b{level} GROUP BY {own}),
l{level} AS (SELECT *, (budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM n{level}),
s{level} AS (SELECT {own}, least(supply, w * max(line) OVER ({up})) AS share FROM l{level}),
b{level + 1} AS (SELECT domain, lang, source, tokens, supply, share AS budget FROM b{level} JOIN s{level} USING ({own}))"""


_LEAF = "domain, lang, source"
_OP6 = f"""WITH c AS ({_CRC_TABLE}), x AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(hex(encode(coalesce(source, ''))), '') AS h, octet_length(encode(coalesce(source, ''))) AS bytes, len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS n_tokens FROM documents),
d AS (SELECT doc_id, 'domain' || {_crc('h', 'bytes')} % 4 AS domain, lang, source, n_tokens FROM x, c),
b0 AS (SELECT {_LEAF}, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS supply, floor(sum(sum(n_tokens)) OVER () * 0.6) AS budget FROM d GROUP BY {_LEAF}),
{_shares(0)}, {_shares(1)}, {_shares(2)},
f AS (SELECT {_LEAF}, tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS leaf_budget FROM b3),
e AS (SELECT d.*, leaf_budget, tokens, CAST(epoch AS INT) AS epoch, CAST(epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY {_LEAF}, epoch ORDER BY md5('20240:' || epoch || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM d JOIN f USING ({_LEAF}), range(2) r(epoch))
SELECT doc_id, {_LEAF}, n_tokens, epoch, position, CAST(least(n_tokens, leaf_budget - position) AS BIGINT) AS take_tokens, leaf_budget FROM e WHERE position < leaf_budget OR tokens > 0 AND epoch < leaf_budget // tokens"""

# The law by itself, without ranges: records in order of their texts' digests.
_OP7 = f"""WITH c AS ({_CRC_TABLE}),
k AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
s AS (SELECT doc_id, digest, size, sum(size) OVER (ORDER BY digest, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total, {_crc('h', 'size - 1')} AS text_crc32 FROM k, c),
g AS (SELECT *, min(start) OVER (PARTITION BY digest) AS first, sum(size) OVER (PARTITION BY digest) AS whole FROM s),
p AS (SELECT *, CAST(least(15, (CASE WHEN whole <= 0.02 * total / 16 THEN 2 * first + whole ELSE 2 * start + size END) * 16 // (2 * total)) AS INT) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS LAST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""

# All pairs of different sets whose sizes allow a link, and the closure of the links.
_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
c AS (SELECT *, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class FROM s),
r AS (SELECT class, n, list_transform(s, lambda x: hash(x)) AS s FROM c WHERE doc_id = class AND n > 0),
e AS (SELECT a.class AS a, b.class AS b FROM r a JOIN r b ON a.class <> b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) AND 180 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n)),
t(id, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.reached),
m AS (SELECT id, min(reached) AS low FROM t GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(low, class) AS component_id, doc_id = coalesce(low, class) AS kept FROM c LEFT JOIN m ON m.id = c.class"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": _OP3, "op6_mixing": _OP6, "op7_sharding": _OP7, "op10_near_duplicates": _OP10}
