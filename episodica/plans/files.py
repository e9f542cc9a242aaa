"""Queries of file sources and sinks: what is written to the shared folder comes back as its reader promises."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import integrity
from ..sources import jsonl
from ..sources.tables import shared_folder
from .queries import query, table

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _lines(spark, d, more) -> str:
    """Documents as JSON lines, where ``more`` (of a line and the row) is null, else that."""
    t = table(spark, d, "documents")
    line = F.to_json(F.struct("doc_id", "lang", "text", F.when(F.col("doc_id") % 5 == 0, "metadata").otherwise("result").alias("type")))
    path = _folder(spark)
    t.select(F.coalesce(more(line), line).alias("value")).write.text(path)
    return path


_BROKEN = lambda line: F.when(F.col("doc_id") % 7 == 3, F.left(line, F.length(line) - 4)).when(F.col("doc_id") % 7 == 4, " ")


@query("SELECT doc_id, lang, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 7 NOT IN (3, 4)")
def lenient_lines(spark, d):
    """Lines that were cut off are skipped, and blank ones."""
    r = jsonl.lenient(spark, _lines(spark, d, _BROKEN), ROW).where("doc_id is not null")
    return r.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 7 NOT IN (3, 4)) AS good, (SELECT count(*) FROM documents WHERE doc_id % 7 = 3) AS rejected")
def counted_lines(spark, d):
    good, bad = jsonl.counted(spark, _lines(spark, d, _BROKEN), ROW)
    return good.agg(F.count("*").alias("good")).crossJoin(bad)  # one row each


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'metadata' ELSE 'result' END AS kind FROM documents WHERE doc_id % 7 <> 4")
def tagged_lines(spark, d):
    found = jsonl.tagged(spark, _lines(spark, d, lambda line: F.when(F.col("doc_id") % 7 == 4, "  ")), {"result": ROW, "metadata": ROW})
    return found["result"].select("doc_id", F.lit("result").alias("kind")).union(found["metadata"].select("doc_id", F.lit("metadata").alias("kind")))


@query("SELECT doc_id, lang, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 7 <> 4")
def strict_lines(spark, d):
    r = jsonl.strict(spark, _lines(spark, d, lambda line: F.when(F.col("doc_id") % 7 == 4, " ")), ROW)
    return r.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("SELECT item_id, CASE WHEN item_id % 4 = 3 THEN NULL ELSE text END AS contents FROM benchmark")
def fetched_lines(spark, d):
    """The corpus is one file of lines; a hit names its line, or one that is not there."""
    path = _folder(spark)
    t = table(spark, d, "benchmark")
    jsonl.write_jsonl(t.select("item_id", "text"), path, ["item_id"])
    lines = jsonl.numbered(spark, path)
    at = lines.select(F.get_json_object("value", "$.item_id").cast("long").alias("item_id"), "line")
    hits = t.select("item_id").join(at, "item_id").select("item_id", F.when(F.col("item_id") % 4 == 3, F.lit(10**9)).otherwise(F.col("line")).cast("string").alias("doc_id"))
    return jsonl.fetch_lines(hits, lines).select("item_id", F.get_json_object("contents", "$.text").alias("contents"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'eval' ELSE 'reserve' END AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def typed_splits(spark, d):
    i, path = F.col("doc_id") % 3, _folder(spark)
    own = {"candidate_id": F.col("doc_id"), "token_count": F.col("n_chars"), "data_source": F.col("source")}
    t = table(spark, d, "documents").select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in jsonl.TRAINING.fields), F.when(i == 0, "train").when(i == 1, "eval").otherwise("reserve").alias("split"))
    jsonl.write_splits(t, path, schema=jsonl.TRAINING)
    return spark.read.parquet(path).groupBy("split").agg(F.count("candidate_id").alias("n"), F.sum("token_count").alias("tokens"))


@query("SELECT lang, metric, value FROM (SELECT lang, count(*) * 1.0 AS n, avg(n_chars) AS mean FROM documents WHERE lang IS NOT NULL GROUP BY lang) UNPIVOT (value FOR metric IN (n, mean))")
def melted_metrics(spark, d):
    g = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))
    return jsonl.melted(g, ["lang"], ["n", "mean"])


@query("SELECT 'seed' AS field, CAST(2 AS INT) AS \"values\"")
def header_conflicts(spark, d):
    """Headers of shards that agree in all but one field."""
    h = table(spark, d, "events").select((F.col("event_id") % 4).alias("shard")).distinct().select(F.lit("p").alias("protocol"), F.lit(4).alias("shards"), F.when(F.col("shard") != 2, 7).otherwise(8).alias("seed"))
    return integrity.header_conflicts(h, ["protocol", "shards", "seed"])
