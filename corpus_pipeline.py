"""The corpus pipeline: quality rules, language, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import DOCUMENT_COLUMNS, pick, table, written
from episodica.llm.langid import accepted_languages
from episodica.llm.mixing import select_mix
from episodica.llm.neardup import near_duplicates
from episodica.llm.packing import pack
from episodica.llm.repetition import accepted_quality

#: Tokens of the mix, as a share of all that are there, and its weights by name or path.
MIX_SHARE = 0.8
MIX_WEIGHTS = {"en": 3.0, "src0": 2.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_languages(docs)


def by_rows(docs: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """documents with ``row``, which names a row: its doc_id where each row has one of its own (then true), else a
    number of the row in a written table, so that rows without doc_id and rows that share one are told apart."""
    docs = pick(docs, *DOCUMENT_COLUMNS)
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.limit(1).count():
        return written(docs.withColumn("row", F.monotonically_increasing_id()), label), False
    return docs.withColumn("row", F.col("doc_id")), True


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts stays, whatever the order of tasks: the first by doc_id (none comes last),
    then by digest of its text and by its other columns. Texts without words are linked with nothing, so all rows
    with such stay. Shingles are of five words, and a link is a similarity of 0.8 or more."""
    docs, own = by_rows(docs, "pipeline-rows")
    found = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"))
    if own:  # a component is named by its smallest doc_id
        kept = found.where("kept").select(F.col("doc_id").alias("row"))
    else:
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), "lang", "source", "n_chars", "row")
        first = docs.select("row", order.alias("order")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
        kept = first.groupBy("component_id").agg(F.min("order").alias("first")).select("first.row")
    return docs.join(kept, "row", "left_semi").select(*DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, each once."""
    docs, _ = by_rows(docs, "pipeline-rows")
    taken = select_mix(docs, MIX_SHARE, MIX_WEIGHTS, max_epochs=1, row="row").select("row").distinct()
    return docs.join(taken, "row", "left_semi").select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("dedup", dedup), ("mix", mix), ("packing", packed)]

#: Hashing, tokenizing and packing are beyond SQL; the tests hold each stage's ids and run() against plain rules, and
#: languages against the same model on the driver.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
