"""JSONL and Parquet sources and sinks."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def lenient(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """A bad line is fatal, and the error names its file and text. Blank lines are skipped."""
    s = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    r = lines.select("file", "value", F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = F.raise_error(F.concat(F.lit("corrupt JSONL in "), F.col("file"), F.lit(": "), F.left("value", F.lit(200))))
    return r.select(F.when(F.col(f"r.{BAD}").isNotNull(), bad.cast(s)).otherwise(F.col("r")).alias("r")).select("r.*").drop(BAD)


def counted(spark: SparkSession, path, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, a row with the number of bad lines)."""
    s = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return rows.where(F.col(BAD).isNull()).drop(BAD), rows.agg(F.count_if(F.col(BAD).isNotNull()).alias("rejected"))


def tagged(spark: SparkSession, path, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Rows of each ``type``, with the file they come from; a row of any other type is fatal when it is read."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"))
    kind = F.get_json_object("value", "$.type")
    known = F.when(kind.isin(list(schemas)), kind).otherwise(F.raise_error(F.concat(F.lit("unknown row type: "), F.coalesce(kind, F.lit("none")))))
    lines = lines.withColumn("kind", known)
    return {k: lines.where(F.col("kind") == k).select("file", F.from_json("value", s).alias("r")).select("file", "r.*") for k, s in schemas.items()}


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """The commit protocol makes the write atomic. With an order, one sorted file for small exports."""
    (df.orderBy(*order).coalesce(1) if order else df).write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", schema: T.StructType | None = None) -> None:
    """A folder of zstd Parquet files for each split, with the schema's columns, types and order if there is one."""
    if schema is not None:
        df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields), split)
    df.write.option("compression", "zstd").partitionBy(split).parquet(path)


def melted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Numeric columns as (ids, metric, value)."""
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, "metric", "value")


#: The columns of a tokenized training row.
TRAINING = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("candidate_id", "question_id", "question_sha256")),
    T.StructField("golden_answers", T.ArrayType(T.StringType())),
    *(T.StructField(c, T.StringType()) for c in ("data_source", "hotpot_type", "hotpot_level")),
    *(T.StructField(c, T.ShortType()) for c in ("search_action_count", "bm25_execution_count", "unique_document_count")),
    *(T.StructField(c, T.StringType()) for c in ("evidence_grade", "teacher", "protocol_config_sha256", "pilot_manifest_sha256", "trajectory_audit_json")),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("attention_mask", T.ArrayType(T.ByteType())),
    T.StructField("labels", T.ArrayType(T.IntegerType())),
    *(T.StructField(c, T.IntegerType()) for c in ("token_count", "supervised_token_count", "information_token_count", "prompt_token_count")),
])


def read_counted(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """Parquet that must have so many rows."""
    df = spark.read.parquet(path)
    if (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows; {rows} are expected")
    return df


def write_descriptor(path: str | Path, files: dict[str, str]) -> None:
    """``dataset_info.json``: each data set's file of conversations, for trainers that read such."""
    info = {name: {"file_name": f, "formatting": "sharegpt", "columns": {"messages": "conversations"}} for name, f in files.items()}
    Path(path).write_text(json.dumps(info, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def row_hash(df: DataFrame) -> Column:
    """Digest of a row as JSON with its columns in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file, from 0: (file, line, value). Rows are counted by block of
    the file, and the blocks' counts summed up; no line is shuffled."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = t.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def fetch_lines(hits: DataFrame, lines: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The stored line of each hit, whose id is a line number; null where there is none."""
    return hits.join(lines.select(F.col("line").alias("_line"), F.col("value").alias("contents")), F.col(doc_id).cast("long") == F.col("_line"), "left").drop("_line")
