"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shipping import ship
from ..sources.tables import shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows, and bytes of text, that one call of a mapped function gets; bounds what a Python worker holds as
#: objects. A longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of exactly each name, whatever else the table has: names that differ only by
    case, or that are there twice, do not clash."""
    ship(df.sparkSession)
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def struct(ddl: str) -> T.StructType:
    """``"a long, b string"`` as a schema, without a session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()), "floats": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in order, in slices of at most ``rows`` rows and ``most`` bytes of text."""
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), np.zeros(batch.num_rows, np.int64))
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


class Memo(dict):
    """A bounded memo in two generations: when the younger is full it becomes the older, whose entries are
    lost unless they were used since. Looking up by [] moves an entry to the younger one, or makes it."""

    def __init__(self, limit: int, make: Callable | None = None):
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def known(self, key):
        """What is remembered, else None."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def unknown(self, keys: set) -> list:
        return [k for k in keys.difference(self) if k not in self.old]


def laid_out(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` (starts, sizes) in the given order, one after the other, and their borders."""
    each = sizes[order]
    ends = np.concatenate(([0], np.cumsum(each)))
    place = np.repeat(starts[order] - ends[:-1], each) + np.arange(ends[-1])
    return flat[place], ends


_kept: dict = {}


def kept_by_worker(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: one thing, the last."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def freed(*but: tuple) -> None:
    """At a task's start: free what an earlier task of another operator has left in this Python worker, so that
    workers do not gather the memos of all stages."""
    if _kept.keys() - set(but):
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], ddl: str, rows: int = SLICE_ROWS, keeps: tuple = (), most: int = SLICE_BYTES) -> DataFrame:
    """Map Arrow record batches in slices of at most ``rows`` rows and ``most`` bytes of text.

    ``make`` is called once in each task and gives the function that turns a slice into columns; what it
    builds (vocabularies, memos) lives as long as the task, unless ``kept_by_worker`` keeps it, as ``keeps``.
    """
    schema = struct(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed(keeps)
        f = make()
        for batch in batches:
            for part in slices(batch, rows, most):
                yield pa.RecordBatch.from_pydict(f(part), schema=arrow)

    return df.mapInArrow(run, schema)


def accepted(docs: DataFrame, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The documents that pass, with the columns of documents. ``make`` gives the function from texts to
    verdicts. Nothing is shuffled and no row is matched by id."""
    rows = pick(docs, *DOCUMENT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        f = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(f(part.column(1).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read that again. It survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    if (path := getattr(df, "written_path", None)) is not None:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
