"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder as shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_made: dict[str, list[tuple[str, str]]] = {}


def made(spark: SparkSession, path: str, table: str = "") -> None:
    """Note an intermediate folder (and the table that is on it), so that it can be dropped."""
    _made.setdefault(spark.sparkContext.applicationId, []).append((path, table))


def intermediates(spark: SparkSession) -> int:
    """How many intermediate folders are noted: a mark for ``drop_intermediates``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def drop_intermediates(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate folders noted after the mark; what reads them lazily must have been written by then."""
    noted = _made.get(spark.sparkContext.applicationId, [])
    for path, table in noted[since:]:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)
    del noted[since:]


def materialise(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    The folder is noted as an intermediate one, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if not keep:
        made(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that columns of callers never clash with those that operators add."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def ascii_lower(col: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(col, UPPER, LOWER)


def rows_of(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a few at a time so that long texts don't pile up."""
    for batch in batches:
        columns = [batch.column(c) for c in cols]
        for lo in range(0, batch.num_rows, 256):
            yield from zip(*(c.slice(lo, 256).to_pylist() for c in columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_kept: dict[tuple, object] = {}


def worker_state(key: tuple, make):
    """Something costly, kept in a Python worker from task to task until another operator's task runs there."""
    if key not in _kept:
        release_worker_state()
        _kept[key] = make()
    return _kept[key]


def release_worker_state() -> None:
    """Free what earlier operators and tasks have left in this Python worker, and give it back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def has_letter(text: str, found=re.compile(r"[^\W\d_]").search) -> bool:
    return bool(found(text)) and any(map(str.isalpha, text))
