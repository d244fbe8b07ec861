"""Tables in the folder that driver and executors share: they cut lineage, and what made them runs once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_noted: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own only where that is unset and all tasks run on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="subloom-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder, noted as one that can be dropped."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _noted.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is written now and read by whoever uses it; it is noted as one that can be dropped."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def noted(spark: SparkSession) -> int:
    """How many tables have been written so far: a mark for ``settled``."""
    return len(_noted.get(spark.sparkContext.applicationId, []))


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` as a table of its own; the tables noted after the mark, which it was made from, are deleted."""
    spark = df.sparkSession
    out = written(df, name)
    tables = _noted[spark.sparkContext.applicationId]
    for path in tables[since:-1]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)
    del tables[since:]
    return out
