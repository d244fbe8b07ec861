"""SubRip files as a data source: ``spark.read.format("srt")`` and ``df.write.format("srt")``."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.timecode import srt_time

SCHEMA = "video_id string, block_no int, start double, end double, text string"
_TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})"
_CUE = re.compile(rf"(\d+)[ \t]*\r?\n{_TIME}[ \t]*-->[ \t]*{_TIME}[^\n]*\r?\n(.*?)(?=\r?\n[ \t]*\r?\n|\Z)", re.DOTALL)


def seconds(h: str, m: str, s: str, ms: str) -> float:
    return (int(h) * 3_600_000 + int(m) * 60_000 + int(s) * 1000 + int(ms)) / 1000


def parse(content: str) -> Iterator[tuple[int, float, float, str]]:
    """(number, start, end, text) of every cue."""
    for m in _CUE.finditer(content.lstrip("﻿")):
        yield int(m[1]), seconds(*m.group(2, 3, 4, 5)), seconds(*m.group(6, 7, 8, 9)), m[10].replace("\r\n", "\n").strip()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all SubRip files under a path that Spark can read; files are split among tasks."""

    def run(parts):
        import pandas as pd

        for part in parts:
            rows = [(os.path.splitext(os.path.basename(p))[0], *cue) for p, c in zip(part["path"], part["content"], strict=True) for cue in parse(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["video_id", "block_no", "start", "end", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def cues(blocks: DataFrame) -> DataFrame:
    """video_id, block_no, cue: numbered by (start, end, text), empty texts dropped."""
    w = Window.partitionBy("video_id").orderBy("start", "end", "text")
    numbered = blocks.where(F.trim("text") != "").withColumn("block_no", F.row_number().over(w))
    cue = F.concat(F.col("block_no").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return numbered.select("video_id", "block_no", cue.alias("cue"))


def write(blocks: DataFrame, path: str) -> None:
    """One text file of cues for each video, under ``video_id=...``."""
    ordered = cues(blocks).repartition("video_id").sortWithinPartitions("video_id", "block_no")
    ordered.select("video_id", F.col("cue").alias("value")).write.partitionBy("video_id").mode("overwrite").text(path)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_File]:
        found = sorted(glob.glob(f"{self.path}/**/*.srt", recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8", errors="replace", newline="") as f:
            name = os.path.splitext(os.path.basename(partition.path))[0]
            for cue in parse(f.read()):
                yield (name, *cue)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        by: dict[str, list] = {}
        for r in rows:
            if (r.text or "").strip():
                by.setdefault(r.video_id, []).append((r.start, r.end, r.text))
        os.makedirs(self.path, exist_ok=True)
        out = []
        for name, cues_ in by.items():
            target = f"{self.path}/{name}.srt"
            with open(f"{target}.{TaskContext.get().taskAttemptId()}", "w", encoding="utf-8") as f:
                for i, (a, b, text) in enumerate(sorted(cues_), 1):
                    f.write(f"{i}\n{stamp(a)} --> {stamp(b)}\n{text}\n\n")
            os.replace(f.name, target)
            out.append(target)
        return _Written(out)


def stamp(t: float) -> str:
    ms = max(0, int(round(t * 1e6)) // 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


class SrtSource(DataSource):
    """For folders that all workers share; ``read`` and ``write`` above also take Spark's own file systems. Rows of a video must share a partition when written."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SrtSource)
