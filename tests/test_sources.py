"""Sources and sinks that aren't subtitle files."""

from __future__ import annotations

import hashlib
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from subloom.operators import candidates as C
from subloom.operators import reports
from subloom.sources import inputs


def test_files_urls_and_json(spark, tmp_path):
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "a.png").write_bytes(b"abc")
    (tmp_path / "media" / "b.txt").write_bytes(b"x")
    files = inputs.videos(spark, str(tmp_path / "media"), "*.png")
    assert [(r.sha1) for r in inputs.file_digests(files).collect()] == [hashlib.sha1(b"abc").hexdigest()]
    (tmp_path / "urls.txt").write_text(" http://a \n\n\t\nhttp://b\n")
    assert sorted(r.url for r in inputs.urls(spark, str(tmp_path / "urls.txt")).collect()) == ["http://a", "http://b"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "good.json").write_text(json.dumps({"n": 3, "m": {"a": 1}}, indent=1))
    (tmp_path / "docs" / "bad.json").write_text("{oops")
    got = inputs.json_documents(spark, str(tmp_path / "docs"), "n int, m map<string,int>").collect()
    assert sorted((r.n or 0, r.m) for r in got if r.n) == [(3, {"a": 1})] and len(got) == 2


def test_time_range_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("time"), F.lit("x").alias("big")).write.parquet(str(tmp_path / "f"))
    df = inputs.frames_in(spark.read.parquet(str(tmp_path / "f")).select("time"), 2, 4)
    assert sorted(r.time for r in df.collect()) == [2.0, 3.0, 4.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time,2.0)" in plan and "big" not in plan
    with pytest.raises(ValueError):
        inputs.frames_in(df, 4, 2)


def test_samples_and_comparison(spark):
    rows = [("v", f"{i:03d}", float(i), "t" * 400 if i % 2 == 0 else "", " " if i == 3 else f"raw{i} " + "r" * 400, i % 2 == 0, None if i % 2 == 0 else "why") for i in range(10)]
    seen = spark.createDataFrame(rows, "video_id string, frame_id string, time double, text string, raw string, emitted boolean, rejection string")
    got = inputs.samples(seen, 3)
    assert sorted((r.emitted, r.k, len(r.text), r.text[:4]) for r in got.collect()) == [(False, 1, 300, "raw1"), (False, 2, 300, "raw5"), (False, 3, 300, "raw7"), (True, 1, 400, "tttt"), (True, 2, 400, "tttt"), (True, 3, 400, "tttt")]
    lines = inputs.samples_text(got).first().value.split("\n")
    assert lines[:2] == ["ACCEPTED OCR SAMPLES", "=" * 40] and lines[2] == "1. " + "t" * 400 and lines[5:8] == ["", "DROPPED OCR SAMPLES", "=" * 40] and lines[8].startswith("1. [why] raw1 r") and lines[-1] == ""
    readings = spark.createDataFrame([("v", "1", 0.0, "a", "x"), ("v", "1", 0.0, "b", "y"), ("v", "2", 1.0, "a", "z")], "video_id string, frame_id string, time double, engine string, text string")
    wide = inputs.engine_comparison(readings, ["a", "b"], 10).collect()
    assert [(r.a, r.b) for r in wide] == [("x", "y"), ("z", None)]
    names = spark.createDataFrame([("ok.srt",), ("../x",)], "filename string")
    assert inputs.allowed(names, ["ok.srt"]).count() == 1


def test_decoder_failures_are_rows(spark):
    class Decoder:
        schema = "fps double, frames int"

        def rows(self, path, content):
            if content == b"bad":
                raise ValueError("broken")
            return [{"fps": 25.0, "frames": len(content)}]

    df = spark.createDataFrame([("a", bytearray(b"four")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r.path: (r.fps, r.frames, r.error) for r in C.decode(df, Decoder()).collect()}
    assert got["a"] == (25.0, 4, None) and got["b"][2] == "ValueError: broken"


def test_report_is_one_row(spark, tmp_path):
    seen = spark.createDataFrame([(1.0, "1", True, "paddle", 0.5, None), (2.0, "2", True, "paddle", 0.9, None), (3.0, "3", False, None, 0.1, "too_short")], "time double, frame_id string, emitted boolean, engine string, confidence double, rejection string")
    blocks = spark.createDataFrame([(0.0, 2.0), (3.0, 4.0)], "start double, end double")
    report = reports.ocr_report(seen, blocks)
    r = report.first()
    assert (r.actual_ocr_calls, r.accepted, r.rejected, r.average_confidence, r.median_confidence) == (3, 2, 1, 0.7, 0.7)
    assert [tuple(x) for x in r.confidence_histogram] == [("0.0-0.2", 0), ("0.2-0.4", 0), ("0.4-0.6", 1), ("0.6-0.8", 0), ("0.8-1.0", 1)]
    assert (r.subtitle_blocks_generated, r.average_subtitle_duration, [tuple(x) for x in r.rejection_reasons]) == (2, 1.5, [("too_short", 1)])
    inputs.write_json(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().accepted == 2
    areas = spark.createDataFrame([("v", True, 4.0), ("v", True, 0.0), ("v", False, 9.0)], "video_id string, has_subtitle boolean, text_bbox_area double")
    assert reports.average_area(areas, ["video_id"]).first().avg_area == 4.0


def test_exact_median(spark):
    """Whole and broken numbers, both signs, one value many times, nulls and NaN; one group is most of the rows."""
    draw = random.Random(3)
    rows = [("hot", 0.5)] * 3_000 + [("hot", draw.random()) for _ in range(2_999)] + [("a", x) for x in (-1.5, 2.0, -0.0, 1e300)] + [("b", None), ("c", float("nan")), ("c", -7.25), (None, 1.0), (None, 4.0)]
    got = {r.k: r["median"] for r in reports.exact_median(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    want = {k: statistics.median([x for q, x in rows if q == k and x is not None and x == x]) for k in ("hot", "a", "c", None)}
    assert got == want
    whole = reports.exact_median(spark.createDataFrame(rows, "k string, x double"), [], "x").first()["median"]
    assert whole == statistics.median([x for _, x in rows if x is not None and x == x])
    assert reports.exact_median(spark.createDataFrame([], "k string, x double"), ["k"], "x").collect() == []


def test_only_samples_are_tidied(spark):
    rows = [("v", float(i), f"{i}", False, "why", "", raw) for i, raw in enumerate(["  a \t b ", " \t\x1c\n", "", None, "c" * 400])] + [("v", 9.0, "9", True, None, "kept", "x")]
    seen = spark.createDataFrame(rows, "video_id string, time double, frame_id string, emitted boolean, rejection string, text string, raw string")
    out = inputs.samples(seen, 5)
    assert sorted((r.emitted, r.k, r.text) for r in out.collect()) == [(False, 1, "a b"), (False, 2, "c" * 300), (True, 1, "kept")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1  # not in a filter before the cut too
