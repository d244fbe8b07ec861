"""Flows with injected models: retries, fallbacks, answers asked for once, reports and trials."""

from __future__ import annotations

import time
import uuid

import pytest
from pyspark.sql import functions as F

from subloom.operators import blocks as B
from subloom.operators import candidates as C
from subloom.operators import enrich, grid, quality, recognise, reports
from subloom.sources import inputs

KEYS = "video_id string, frame_id string, time double"


def calls_in(path):
    return sorted(line for f in path.iterdir() for line in f.read_text().splitlines())


def counted(path, answer):
    """A model that writes down what it is asked."""

    def ask(texts):
        import uuid

        (path / uuid.uuid4().hex).write_text("".join(f"{t}\n" for t in texts))
        return [answer(t) for t in texts]

    return ask


def engine(text_of, name="tesseract", confidence=0.9):
    """An engine whose images are texts; ``!`` makes it fail."""

    def make():
        def read(content):
            text = text_of(content.decode())
            if text.startswith("!"):
                raise RuntimeError(text)
            return text, confidence

        return read

    return {name: make}


def images(spark, rows):
    return spark.createDataFrame([("v", f"{i:03d}", t, content.encode()) for i, (t, content) in enumerate(rows)], f"{KEYS}, content binary")


def test_a_translator_is_asked_once_for_each_text(spark, tmp_path):
    texts = ["Привет друг", "Стой там", "Привет друг", "Иди сюда", "Это дом", "Где ты", "Это дом"]
    blocks = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "video_id string, block_no int, text string")
    cache = spark.createDataFrame([], "source_text string, target_text string")
    out, fresh = enrich.translate(blocks, cache, counted(tmp_path, lambda t: None if t == "Где ты" else t[::-1]))
    got = {r.block_no: (r.translated, r.status) for r in out.collect()}
    assert got[0] == ("гурд тевирП", "translated") and got[5] == ("Где ты", "failed")
    assert {r.source_text for r in fresh.collect()} == set(texts) - {"Где ты"}
    assert out.where("status = 'translated'").count() == 6
    assert calls_in(tmp_path) == sorted(set(texts))  # five texts, five questions, whatever is read of the results


def test_translators_in_turn():
    ask = enrich.first_that_answers(lambda ts: [t if "a" in t else None for t in ts], lambda ts: 1 / 0, lambda ts: [t.upper() if "b" in t else None for t in ts])
    assert ask(["xa", "xb", "xc", "ab"]) == ["xa", "XB", None, "ab"]
    assert enrich.first_that_answers()(["x"]) == [None]


def test_translation_report(spark):
    done = spark.createDataFrame([("a", "translated"), ("b", "failed")], "source_text string, status string")
    r = enrich.translation_report(done, "google", "in.srt", "out.srt").first()
    assert (r.total_blocks, r.translated_blocks, r.failed_blocks, r.status, r.error) == (2, 1, 1, "completed_with_errors", None)
    assert enrich.translation_report(done, "google", "i", "o", "no server").first().status == "translation_failed"
    assert enrich.translation_report(done, "none", "i", "o").first().status == "not_requested"


def test_cleanup_and_sanity_by_model(spark, tmp_path):
    blocks = spark.createDataFrame([("v", 1, "Это  дом ,"), ("v", 2, "Это  дом ,"), ("v", 3, "Стой")], "video_id string, block_no int, text string")
    (tmp_path / "a").mkdir()
    tidy = enrich.cleaned_by_model(blocks, counted(tmp_path / "a", lambda t: "Это наш дом" if "дом" in t else None))
    assert [r.text for r in tidy.orderBy("block_no").collect()] == ["Это наш дом", "Это наш дом", "Стой"]
    assert calls_in(tmp_path / "a") == ["Стой", "Это дом"]
    texts = ["что это такое было", "кртпвсм дфгхжкл птрвсн мкл", "зжшщцк зжшщцк нмпрст вгд"]
    (tmp_path / "b").mkdir()
    df = spark.createDataFrame(list(enumerate([*texts, texts[1]])), "i int, text string")
    sane = recognise.sanity_by_model(df, counted(tmp_path / "b", lambda t: "valid." if t.startswith("к") else "NOISE"))
    assert [(r.sane.valid, r.sane.reason) for r in sane.orderBy("i").collect()] == [(True, "local_language_sanity"), (True, "ollama_language_sanity"), (False, "ollama_language_noise"), (True, "ollama_language_sanity")]
    assert calls_in(tmp_path / "b") == sorted(texts[1:])


def test_model_answers():
    listed = {"models": [{"name": "qwen:7b"}, {"name": "mistral"}]}
    assert [recognise.model_answers(x, m) for x, m in ((None, "a"), (listed, "qwen:3b"), (listed, "mistral"), (listed, "other"), ([], "a"))] == [(False, False), (True, True), (True, True), (True, False), (True, False)]


def test_fallback_reads_what_failed(spark):
    frames = images(spark, [(0.0, "Привет друг"), (1.0, "!broken"), (2.0, "!broken too")])
    out = recognise.read_with_fallback(frames, engine(str, "paddle"), engine(lambda t: t.replace("!broken", "Стой там"), "tesseract"))
    assert sorted((r.frame_id, r.engine, r.status, r.text) for r in out.collect()) == [
        ("000", "paddle", "ok", "Привет друг"), ("001", "paddle", "failed", ""), ("001", "tesseract", "ok", "Стой там"), ("002", "paddle", "failed", ""), ("002", "tesseract", "ok", "Стой там too"),
    ]


def test_last_chance(spark):
    frames = images(spark, [(0.0, "Привет друг"), (1.0, "Это мой дом"), (2.0, "???")])
    readings = recognise.read(frames, engine(lambda t: t if t.startswith("Привет") else "", "paddle"))
    chosen = quality.choose_best(quality.clean(readings), ["video_id", "frame_id", "time"], ("paddle",))
    out = {r.frame_id: (r.text, r.engine, r.accepted) for r in recognise.last_chance(frames, chosen, engine(str, "tesseract")).collect()}
    assert out == {"000": ("Привет друг", "paddle", True), "001": ("Это мой дом", "tesseract", True), "002": ("", None, False)}


def test_deep_retry(spark):
    """A frame's neighbours and variants vote; noise and what the cleaner drops don't."""
    frames = images(spark, [(0.0, "Это наш дом"), (0.5, "Это наш дом"), (0.9, "дом"), (5.0, "зжшщц кк пп"), (9.0, "Где же ты")])
    transform = lambda content, variant: content if variant.split(":")[1] in ("subtitle", "grayscale") else b""
    wanted = frames.where("frame_id in ('000', '003', '004')")
    out = {r.frame_id: r for r in recognise.deep_retry(frames, wanted, engine(str), transform).collect()}
    assert (out["000"].text, out["000"].outcome) == ("Это наш дом", "deep_vote")
    assert (out["004"].text, out["004"].outcome) == ("Где же ты", "deep_vote")
    assert out.get("003") is None or out["003"].text == ""  # no vote was left, or none that counts
    chosen = frames.select("video_id", "frame_id", "time").withColumns({"text": F.lit("зжшщцкрпт"), "confidence": F.lit(0.2), "accepted": F.lit(True), "reason": F.lit("accepted")})
    retried = spark.createDataFrame([("v", "000", "Это наш дом", 0.9, "deep_vote"), ("v", "003", "", 0.0, "deep_no_text")], "video_id string, frame_id string, text string, confidence double, outcome string")
    got = {r.frame_id: (r.text, r.confidence, r.accepted, r.reason, r.deep) for r in recognise.recovered(chosen, retried).collect()}
    assert got["000"] == ("Это наш дом", 0.9, True, "deep_vote", "recovered")
    assert got["003"] == ("", 0.2, False, "deep_no_text", "rejected")
    assert got["004"] == ("зжшщцкрпт", 0.2, True, "accepted", None)


def test_quality_report_has_the_documents_fields(spark):
    seen = spark.createDataFrame(
        [("v", "1", 1.0, "paddle", "Это дом", True, 0.9, None, None), ("v", "2", 2.0, None, "шум", False, 0.3, "noise_filter:a,b", "rejected"), ("v", "3", 3.0, None, "", False, 0.0, "deep_no_text", None), ("w", "1", 1.0, "paddle", "Где", True, 0.5, None, "recovered")],
        f"{KEYS}, engine string, raw string, emitted boolean, confidence double, rejection string, deep string",
    ).withColumn("text", F.when(F.col("emitted"), F.col("raw")).otherwise(F.lit("")))
    blocks = spark.createDataFrame([("v", 0.0, 2.0, 0.9), ("w", 0.0, 1.0, 0.5)], "video_id string, start double, end double, confidence double")
    stats = C.gate_stats(spark.createDataFrame([("v", "emit"), ("v", "same"), ("v", "no_text"), ("w", "emit")], "video_id string, state string"))
    statuses = spark.createDataFrame([("v", "ok"), ("v", "failed"), ("v", "timeout"), ("w", "ok")], "video_id string, status string")
    candidates = spark.createDataFrame([("v", True, 10.0), ("v", True, 30.0), ("v", False, 99.0)], "video_id string, has_subtitle boolean, text_bbox_area double")
    report = reports.quality_report(seen, blocks, stats, statuses, candidates)
    assert len(report.columns) == 1 + 29 + 1  # and what only the text shows
    v = report.where("video_id = 'v'").first()
    assert (v.total_frames_sampled, v.frames_with_subtitles, v.skipped_without_subtitles, v.skipped_same_subtitle, v.actual_ocr_calls, v.total_ocr_results) == (3, 2, 1, 1, 1, 5)
    assert (v.successful_ocr_calls, v.failed_ocr_calls, v.timeout_ocr_calls, v.accepted_ocr_results, v.noise_rejected) == (1, 1, 1, 1, 4)
    assert (v.average_text_bbox_area, v.accepted_ratio_warning, v.deep_analysis_attempted, v.deep_analysis_recovered, v.deep_analysis_rejected) == (20.0, "filter_too_aggressive", 1, 0, 1)
    assert [tuple(x) for x in v.rejection_reasons] == [("noise_filter:a", 1), ("b", 1), ("deep_no_text", 1)] and dict(map(tuple, v.confidence_histogram))["0.85-0.95"] == 1
    text = reports.with_timing(reports.report_text(report, seen), stats, blocks).where("video_id = 'v'").first().value
    lines = text.splitlines()
    assert lines[:2] == ["OCR REPORT", "=" * 40] and len([x for x in lines if ": " in x and not x.startswith("- ")]) >= 30
    assert "- [noise_filter:a,b] шум" in lines and "empty_ocr_results: 2" in lines and "engine_counts: {'tesseract': 0, 'paddle': 1}" in lines and "confidence_histogram: {'0.0-0.2': 0, '0.2-0.4': 0, '0.4-0.6': 0, '0.6-0.8': 0, '0.8-1.0': 1}" in lines and not any(x.startswith("- [deep_no_text]") for x in lines) and "average_subtitle_duration: 2.000" in lines
    scanned = reports.scan_report(spark.createDataFrame([(text,)], "value string"), {"timeout_frames": "int", "accepted_ratio": "double", "rejection_reasons": "map"}).first()
    assert (scanned.timeout_frames, scanned.accepted_ratio, scanned.rejection_reasons["b"]) == (1, 0.2, 1)


def test_trials(spark):
    rows = [("a", f"{i:03d}", float(i), "paddle", "Это наш дом" if i % 2 else "x" * 9, 0.5) for i in range(8)] + [("b", "001", 1.0, "paddle", "Стой", 0.5)]
    readings = spark.createDataFrame(rows, f"{KEYS}, engine string, text string, confidence double")
    region = readings.withColumn("text", F.lit("Это наш дом"))
    won = {r.video_id: (r.label, r.preset, r.accepted, r["sample"]) for r in grid.trial(readings, region).collect()}
    assert won == {"a": ("auto-region", "recall", 8, 8), "b": (None, None, None, 1)}
    alone = grid.trial(readings)
    assert alone.where("video_id = 'a'").first().label == "maximum_recall"
    final = grid.chosen_readings(readings, grid.trial(readings, region), region)
    assert {(r.video_id, r.preset, r.cleaned) for r in final.collect()} == {("a", "recall", "Это наш дом"), ("b", "recall", "Стой")}
    hits = lambda n, of: spark.createDataFrame([("a", float(i), i < n) for i in range(of)], "video_id string, time double, has_subtitle boolean")
    assert [grid.region_trial(hits(10, 10), hits(n, 10)).first().use_region for n in (5, 6)] == [False, True]
    kept = grid.region_trial(hits(10, 10), hits(0, 10), spark.createDataFrame([("a", True)], "video_id string, use_region boolean")).first()
    assert (kept.use_region, kept.cached) == (True, True)
    assert grid.region_is_better(6, 10) and not grid.region_is_better(5, 10)


def test_presets_are_judged_by_what_is_emitted(spark):
    """Each preset's readings against the cleaner, then the noise filter, one preset at a time; dropped frames are no hits of the benchmark."""
    texts = ["Это наш дом", "мыы ннадо ббыло", "Да", "", "ЗЖШЩ КРПТ ВВВ", "мы идем домой сейчас", None, "и я к у в", "Это наш дом, где мы жжжжили"]
    rows = [("v", f"{i:02d}", float(i), "paddle", t, i / 10, t is not None, i != 5, "failed" if not t else "ok") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{KEYS}, engine string, text string, confidence double, has_subtitle boolean, changed boolean, status string")
    for mode, sanity in (("standard", "off"), ("mild", "local")):
        got = {(r.preset, r.frame_id): (r.kept, r.emitted, r.rejection) for r in grid.evaluate(df, noise_mode=mode, sanity=sanity).collect()}
        for preset in grid.PRESETS:
            chosen = quality.choose_best(quality.clean(df, preset), ["frame_id"])
            for r in quality.observations(chosen, mode, sanity=sanity).collect():
                why = r.rejection if r.rejection is None or r.accepted else r.rejection.split(":", 1)[1]
                assert got[preset, r.frame_id] == (r.text, r.emitted, why), (mode, preset, r.frame_id)
    ev = grid.evaluate(df)
    assert ev.where("reason = 'accepted' and not emitted").count() > 0
    blocks = spark.createDataFrame([("recall",)] * 3, "preset string")
    b = {r.preset: r for r in grid.benchmark(ev, blocks, spark.createDataFrame([("recall", 0.0)], "preset string, seconds double")).collect()}
    hits = ev.where("preset = 'recall' and emitted and has_subtitle and changed")
    assert (b["recall"].ocr_candidates, b["recall"].ocr_hits, b["recall"].successful_frames) == (7, hits.count(), hits.count())
    assert (b["recall"].failed_frames, b["recall"].timeout_frames, b["recall"].subtitle_blocks, b["strict"].subtitle_blocks) == (1, 0, 3, 0)
    assert (b["recall"].processing_seconds, b["recall"].processing_speed_candidates_per_second, b["strict"].processing_seconds) == (0.001, 9000.0, None)


def test_signature_is_one_of_the_rows_in_any_order(spark):
    rows = [("v", f"{i}", i / 3, i / 3 + 1) for i in range(20)]
    of = lambda r: C.signature(spark.createDataFrame(r, "video_id string, frame_id string, time double, end_time double").repartition(3)).first().digest
    assert of(rows) == of(rows[::-1]) != of(rows[:-1])
    assert of(rows) != of([*rows[:-1], ("v", "x", *rows[-1][2:])])
    boxed = lambda y, seen: [("v", f"{i}", i / 3, i / 3 + 1, y, seen or i < 5, i != 4) for i in range(20)]
    full = "video_id string, frame_id string, time double, end_time double, text_bbox_y1 double, has_subtitle boolean, changed boolean"
    other = lambda r: C.signature(spark.createDataFrame(r, full)).first()
    assert other(boxed(0.5, True)).digest != other(boxed(0.6, True)).digest and other(boxed(0.5, True)).digest == other(boxed(0.50001, True)).digest
    assert (other(boxed(0.5, False)).n, other(boxed(0.5, True)).n) == (4, 19)
    assert C.signature(spark.createDataFrame([], full)).count() == 0


def test_votes_are_merges_of_groups():
    clean, doubtful = B.keep_first_key(False), B.keep_first_key(True)
    a = B.block_reading("домо", "домо", 5.0, 0.8, False)
    b = B.block_reading("домой", "домой", 5.0, 0.7, False)
    assert clean(a, b) == B.Group("домо", "домой", 2, 0.8, 13.0)
    assert doubtful(a, b).text == "домо" and clean(a, B.block_reading("домой", "домой", 5.0, 0.6, False)).text == "домо"
    assert B.block_reading("x", "x", -5.0, 0.5, True).score == 0.0
    groups = B.joined(B.joined(B.joined([], a, 0.82, clean), b, 0.82, clean), B.block_reading("лес", "лес", 9.0, 0.9, False), 0.82, clean)
    assert [g.count for g in groups] == [2, 1] and B.winner(groups).text == "домой"
    session = B.Session(1.2, 0.86, 0.7)
    session.add(0.0, 0.5, "дом", "дом", 1.0, 0.5, False)
    again = B.Session(1.2, 0.86, 0.7).restored(session.state())
    for s in (session, again):
        assert s.add(0.6, 1.0, "дом!", "дом", 1.0, 0.6, False) is None
    assert session.finish() == again.finish() and session.state() is None


def test_urls_caches_and_logs(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" http://a \n\n")
    (tmp_path / "none.txt").write_text("\n \n")
    assert [r.url for r in inputs.urls(spark, str(tmp_path / "urls.txt"), "http://b").collect()] == ["http://a"]
    assert [r.url for r in inputs.urls(spark, str(tmp_path / "none.txt"), " http://b ").collect()] == ["http://b"]
    with pytest.raises(ValueError):
        inputs.urls(spark, None)
    assert inputs.translation_cache(spark, str(tmp_path / "absent")).count() == 0
    for i in range(2):
        inputs.log_rows(spark.createDataFrame([("j", i, f"line {i}")], "job_id string, seq int, message string"), str(tmp_path / "logs"))
    assert [r.message for r in spark.read.parquet(str(tmp_path / "logs")).orderBy("seq").collect()] == ["line 0", "line 1"]


def test_read_loop_routes_and_calls(spark, tmp_path):
    """Each route is taken, late readings are final, slow frames are none, and every engine sees a frame once."""
    texts = {"000": "Это наш дом", "001": "зжшщцкрпт бвгдж", "002": "сломан", "003": "медленно", "004": "", "005": "ббббб вввв жжжжж ддд ггггг зззз", "006": "Да"}
    frames = spark.createDataFrame([("v", k, float(10 * int(k)), bytearray(t.encode())) for k, t in texts.items()], f"{KEYS}, content binary")
    log = tmp_path / "calls"
    log.mkdir()

    def engine(name):
        def read(content: bytes) -> tuple[str, float]:
            text = content.decode()
            (log / f"{name}-{uuid.uuid4().hex}").write_text(text)
            if name == "first" and text == "сломан":
                raise OSError("broken")
            if name == "first" and text == "медленно":
                time.sleep(3)
            return {"first": (text, 0.5), "fallback": ("Где наш дом", 0.4), "late": ("Это наш лес" if text else "", 0.6)}[name]

        return {{"first": "paddle", "fallback": "tesseract", "late": "third"}[name]: lambda: read}

    seen = {r.frame_id: r for r in recognise.read_loop(frames, engine("first"), engine("fallback"), engine("late"), seconds=1.0).collect()}
    assert set(seen) == set(texts) - {"003"}
    assert (seen["000"].route, seen["000"].text, seen["000"].engine, seen["000"].emitted) == ("clean", "Это наш дом", "paddle", True)
    assert (seen["002"].text, seen["002"].engine) == ("Где наш дом", "tesseract")
    assert seen["001"].route == "late" and seen["004"].route == "late" and not seen["004"].emitted and "third:" in seen["004"].rejection
    assert seen["005"].route == "late" and seen["006"].route == "clean"
    calls = [(f.name.split("-")[0], f.read_text()) for f in log.iterdir()]
    assert len(calls) == len(set(calls)) and ("late", "Это наш дом") not in calls and ("late", "медленно") not in calls


def test_recovered_looks_at_doubtful_texts_only(spark):
    """Frames that weren't retried, or were recovered, aren't judged for noise; what the retry leaves is as before."""
    from subloom.operators import recognise as R

    chosen = spark.createDataFrame([("v", "1", "zr tk", 0.5, "accepted", True), ("v", "2", "zr tk", 0.5, "accepted", True), ("v", "3", "zr tk", 0.5, "accepted", True)], "video_id string, frame_id string, text string, confidence double, reason string, accepted boolean")
    retried = spark.createDataFrame([("v", "1", "дом у реки", 0.9, "deep_vote"), ("v", "2", "", 0.0, "deep_no_text")], "video_id string, frame_id string, text string, confidence double, outcome string")
    out = R.recovered(chosen, retried)
    assert {(r.frame_id, r.text, r.accepted, r.deep) for r in out.collect()} == {("1", "дом у реки", True, "recovered"), ("2", "", False, "rejected"), ("3", "zr tk", True, None)}
    assert "_doubt" in out._jdf.queryExecution().analyzed().toString()
