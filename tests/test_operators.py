"""Operators on small tables, and the registered queries' shape."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from subloom import config, schema, sql
from subloom.config import Crop, Options
from subloom.functions import arrays
from subloom.operators import blocks as B
from subloom.operators import candidates as C
from subloom.operators import enrich, grid, quality, recognise, reports, timeline
from subloom.sources import inputs, srt

SF = "/root/testdata/sf0.001"
OBS = "video_id string, frame_id string, time double, end double, text string, score double, confidence double"


def observations(spark, rows):
    return spark.createDataFrame([("v", f"{i:04d}", *r) for i, r in enumerate(rows)], OBS)


def blocks_of(spark, rows, **options):
    return [(r.start, r.end, r.text, r.confidence) for r in B.build_blocks(observations(spark, rows), **options).orderBy("block_no").collect()]


def test_blocks_keep_confidence(spark):
    rows = [(1.0, 2.0, "Привет", 10.0, 0.42), (3.0, 4.0, "Пойдем домой", 12.0, 0.81)]
    got = blocks_of(spark, rows)
    assert [b[3] for b in got] == [0.42, 0.81]
    exact = B.blocks_of_equal(observations(spark, rows)).orderBy("block_no").collect()
    assert [(r.start, r.end, r.text, r.confidence) for r in exact] == got


def test_block_joining(spark):
    same = lambda a, b, gap: blocks_of(spark, [(*a, "Привет", 1.0, 0.5), (*b, "Привет!", 1.0, 0.5)], max_gap=gap)
    assert [b[:2] for b in same((0.0, 0.5), (0.5, 1.0), 1.2)] == [(0.0, 1.0)]
    assert len(same((1.0, 2.0), (3.25, 4.0), 1.25)) == 1
    assert len(same((1.0, 2.0), (3.2, 4.0), 1.2)) == 2  # 3.2 - 2.0 is more than 1.2 in binary
    assert blocks_of(spark, [(1.0, 1.2, "дом", 1.0, 0.5)])[0][1] == 1.7
    assert blocks_of(spark, []) == []


def test_missing_fields_get_defaults(spark):
    df = spark.createDataFrame([("v", 1.0, "Привет")], "video_id string, time double, text string")
    r = schema.normalize_observations(df, 0.5).first()
    assert (r.end, r.confidence) == (1.5, 0.0)
    assert r.score == pytest.approx(6 * 1.8 + 6 * 0.2 + 25)


def test_vote_prefers_longer_confident_clean_text(spark):
    rows = [(0.0, 0.5, "Пойдем домо", 5.0, 0.8), (0.5, 1.0, "Пойдем домой", 5.0, 0.79), (1.0, 1.5, "Пойдем домой", 5.0, 0.6)]
    assert [b[2:] for b in blocks_of(spark, rows)] == [("Пойдем домой", 0.8)]


def test_folds_don_t_depend_on_input_order_or_company(spark):
    draw = random.Random(1)
    rows = [(v, f"{i:04d}", i * 0.5, i * 0.5 + 0.5, draw.choice(["дом", "лес", "дом!"]), 1.0, draw.random()) for v in ("a", "b") for i in range(60)]
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(B.build_blocks(spark.createDataFrame(rows, OBS)))
    draw.shuffle(rows)
    assert key(B.build_blocks(spark.createDataFrame(rows, OBS))) == whole
    apart = [x for v in ("a", "b") for x in key(B.build_blocks(spark.createDataFrame([r for r in rows if r[0] == v], OBS)))]
    assert sorted(apart) == whole
    assert all(end - start >= 0.7 - 1e-9 for _, _, start, end, *_ in whole)


def test_neighbour_filter(spark):
    rows = [("v", 1, 0.0, 1.0, "посмотрите сюда", 0.0, 0.5), ("v", 2, 1.0, 2.0, "ой ай", 0.0, 0.5), ("v", 3, 2.0, 3.0, "дорога домой", 0.0, 0.5), ("v", 4, 3.0, 4.0, "аб дорога аб", 0.0, 0.5)]
    df = spark.createDataFrame(rows, schema.BLOCKS)
    assert sorted(r.block_no for r in B.neighbour_filter(df).collect()) == [1, 3, 4]


def test_shown_texts_are_alike_in_their_spellings_only():
    """What the SQL of the deep votes takes for granted: one group of votes is one text's spellings."""
    from subloom.plans.queries import SHOWN

    key = lambda x: "".join(c for c in x.lower() if c.isalnum())
    texts = [x for xs in SHOWN.values() for x in xs if x]
    for a in texts:
        for b in texts:
            alike = {B.likeness(key(a + i), key(b + j)) >= B.DEEP_SIMILARITY for i in ("", "s", "!") for j in ("", "s", "!")}
            assert alike == {a == b}, (a, b)


def test_deep_vote_outcomes(spark):
    rows = [
        ("v", "1", 0, 0, "мы идем домой", 0.5), ("v", "1", 1, 0, "мы идем домои", 0.9), ("v", "2", 0, 0, "да", 0.4), ("v", "3", 0, 0, "", 0.4), ("v", "4", 0, 0, "бвгд", 0.4), ("v", "5", 0, 0, "дорога светлая", 0.4),
    ]
    df = spark.createDataFrame(rows, "video_id string, frame_id string, neighbour_rank int, variant_rank int, text string, confidence double")
    got = {r.frame_id: (r.outcome, r.text, r.confidence) for r in B.deep_vote(df).collect()}
    assert got["1"] == ("deep_vote", "мы идем домои", 0.9)
    assert got["2"] == ("deep_valid_short", "да", 0.4)
    assert got["3"] == ("deep_no_text", "", 0.0)
    assert got["4"][0].startswith("deep_rejected_language_validity:")
    assert got["5"] == ("deep_single_valid", "дорога светлая", 0.4)


def test_choice_prefers_the_first_engine_on_ties(spark):
    rows = [(1, "paddle", "мы идем домой", 0.5), (1, "tesseract", "мы идем домой", 0.5), (2, "paddle", "привет друзья мои", 0.9), (2, "tesseract", "qq", 0.9), (3, "paddle", "", 0.1), (3, "tesseract", "ww", 0.1)]
    df = quality.clean(spark.createDataFrame(rows, "frame int, engine string, text string, confidence double"), "recall")
    got = {r.frame: r for r in quality.choose_best(df, ["frame"]).collect()}
    assert (got[1].engine, got[2].engine, got[3].engine) == ("tesseract", "paddle", None)
    assert got[3].reason == "tesseract:empty_after_cleanup; paddle:empty_after_cleanup"
    seen = quality.observations(quality.choose_best(df, ["frame"]))
    assert {r.reason: r.n for r in quality.rejection_counts(seen).collect()} == {"tesseract:empty_after_cleanup; paddle:empty_after_cleanup": 1}


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.25, 0.45, 0.65, 0.95)], "c double")
    assert {r.bin: r.n for r in reports.histogram(df, "c").collect()} == dict.fromkeys(("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"), 1)
    df = spark.createDataFrame([(x,) for x in (0.49, 0.5, 0.7, 0.85, 0.95)], "c double")
    assert [r.n for r in reports.histogram(df, "c", reports.QUALITY_BINS).collect()] == [1] * 5
    edge = spark.createDataFrame([(1.0,), (-0.5,), (None,)], "c double")
    assert {r.bin: r.n for r in reports.histogram(edge, "c").collect()} == {"0.0-0.2": 1, "0.2-0.4": 0, "0.4-0.6": 0, "0.6-0.8": 0, "0.8-1.0": 1}


def test_report_scan_and_html(spark):
    df = spark.createDataFrame([("timeout_frames: 3\nfailed_frames: 2\nmean: 0.5\nreasons: {'a': 2}\n",)], "value string")
    r = reports.scan_report(df, {"timeout_frames": "int", "failed_frames": "int", "missing": "int", "mean": "double", "reasons": "map", "other": "string"}).first()
    assert (r.timeout_frames, r.failed_frames, r.missing, r.mean, r.reasons, r.other) == (3, 2, 0, 0.5, {"a": 2}, "")
    row = spark.createDataFrame([("recall", 100, 90, 80, 0.7, 1, 2, 3.5)], "preset string, ocr_candidates bigint, ocr_hits bigint, subtitle_blocks bigint, average_confidence double, timeout_frames bigint, failed_frames bigint, processing_speed_candidates_per_second double")
    page = grid.benchmark_html(row).first().html
    assert all(x in page for x in ("OCR benchmark", "<td>recall</td>", "<td>100</td>", "<td>0.700</td>", "<td>3.50</td>"))


def test_masks_and_boxes(spark):
    m = "array<boolean>"
    rows = [([True, False], [True, True]), ([False], [False]), (None, [True]), ([True], [True, True])]
    df = spark.createDataFrame(rows, f"a {m}, b {m}")
    assert [r[0] for r in df.select(arrays.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.0]
    kind = "array<struct<x:int,y:int,w:int,h:int,area:int>>"
    letters = [(200 + 40 * i, 140, 30, 24, 300) for i in range(6)]
    df = spark.createDataFrame([(letters,), ([],), ([(0, 0, 5, 5, 20)],)], f"c {kind}")
    kept = arrays.kept_components(F.col("c"), F.lit(640), F.lit(200))
    out = df.select(F.size(kept).alias("n"), arrays.is_subtitle(kept, F.lit(640), F.lit(200), F.lit(0.1), F.lit(0.1)).alias("s")).collect()
    assert [(r.n, r.s) for r in out] == [(6, True), (0, False), (0, False)]
    texts = spark.createDataFrame([(["Привет", "мир"], [0.9, 0.8]), ([], [])], "t array<string>, s array<double>")
    got = [r[0] for r in texts.select(arrays.reading(F.col("t"), F.col("s"))).collect()]
    assert [(r.text, round(r.confidence, 6)) for r in got] == [("Привет мир", 0.85), ("", 0.0)]


def test_gate(spark):
    on, off = [True] * 8 + [False] * 8, [False] * 8 + [True] * 8
    frames = [(0.0, True, on), (0.5, True, on), (1.0, True, off), (1.5, False, None), (2.0, True, off), (5.0, True, off)]
    rows = [("v", f"{i}", t, d, m, [0.0] * 4) for i, (t, d, m) in enumerate(frames)]
    df = spark.createDataFrame(rows, "video_id string, frame_id string, time double, detected boolean, mask array<boolean>, small array<double>")
    got = C.gate_frames(df, rate=0.5).orderBy("time").collect()
    assert [r.state for r in got] == ["emit", "same", "emit", "no_text", "emit", "same"]
    assert [r.end_time for r in got if r.state == "emit"] == [1.0, 1.5, 5.5]
    s = C.gate_stats(C.gate_frames(df, rate=0.5)).first()
    assert (s.sampled, s.with_text, s.skipped_no_text, s.skipped_same, s.calls) == (6, 5, 1, 2, 3)


def test_diff_mode_islands(spark):
    rows = [("v", float(i), [float(x)] * 4) for i, x in enumerate((0, 0, 9, 9, 9, 0))]
    df = spark.createDataFrame(rows, "video_id string, time double, small array<double>")
    got = C.detect_changes(df, rate=1.0).orderBy("island").collect()
    assert [(r.time, r.end_time, r.frames) for r in got] == [(0.0, 2.0, 2), (2.0, 5.0, 3), (5.0, 6.0, 1)]


def test_grid_and_neighbours_in_time(spark):
    videos = spark.createDataFrame([("v", 2.0)], "video_id string, duration_s double")
    assert [r.time for r in C.sample_grid(videos, 0.5).orderBy("index").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0]
    frames = spark.createDataFrame([("v", f"{i}", i * 0.25) for i in range(20)], "video_id string, frame_id string, time double")
    got = C.neighbours(frames).where("frame_id = '10'").orderBy("rank").collect()
    assert [r.neighbour_id for r in got] == ["10", "9", "11", "8", "12"]


def test_glossary_and_audit(spark):
    df = spark.createDataFrame([("v", 1, 1.0, 2.5, "KRISHNA met radha", 0.0, 0.5), ("v", 2, 3.0, 4.0, "Krishna", 0.0, 0.5)], schema.BLOCKS)
    out = enrich.rewrite_terms(df)
    assert [(r.text, r.terms) for r in out.orderBy("block_no").collect()] == [("Krishna met Radha", ["glossary:Krishna", "glossary:Radha"]), ("Krishna", [])]
    audit = enrich.corrections(out).collect()
    assert [(r["index"], r.start, r.end, r.reason) for r in audit] == [(1, "00:00:01,000", "00:00:02,500", "glossary:Krishna, glossary:Radha")]


def test_translation_uses_cache_and_never_caches_failures(spark):
    df = spark.createDataFrame([("v", i, float(i), i + 1.0, t, 0.0, 0.5) for i, t in enumerate(("дом", "лес", "лес", "...", "гора"))], schema.BLOCKS)
    cache = spark.createDataFrame([("дом", "dům")], "source_text string, target_text string")
    out, fresh = enrich.translate(df, cache, lambda texts: ["les" if t == "лес" else None for t in texts])
    assert [(r.translated, r.status) for r in out.orderBy("block_no").collect()] == [("dům", "cached"), ("les", "translated"), ("les", "translated"), ("...", "empty"), ("гора", "failed")]
    assert [tuple(r) for r in fresh.collect()] == [("лес", "les")]
    r = enrich.translation_summary(out).first()
    assert (r.total_blocks, r.failed_blocks, r.translated_blocks, r.unique_misses, r.status) == (5, 1, 4, 2, "completed_with_errors")


def test_timing_conformance(spark):
    a = spark.createDataFrame([("v", 1, 0.0, 1.0, "", 0.0, 0.0), ("v", 2, 1.0, 2.0, "", 0.0, 0.0)], schema.BLOCKS)
    moved = a.withColumn("end", F.col("end") + 0.002)
    assert [enrich.timing_conformance(a, b).first().conformant for b in (a, moved, a.where("block_no = 1"))] == [True, False, False]


def test_recognition_failures_are_rows(spark):
    def make():
        def read(content: bytes):
            if content == b"bad":
                raise ValueError("no image")
            return content.decode(), 0.5

        return read

    df = spark.createDataFrame([("v", "1", 0.0, bytearray(b"ok")), ("v", "2", 1.0, bytearray(b"bad")), ("v", "3", 2.0, None)], "video_id string, frame_id string, time double, content binary")
    got = recognise.read(df, {"a": make}).orderBy("frame_id").collect()
    assert [(r.text, r.status) for r in got] == [("ok", "ok"), ("", "failed"), ("", "missing")]
    assert recognise.variants(df).count() == 3 * 24
    assert recognise.call_with_timeout(lambda: __import__("time").sleep(2), 0.05)[0] == "timeout"


def test_timeline(spark):
    rows = [(1, i, m) for i, m in enumerate(["Video uloženo", "Video uloženo", "yt-dlp", "OCR frame 1/2", "x"])]
    logs = spark.createDataFrame(rows, "job_id int, seq int, message string")
    events = timeline.progress_events(logs)
    assert [r.progress for r in events.orderBy("seq").collect()] == [30, 30, 30, 48, 48]
    assert timeline.without_repeats(logs).count() == 4
    assert sorted(r.seq for r in timeline.last_n(logs, 2).collect()) == [3, 4]
    jobs = spark.createDataFrame([(1, "u"), (2, "w")], "job_id int, url string")
    assert timeline.batch_progress(events, jobs).first().overall_progress == 24
    assert timeline.batch_progress(events, jobs.limit(0)).first().overall_progress == 0
    none = spark.createDataFrame([], "job_id int, actual_ocr_calls int, subtitle_blocks_generated int")
    more = spark.createDataFrame([(1, 7, "completed")], "job_id int, translated_blocks int, translation_status string")
    got = {r.job_id: (r.progress, r.translated_blocks, r.actual_ocr_calls) for r in timeline.job_status(events, jobs, none, more).collect()}
    assert got == {1: (48, 7, 0), 2: (0, 0, 0)}
    frames = spark.createDataFrame([(1, 100, 200, 50.0), (1, 150, 200, 60.0)], "job_id int, index int, total int, elapsed double")
    assert [r.eta for r in timeline.estimated_end(frames).collect()] == ["00:50"]


def test_configuration(spark):
    old = config.resolve(Options(quality_profile="old_perfect", engine="tesseract"))
    assert (old.engine, old.preset, old.crop, old.deep, old.speed) == ("paddle", "recall", Crop(0.02, 0.98, 0.55, 0.98), "none", "quality")
    assert config.resolve(Options(quality_profile="legacy_good", crop=Crop(0.1, 0.9, 0.5, 0.9))).crop == Crop(0.1, 0.9, 0.5, 0.9)
    fast = config.resolve(Options(speed="fast", preset="maximum_recall", engine="tesseract", deep="short"))
    assert (fast.preset, fast.engine, fast.preprocess, fast.deep, fast.sample_rate, fast.detect_mode) == ("recall", "paddle", "subtitle", "none", 0.90, "white-text")
    assert config.resolve(Options(speed="fast", engine="tesseract", disable_paddle=True)).engine == "tesseract"
    assert config.resolve(Options(speed="quality")).deep == "short"
    assert config.preset_values(Options(preset="strict", min_chars=9)) == (0.35, 9, 0.72)
    assert (config.noise_mode(old), config.sanity_mode(old)) == ("off", "off")
    assert config.needs_rerun(Options(speed="quality"), 3600, 449) and not config.needs_rerun(Options(speed="quality"), 3600, 450)
    df = spark.createDataFrame([(60.0,), (3600.0,), (36000.0,)], "d double")
    assert [r[0] for r in df.select(config.call_limit(F.col("d"), "fast")).collect()] == [300, 1440, 1600]
    assert [r[0] for r in df.select(config.call_limit(F.col("d"), "quality")).collect()] == [None] * 3
    for bad in ({"preset": "x"}, {"speed": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        Crop(0.5, 0.4)


def test_model_url():
    assert config.model_url("http://a/", {}) == "http://a"
    assert config.model_url(None, {"OLLAMA_HOST": "b:1", "OLLAMA_BASE_URL": ""}) == "http://b:1"
    assert config.model_url(None, {}, True) == "http://host.docker.internal:11434"


def test_observation_cache(spark):
    runs = inputs.with_digest(spark.createDataFrame([("a", 0.5, None), ("b", 0.5, 1)], "video string, rate double, cap int"), ["video", "rate"])
    cache = runs.where("video = 'a'").withColumn("results", F.lit("r"))
    hits, misses = inputs.cached_observations(cache, runs, ["rate", "cap"])
    assert [r.video for r in hits.collect()] == ["a"] and [r.video for r in misses.collect()] == ["b"]


def test_observation_key_depends_on_each_field(spark):
    """Any option, version, range, file or candidate that changes gives another key; what has no part in readings doesn't."""
    from dataclasses import replace

    run = ("h" * 40, 0.0, None, 3, 1.0, 2.0, "abc")
    kind = "input_hash string, start_time double, end_time double, n bigint, first_time double, last_time double, candidate_digest string"
    o = Options()
    key = lambda o=o, run=run, **more: inputs.observation_key(spark.createDataFrame([run], kind), o, **more).first().cache_key
    base = key()
    assert base == key() == key(replace(o, translator="google")) and base.startswith("h" * 16 + "_")
    changed = {"preset": "strict", "engine": "compare", "sample_rate": 0.5, "crop": config.Crop(0.1), "speed": "quality", "quality_profile": "legacy_good", "max_calls": 5, "detect_changes": True}
    others = [key(replace(o, **{k: v})) for k, v in changed.items()] + [key(version=6)]
    others += [key(run=(*run[:i], v, *run[i + 1 :])) for i, v in enumerate((None, 5.0, 9.0, 4, 1.5, 2.5, "abd"))]
    assert len({base, *others}) == len(others) + 1
    assert key(run=(None, *run[1:])).startswith("no_video_hash_")


def test_region_settings_are_taken_over_whole(spark):
    keys = spark.createDataFrame([("a", "ka"), ("b", "kb"), ("c", "kc")], "video_id string, settings_digest string")
    frames = spark.createDataFrame([(v, float(i), True, 0.8, 0.9) for v in "abc" for i in range(20 if v != "c" else 5)], "video_id string, time double, has_subtitle boolean, text_bbox_y1 double, text_bbox_y2 double")
    first = grid.region_settings(keys, frames, frames.where("video_id = 'a' or time < 3"))
    got = {r.video_id: (r.x1, round(r.y1, 6), round(r.y2, 6), r.use_region, r.cached) for r in first.collect()}
    assert got == {"a": (0.08, 0.74, 0.96, True, False), "b": (0.08, 0.78, 0.93, False, False), "c": (0.08, 0.78, 0.93, False, False)}
    again = grid.region_settings(keys, frames.where("video_id = 'x'"), frames, first.where("video_id <> 'b'"))
    assert {r.video_id: (round(r.y1, 6), r.use_region, r.cached) for r in again.collect()} == {"a": (0.74, True, True), "b": (0.78, False, False), "c": (0.78, False, True)}


def test_srt_round_trip(spark, tmp_path):
    rows = [("v", 1, 1.0, 2.5, "Привет\nмир", 0.0, 0.5), ("v", 2, 0.0, 0.7, "дом", 0.0, 0.5), ("v", 3, 5.0, 6.0, " ", 0.0, 0.5), ("w", 1, 0.0, 3723.25, "лес", 0.0, 0.5)]
    df = spark.createDataFrame(rows, schema.BLOCKS)
    want = [("v", 1, 0.0, 0.7, "дом"), ("v", 2, 1.0, 2.5, "Привет\nмир"), ("w", 1, 0.0, 3723.25, "лес")]
    srt.register(spark)
    df.select("video_id", "block_no", "start", "end", "text").coalesce(1).write.format("srt").mode("append").save(str(tmp_path / "out"))
    back = lambda d: sorted(tuple(r) for r in d.collect())
    assert back(spark.read.format("srt").load(str(tmp_path / "out"))) == want
    assert back(srt.read(spark, str(tmp_path / "out"))) == want
    srt.write(df, str(tmp_path / "text"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "text" / "video_id=v").glob("part-*"))
    assert [c[3] for c in srt.parse(text)] == ["дом", "Привет\nмир"]


def test_sql_registration(spark):
    sql.register(spark, {"obs": spark.createDataFrame([(" A  b ",)], "t string")})
    r = spark.sql("SELECT subloom_normalize(t) n, subloom_merge_key(t) k, subloom_ratio('tide', 'diet') s, subloom_srt_time(1.234D) c, subloom_count('abc1', 'a-z') l, (SELECT count(*) FROM presets) p FROM obs").first()
    assert tuple(r) == ("A b", "ab", 0.25, "00:00:01,234", 3, 4)


def test_preset_search(spark):
    rows = [("v", "paddle", "мы идем домой сейчас", 0.5), ("v", "paddle", "да", 0.5)]
    df = spark.createDataFrame(rows, "video_id string, engine string, text string, confidence double")
    best = grid.best_preset(grid.scores(grid.evaluate(df), ["video_id"]), ["video_id"]).first()
    assert (best.preset, best.accepted, best.sample) == ("maximum_recall", 2, 2)
    assert grid.region_is_better(7, 10) is True and grid.region_is_better(3, 1) is False


def test_every_query_has_unique_columns_and_a_plan(spark):
    names = entry.engine.QUERIES
    assert set(entry.engine.ORACLE_SQL) <= set(names)
    assert entry.entry(spark).count() > 0
    for name in ("confidence_hist_equal", "blocks_exact", "srt_lines", "gap_sessions"):
        df = names[name](spark, SF)
        assert len(set(df.columns)) == len(df.columns)


def test_scans_are_pruned(spark):
    plan = entry.engine.QUERIES["confidence_hist_equal"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
