"""Registered queries of the engine, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Crop, Options, call_limit, presets_table
from ..functions import arrays, timecode
from ..functions import text as T
from ..functions.scripts import LATIN
from ..functions.similarity import similarity
from ..operators import blocks as B
from ..operators import candidates as C
from ..operators import enrich, grid, quality, recognise, reports, timeline
from ..schema import BLOCKS
from ..shared import noted, scratch, settled, written
from ..sources import inputs, srt
from ..streaming import late, sessions
from ..streaming.ordered import session_with_store
from . import oracle as O
from . import tables as tab
from . import vision

DAY_HALF = 43200.0
TERMS = {"the": "The", "of": "OF", "and": "and", "le": "Le", "der": "DER"}


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return tab.document_readings(spark, d).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


def merge_key(spark: SparkSession, d: str) -> DataFrame:
    return tab.document_readings(spark, d).select("doc_id", T.merge_key(F.col("text")).alias("key"))


def char_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    n = lambda c: c.cast("bigint")
    return tab.document_readings(spark, d).select(
        "doc_id",
        n(T.count_script(t, LATIN)).alias("script_letters"),
        n(T.count_letters(t)).alias("letters"),
        n(T.count_foreign(t, LATIN)).alias("foreign_letters"),
        n(T.count_symbols(t)).alias("symbols"),
        n(F.char_length(T.meaningful(t))).alias("meaningful"),
        n(F.size(T.words(t, LATIN))).alias("words"),
        n(T.count_vowels(t, LATIN)).alias("vowels"),
        n(T.common_count(t, LATIN)).alias("common_words"),
        T.is_valid_short(t, LATIN).alias("valid_short"),
    )


def ocr_score(spark: SparkSession, d: str) -> DataFrame:
    return tab.document_readings(spark, d).select("doc_id", F.round(T.candidate_score(F.col("text"), F.col("confidence"), LATIN), 4).alias("score"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return grid.evaluate(tab.document_readings(spark, d), script=LATIN)


def clean_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return grid.cleaned(tab.document_readings(spark, d), script=LATIN).groupBy("preset", "reason").agg(F.count("*").alias("n"))


def noise_reasons(spark: SparkSession, d: str) -> DataFrame:
    df = tab.document_readings(spark, d)
    return df.select("doc_id", F.array_join(T.noise_reasons(F.col("text"), LATIN), ",").alias("reasons"))


def best_reading(spark: SparkSession, d: str) -> DataFrame:
    df = quality.clean(tab.document_readings(spark, d), "balanced", LATIN)
    return quality.choose_best(df, ["frame_id"], script=LATIN).select("frame_id", "accepted", "engine", "text", F.round("confidence", 6).alias("confidence"), F.round("score", 4).alias("score"))


def rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    df = quality.clean(tab.document_readings(spark, d), "balanced", LATIN)
    return quality.rejection_counts(df, "reason").where("reason <> 'accepted'")


def engine_counts(spark: SparkSession, d: str) -> DataFrame:
    df = quality.clean(tab.document_readings(spark, d), "balanced", LATIN)
    chosen = quality.choose_best(df, ["frame_id"], script=LATIN).where("accepted")
    return reports.engine_counts(chosen, spark.createDataFrame([("tesseract",), ("paddle",), ("compare",)], "engine string"))


def confidence_hist_equal(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(tab.event_readings(spark, d), "confidence", reports.EQUAL_BINS)


def confidence_hist_quality(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(tab.event_readings(spark, d), "confidence", reports.QUALITY_BINS)


def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    df = tab.event_readings(spark, d).withColumn("accepted", F.col("confidence") >= 0.1)
    out = reports.confidence_stats(df, ["text"])
    return out.select("text", "calls", "n_accepted", *[F.round(c, 6).alias(c) for c in ("avg_confidence", "median_confidence", "accepted_ratio")], "low_yield")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("video_id", "block_no", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text", F.round("confidence", 6).alias("confidence"), F.col("readings").cast("bigint").alias("readings"))


def blocks_exact(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every video's readings as blocks, without Python."""
    return _rounded(B.blocks_of_equal(tab.event_readings(spark, d), max_gap=DAY_HALF, order=("time", "event_id")))


def blocks_voted(spark: SparkSession, d: str) -> DataFrame:
    """The same through the similarity fold with votes; event names are never alike, so results agree."""
    return _rounded(B.build_blocks(tab.event_readings(spark, d), max_gap=DAY_HALF, script=LATIN))


def block_report(spark: SparkSession, d: str) -> DataFrame:
    blocks = B.blocks_of_equal(tab.event_readings(spark, d), max_gap=DAY_HALF, order=("time", "event_id"))
    return reports.average_duration(blocks, ["video_id"]).select("video_id", "blocks", F.round("avg_duration", 3).alias("avg_duration"))


def block_votes(spark: SparkSession, d: str) -> DataFrame:
    out = B.block_votes(tab.event_readings(spark, d), ["video_id"], LATIN)
    return out.select("video_id", "text", F.col("votes").cast("bigint").alias("votes"), F.col("groups").cast("bigint").alias("groups"), F.round("confidence", 6).alias("confidence"))


#: Words that stand for the event types where texts are to be alike, and short texts of noise and sense.
SPELLINGS = ("{} of the page", "{} of the pages", "{spaced} of the page", "{} of the page!")
SHORT_TEXTS = ("qv xz wk", "qv xz wkl", "the river was cold", "zr tk", "qv xz wk and the stone", "no", "mnb vcx", "mnb vcxy")


def _alike_readings(spark: SparkSession, d: str) -> DataFrame:
    """Events whose texts are spellings of their type: one has letters apart, which makes it suspicious."""
    kind = F.col("text")
    spaced = F.btrim(F.regexp_replace(kind, "(.)", "$1 "))
    each = [F.concat(spaced if "{spaced}" in x else kind, F.lit(x.partition("}")[2])) for x in SPELLINGS]
    text = F.get(F.array(*each), (F.col("event_id") % len(SPELLINGS)).cast("int"))
    return tab.event_readings(spark, d).withColumn("text", text)


def blocks_alike(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and votes over texts that are alike: the longest spelling that is confident enough and beyond doubt wins."""
    out = B.build_blocks(_alike_readings(spark, d), max_gap=DAY_HALF, script=LATIN)
    return _rounded(out.withColumn("score", F.round("score", 4))).join(out.select("video_id", "block_no", F.round("score", 4).alias("score")), ["video_id", "block_no"])


def votes_alike(spark: SparkSession, d: str) -> DataFrame:
    out = B.block_votes(_alike_readings(spark, d), ["video_id"], LATIN)
    return out.select("video_id", "text", F.col("votes").cast("bigint").alias("votes"), F.col("groups").cast("bigint").alias("groups"), F.round("score", 4).alias("score"), F.round("confidence", 6).alias("confidence"))


def neighbor_noise_alike(spark: SparkSession, d: str) -> DataFrame:
    """Short texts in order of events: noise stays only beside a text that is like it and no noise itself."""
    w = Window.partitionBy("video_id").orderBy("time", "event_id")
    text = F.get(F.lit(list(SHORT_TEXTS)), F.pmod(F.col("event_id") * 7 + F.floor(F.col("event_id") / 3), F.lit(len(SHORT_TEXTS))).cast("int"))
    blocks = tab.event_readings(spark, d).select("video_id", "event_id", F.row_number().over(w).alias("block_no"), text.alias("text"))
    return B.neighbour_filter(blocks, LATIN).select("video_id", "block_no", "text")


def neighbor_noise(spark: SparkSession, d: str) -> DataFrame:
    return B.neighbour_filter(tab.conversation_blocks(spark, d), LATIN).select("video_id", "block_no", "text")


def change_detection_diff(spark: SparkSession, d: str) -> DataFrame:
    out = C.detect_changes(tab.embedding_frames(spark, d), threshold=0.14, rate=0.75)
    return out.select("video_id", F.col("island").cast("bigint").alias("island"), "time", "end_time", F.round("diff_score", 6).alias("diff_score"), "frames")


def mask_jaccard(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("vec_id")
    df = tab.embedding_frames(spark, d).withColumn("m", arrays.mask(F.col("small")))
    return df.withColumn("b", F.lag("m").over(w)).select("vec_id", F.round(arrays.jaccard(F.col("b"), F.col("m")), 6).alias("jaccard"))


def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    frames = tab.embedding_frames(spark, d)
    return C.extraction_stats(frames.drop("small"), C.detect_changes(frames, threshold=0.14))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    df = tab.embedding_frames(spark, d)
    frames = df.select("video_id", F.format_string("%012d", "vec_id").alias("frame_id"), "time", (F.element_at("small", 1) > -0.1).alias("detected"), arrays.mask(F.col("small")).alias("mask"), "small")
    return C.gate_frames(frames, threshold=0.2, similarity=0.4)


def gate_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.gate_stats(_gated(spark, d))


def gate_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every frame's state, difference and end."""
    return _gated(spark, d).select("video_id", "time", "end_time", F.round("diff_score", 6).alias("diff_score"), "state")


def common_region(spark: SparkSession, d: str) -> DataFrame:
    df = tab.embedding_frames(spark, d)
    y = lambda i: (0.7 + F.element_at("small", i).cast("double") / 2)
    out = C.common_region(df.select("video_id", "time", y(1).alias("text_bbox_y1"), y(2).alias("text_bbox_y2")))
    return out.select("video_id", F.round("y1", 6).alias("y1"), F.round("y2", 6).alias("y2"))


def temporal_neighbors_top5(spark: SparkSession, d: str) -> DataFrame:
    out = C.neighbours(tab.event_readings(spark, d).select("video_id", "frame_id", "time"), window=7200.0)
    return out.select("video_id", "frame_id", "neighbour_id", F.round("distance", 3).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def call_cap(spark: SparkSession, d: str) -> DataFrame:
    """Users are dealt to eight videos of seven and a half minutes to an hour, so each rule of the cap decides somewhere."""
    df = tab.event_readings(spark, d).withColumn("video_id", F.col("user_id") % 8)
    spans = df.groupBy("video_id").agg(((F.max("time") - F.min("time")) * (F.col("video_id") + 1) / 5760).alias("duration"))
    kept = quality.first_n(df.join(spans, "video_id").withColumn("cap", call_limit(F.col("duration"), "fast")), ["video_id"], [F.col("time"), F.col("event_id")], F.col("cap"))
    return kept.groupBy("video_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_id"), F.any_value("cap").cast("bigint").alias("cap"))


def preset_grid(spark: SparkSession, d: str) -> DataFrame:
    out = grid.scores(_evaluated(spark, d), ["video_id"])
    return out.select("video_id", "preset", "sample", "accepted", "dropped", *[F.round(c, 4).alias(c) for c in ("avg_confidence", "avg_score", "noise_ratio", "composite")])


def preset_choice(spark: SparkSession, d: str) -> DataFrame:
    return grid.best_preset(grid.scores(_evaluated(spark, d), ["video_id"]), ["video_id"])


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Documents as frames, a text without a letter as one without subtitle; a preset's run takes a second more than the one before."""
    frames = tab.document_readings(spark, d).withColumn("has_subtitle", F.col("text").rlike(r"\p{L}"))
    ev = written(grid.evaluate(frames, script=LATIN).select("preset", "video_id", "frame_id", "doc_id", "has_subtitle", "emitted", "kept", "score", "confidence"), "evaluated")
    ok = ev.where("has_subtitle and emitted").select("preset", F.concat_ws("/", "preset", "video_id").alias("video_id"), F.col("frame_id").cast("double").alias("time"), (F.col("frame_id") + 0.75).alias("end"), F.col("kept").alias("text"), "score", "confidence", "doc_id")
    blocks = B.blocks_of_equal(ok, order=("time", "doc_id")).withColumn("preset", F.element_at(F.split("video_id", "/"), 1))
    return grid.benchmark(ev, blocks, presets_table(spark).select("preset", (F.col("rank") + 1.0).alias("seconds")))


def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark page: one row, as its readers open one page."""
    mark = noted(spark)
    return settled(grid.benchmark_html(_benchmark(spark, d)), "benchmark-page", mark)


def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    mark = noted(spark)
    out = settled(_benchmark(spark, d), "benchmark", mark)
    return out.withColumns({c: F.round(c, 6) for c in ("average_confidence", "median_confidence", "processing_seconds", "processing_speed_candidates_per_second")})


def _seen(spark: SparkSession, d: str, preset: str) -> DataFrame:
    """Documents as observations: two are a frame's two engines."""
    chosen = quality.choose_best(quality.clean(tab.document_readings(spark, d), preset, LATIN), ["frame_id"], script=LATIN)
    return quality.observations(chosen, script=LATIN).withColumn("time", F.col("frame_id").cast("double"))


def _seen_blocks(seen: DataFrame) -> DataFrame:
    rows = seen.where("emitted").select(F.concat(F.lit("v"), (F.col("frame_id") % 64).cast("string")).alias("video_id"), "time", (F.col("time") + 0.75).alias("end"), "text", "score", "confidence")
    return B.blocks_of_equal(rows, max_gap=64.0)


def _listed(c: str, name: str) -> F.Column:
    """Pairs of a name and a count as ``name=count``, in their order."""
    return F.array_join(F.transform(F.col(c), lambda e: F.concat(e[name], F.lit("="), e["n"].cast("string"))), "; ")


def ocr_report(spark: SparkSession, d: str) -> DataFrame:
    mark = noted(spark)
    seen = written(_seen(spark, d, "recall"), "observations")
    out = settled(reports.ocr_report(seen, _seen_blocks(seen)), "ocr-report", mark)
    rounded = [F.round(c, 6).alias(c) for c in ("average_confidence", "median_confidence", "average_subtitle_duration", "accepted_ratio")]
    return out.select("actual_ocr_calls", "accepted", "rejected", *rounded, "subtitle_blocks_generated", _listed("confidence_histogram", "bin").alias("histogram"), _listed("rejection_reasons", "reason").alias("rejections"))


def _report_parts(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Observations of four videos, their blocks, the gate's counts, reading statuses and candidates."""
    seen = written(_seen(spark, d, "recall").withColumn("video_id", F.concat(F.lit("v"), (F.col("frame_id") % 4).cast("string"))), "observations")
    blocks = B.blocks_of_equal(seen.where("emitted").withColumn("end", F.col("time") + 0.75), max_gap=4.0)
    frames = tab.document_readings(spark, d).select(F.concat(F.lit("v"), (F.col("frame_id") % 4).cast("string")).alias("video_id"), "doc_id", "confidence")
    state = F.when(F.col("doc_id") % 5 == 0, "no_text").when(F.col("doc_id") % 7 == 0, "same").otherwise("emit")
    stats = C.gate_stats(frames.withColumn("state", state))
    statuses = frames.select("video_id", F.when(F.col("doc_id") % 17 == 0, "failed").when(F.col("doc_id") % 23 == 0, "timeout").otherwise("ok").alias("status"))
    candidates = frames.select("video_id", (F.col("doc_id") % 3 > 0).alias("has_subtitle"), (F.col("confidence") * 100).alias("text_bbox_area"))
    return seen, blocks, stats, statuses, candidates


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    mark = noted(spark)
    report = settled(reports.quality_report(*_report_parts(spark, d), raw_srt="raw.srt"), "quality-report", mark)
    rounded = {c: F.round(c, 6) for c in ("average_text_bbox_area", "accepted_ratio", "average_confidence", "median_confidence")}
    maps = {"rejection_reasons": _listed("rejection_reasons", "reason"), "confidence_histogram": _listed("confidence_histogram", "bin")}
    return report.drop("readings").withColumns(rounded | maps | {"used_crop": F.format_string("%.2f %.2f %.2f %.2f", *[F.col(f"used_crop.{c}") for c in ("x1", "x2", "y1", "y2")])})


def quality_report_text(spark: SparkSession, d: str) -> DataFrame:
    """The text reports' lines, and how often each stands in a report."""
    mark = noted(spark)
    seen, blocks, stats, statuses, candidates = _report_parts(spark, d)
    texts = reports.report_text(reports.quality_report(seen, blocks, stats, statuses, candidates), seen)
    whole = settled(reports.with_timing(texts, stats, blocks), "quality-report-text", mark)
    return whole.select("video_id", F.explode(F.split("value", "\n")).alias("line")).groupBy("video_id", "line").agg(F.count("*").alias("times"))


def preset_trial(spark: SparkSession, d: str) -> DataFrame:
    """The presets on each source's first texts with a letter; the detected region reads the same texts without digits and signs."""
    own = tab.document_readings(spark, d).select("video_id", F.format_string("%012d", "doc_id").alias("frame_id"), F.col("doc_id").cast("double").alias("time"), "doc_id", "engine", "text", "confidence")
    own = own.withColumn("has_subtitle", F.col("text").rlike(r"\p{L}"))
    return grid.trial(own, own.withColumn("text", F.regexp_replace("text", r"[^\p{L}\n ]+", " ")), LATIN, sample=20)


def region_trial(spark: SparkSession, d: str) -> DataFrame:
    e = tab.embedding_frames(spark, d)
    hit = lambda i, least: (F.element_at("small", i) > least).alias("has_subtitle")
    settings = e.select("video_id").distinct().where("video_id = '3'").withColumn("use_region", F.lit(True))
    return grid.region_trial(e.select("video_id", "time", hit(1, -0.05)), e.select("video_id", "time", hit(2, 0.0)), settings, sample=40)


def glossary_rewrite(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.rewrite_terms(tab.conversation_blocks(spark, d), TERMS)
    return out.select("video_id", "block_no", "text", F.array_join("terms", ", ").alias("terms"), F.col("text").eqNullSafe(F.col("original")).alias("unchanged"))


def corrections(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.corrections(enrich.rewrite_terms(tab.conversation_blocks(spark, d), TERMS))
    return out.select("video_id", F.col("index").cast("bigint").alias("index"), "start", "end", "original", "corrected", "reason", "confidence")


def translate_cached(spark: SparkSession, d: str) -> DataFrame:
    blocks = tab.conversation_blocks(spark, d)
    own = T.clean_for_translation(F.col("text"), LATIN)
    cache = blocks.where("role = 'assistant'").select(own.alias("source_text")).distinct().withColumn("target_text", F.concat(F.lit("cs:"), "source_text"))
    out, _ = enrich.translate(blocks, cache, script=LATIN)
    return out.select("video_id", "block_no", "translated", "status")


def translation_summary(spark: SparkSession, d: str) -> DataFrame:
    blocks = tab.conversation_blocks(spark, d)
    cache = spark.createDataFrame([], "source_text string, target_text string")
    out, _ = enrich.translate(blocks, cache, lambda texts: [None if len(t) > 200 else t[::-1] for t in texts], LATIN)
    return enrich.translation_summary(out)


def timing_conformance(spark: SparkSession, d: str) -> DataFrame:
    a = tab.conversation_blocks(spark, d)
    b = a.withColumn("end", F.when((F.col("role") == "user") & (F.col("block_no") > 3), F.col("end") + 0.002).otherwise(F.col("end")))
    return enrich.timing_conformance(a, b)


def srt_lines(spark: SparkSession, d: str) -> DataFrame:
    return srt.cues(tab.conversation_blocks(spark, d)).select("video_id", F.col("block_no").cast("bigint").alias("block_no"), "cue")


def cleanup_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.cleanup_blocks(tab.conversation_blocks(spark, d), True, LATIN).select("video_id", "block_no", "text")


def candidate_signature(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames: a new type is a change, a signup has no text, and its text box is by its value."""
    w = Window.partitionBy("video_id").orderBy("time", "event_id")
    df = tab.event_readings(spark, d).withColumns({"end_time": F.col("end"), "has_subtitle": F.col("text") != "signup", "changed": ~F.col("text").eqNullSafe(F.lag("text").over(w)), "text_bbox_y1": F.col("confidence") / 2, "text_bbox_y2": F.col("confidence") / 2 + 0.125})
    return C.signature(df).select("video_id", "n", F.round("first_time", 3).alias("first_time"), F.round("last_time", 3).alias("last_time"), "digest")


def observation_keys(spark: SparkSession, d: str) -> DataFrame:
    """The cache keys of users' runs: the signature of their events, and as a file's hash that of their number, which every fifth lacks."""
    w = Window.partitionBy("video_id").orderBy("time", "event_id")
    df = tab.event_readings(spark, d).withColumns({"end_time": F.col("end"), "changed": ~F.col("text").eqNullSafe(F.lag("text").over(w))})
    user = F.col("video_id").cast("bigint")
    runs = C.signature(df).withColumnRenamed("digest", "candidate_digest").withColumns({"input_hash": F.when(user % 5 > 0, F.sha1("video_id")), "start_time": F.when(user % 2 > 0, user / 4), "end_time": F.lit(None).cast("double")})
    return inputs.observation_key(runs, KEPT_OPTIONS).select("video_id", "digest", "cache_key")


KEPT_OPTIONS = Options(engine="tesseract", preset="balanced", deep="short", max_calls=500)
REGION_CROP = Crop(0.1, 0.9, 0.6, 0.95)


def region_settings(spark: SparkSession, d: str) -> DataFrame:
    """Crops of labels' videos: those of the first five labels come from an earlier run that looked at more frames."""
    e = tab.embedding_frames(spark, d)
    at = lambda i: F.element_at("small", i).cast("double")
    initial = e.select("video_id", "time", (at(1) > -0.05).alias("has_subtitle"), (0.7 + at(3) / 2).alias("text_bbox_y1"), (0.8 + at(4) / 2).alias("text_bbox_y2"))
    regional = e.select("video_id", "time", (at(2) > 0.02).alias("has_subtitle"))
    number = F.col("video_id").cast("int")
    files = e.where("video_id is not null").select("video_id").distinct().select("video_id", F.concat(F.lit("/media/"), "video_id").alias("path"), (number * 1000).alias("length"), F.timestamp_seconds(number * 60 + 0.5).alias("modificationTime"))
    keys = inputs.settings_key(files, Options(crop=REGION_CROP)).select("video_id", "settings_digest")
    earlier = grid.region_settings(keys.where(number < 5), initial, regional, crop=REGION_CROP, sample=60)
    out = grid.region_settings(keys, initial, regional, earlier, REGION_CROP, sample=20)
    return out.withColumns({c: F.round(c, 6) for c in ("x1", "x2", "y1", "y2")})


def report_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = tab.table(spark, d, "documents")
    text = F.concat(F.lit("title: "), F.col("lang"), F.lit("\nfailed_frames: "), F.col("n_chars").cast("string"), F.lit("\nratio: "), (F.col("doc_id") % 10 / 10).cast("string"), F.lit("\n"))
    df = reports.scan_report(docs.select("doc_id", text.alias("value")), {"failed_frames": "int", "timeout_frames": "int", "ratio": "double", "title": "string"})
    return df.drop("value")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    e = tab.table(spark, d, "events")
    kind = lambda k: F.col("event_type") == k
    n = (F.col("event_id") % 50).cast("string")
    message = (
        F.when(kind("view"), F.concat(F.lit("OCR frame "), n, F.lit("/50")))
        .when(kind("click"), F.lit("Video uloženo"))
        .when(kind("purchase"), F.concat(F.lit("Překlad průběh: "), n, F.lit("/50 titulků")))
        .when(kind("signup"), F.lit("yt-dlp"))
        .otherwise(F.concat(F.lit("note "), "event_type"))
    )
    return e.select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("seq"), "event_id", message.alias("message"))


def progress_ladder(spark: SparkSession, d: str) -> DataFrame:
    return timeline.progress_events(_logs(spark, d)).select("job_id", "event_id", F.coalesce("percent", F.lit(-1)).alias("percent"), "progress")


def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    return timeline.batch_progress(timeline.progress_events(logs), logs.select("job_id").distinct())


def log_history(spark: SparkSession, d: str) -> DataFrame:
    return timeline.last_n(timeline.without_repeats(_logs(spark, d)), 3).select("job_id", "event_id", "message")


def ratio_similarity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("block_no")
    df = tab.conversation_blocks(spark, d).withColumn("b", F.lag("text").over(w)).where("b is not null")
    return df.select("video_id", "block_no", F.round(similarity(F.col("b"), F.col("text")), 6).alias("ratio"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    df = tab.event_readings(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions.gap_sessions(df, "6 hours", ["video_id"])
    s = lambda c: F.round(F.unix_micros(c) / 1e6, 3)
    return out.select("video_id", s("start").alias("start"), s("end").alias("end"), "readings", F.round("confidence", 6).alias("confidence"))


def deep_votes(spark: SparkSession, d: str) -> DataFrame:
    """Four documents are a frame's neighbours, each read whole and without digits and signs."""
    df = tab.document_readings(spark, d)
    read = F.array(F.struct(F.lit(0).alias("variant_rank"), F.col("text")), F.struct(F.lit(1).alias("variant_rank"), F.regexp_replace("text", r"[^\p{L}\n ]+", " ").alias("text")))
    votes = df.select("video_id", F.floor(F.col("frame_id") / 2).cast("string").alias("frame_id"), F.col("doc_id").alias("neighbour_rank"), F.explode(read).alias("_r"), "confidence")
    votes = votes.select("video_id", "frame_id", "neighbour_rank", "_r.*", "confidence")
    return B.deep_vote(votes, LATIN).select("video_id", "frame_id", "outcome", "text", F.round("confidence", 6).alias("confidence"))


#: What a frame of an event shows, by its type; types that are listed twice take turns.
SHOWN = {"view": ("view of the page",), "click": ("click of the page",), "purchase": ("purchase of the page",), "error": ("zr tk", "the bcdfghjklm"), "signup": ("no", "")}


def deep_votes_alike(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a frame and its neighbours, in three variants: of some users all events at once, of others a day's.

    The second variant reads a letter more or nothing, the third a sign more, or
    nothing where the value is low; spellings of a text are alike, different
    texts aren't.
    """
    e = tab.event_readings(spark, d)
    n = F.col("event_id")
    shown = F.lit("")
    for kind, texts in SHOWN.items():
        shown = F.when(F.col("text") == kind, F.get(F.lit(list(texts)), F.pmod(n, F.lit(len(texts))).cast("int"))).otherwise(shown)
    base = F.col("base")
    more = lambda c, suffix: F.when((base != "") & c, F.concat(base, F.lit(suffix))).otherwise(F.lit(""))
    variants = F.array(base, more(n % 3 == 0, "s"), more(F.col("confidence") >= 0.2, "!"))
    frame = F.when(F.col("user_id") % 2 == 0, F.lit("all")).otherwise(F.to_date("ts").cast("string"))
    votes = e.withColumn("base", shown).select("video_id", frame.alias("frame_id"), n.alias("neighbour_rank"), F.posexplode(variants).alias("variant_rank", "text"), "confidence")
    return B.deep_vote(votes, LATIN).select("video_id", "frame_id", "outcome", "text", F.round("confidence", 6).alias("confidence"))


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """Events as they arrive, the later the higher their value: each five days' arrivals are a run of the stream, which goes on where the last one stopped."""
    e = tab.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    arrival = F.floor((F.unix_micros("ts") / 1e6 + F.col("value") * 1800.0) / 432000.0)
    e = written(e.withColumn("arrival", arrival), "arrivals")
    name = scratch(spark, "replay")
    schema = "event_id long, ts timestamp, value double"
    for (n,) in sorted(e.select("arrival").distinct().collect()):  # five days each, however many events
        e.where(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(f"{name}/source")
        late.route_late(spark.readStream.schema(schema).parquet(f"{name}/source"), f"{name}/out", f"{name}/checkpoint", 86400.0)
    return late.routed(spark, f"{name}/out", schema)


def late_rows(spark: SparkSession, d: str) -> DataFrame:
    mark = noted(spark)
    return settled(_replayed(spark, d), "late-rows", mark).select("event_id", "batch", "late", F.round("behind", 3).alias("behind"))


def late_row_counts(spark: SparkSession, d: str) -> DataFrame:
    mark = noted(spark)
    return settled(late.late_counts(_replayed(spark, d)), "late-counts", mark).withColumn("worst", F.round("worst", 3))


#: Rows of a lane and of a store of ``stream_blocks``, over all its runs: a lane's videos share calls, a store is opened in each batch.
LANE_ROWS, STORE_ROWS = 1 << 14, 1 << 20


def stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of events that arrive out of order, in runs of a stream that goes on where the last one stopped; the last run only moves the watermark.

    Lanes and stores of the stream grow with the rows, a lane's work doesn't.  Only
    the last run makes batches without rows: before it, the next run's batch gives
    out what the watermark has passed.
    """
    mark = noted(spark)
    rows = tab.event_readings(spark, d).drop("event_id", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    width, delay, end = 30 * 86400, 900000, "~"
    arrival = F.floor((F.col("time") + F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) * delay) / width)  # later by less than the delay
    name, schema = scratch(spark, "stream-blocks"), rows.schema
    arrivals = scratch(spark, "stream-arrivals")
    rows.withColumn("arrival", arrival).where("arrival is not null").write.partitionBy("arrival").parquet(arrivals)
    rows = spark.read.schema(StructType(schema.fields).add("arrival", "long")).parquet(arrivals)
    sizes = {n: k for n, k in rows.groupBy("arrival").count().collect()}  # a run a month, however many events
    last = rows.agg(F.max("ts").alias("ts")).select(F.lit(end).alias("video_id"), F.lit("").alias("frame_id"), (F.col("ts") + F.make_dt_interval(F.lit(60))).alias("ts"), F.lit(0.0).alias("time"), F.lit(0.0).alias("end"), F.lit("").alias("text"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))
    cores, total = spark.sparkContext.defaultParallelism, sum(sizes.values())
    stores = max(cores, -(-total // STORE_ROWS))
    own, lanes = session_with_store(spark, stores), max(4 * stores, -(-total // LANE_ROWS))
    for n in [*sorted(sizes), None]:
        own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(n is None).lower())
        part = last.where("ts is not null") if n is None else rows.where(F.col("arrival") == n)
        part.select(*schema.names).write.mode("append").parquet(f"{name}/source")
        stream = own.readStream.schema(schema).parquet(f"{name}/source")
        blocks = sessions.content_sessions(stream, f"{delay + 60} seconds", DAY_HALF, script=LATIN, keep=1e9, slot=float(delay), lanes=lanes)
        blocks.writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{BLOCKS}, readings int").parquet(f"{name}/out").where(F.col("video_id") != end)
    return _rounded(settled(out, "stream-blocks-out", mark))


def language_checks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    df = tab.document_readings(spark, d)
    df = df.withColumn("good", T.has_good_language(t, LATIN))
    return df.select("doc_id", "good", T.is_acceptable_recovery(t, LATIN, F.col("good")).alias("acceptable"), T.looks_like_damaged_sentence(t, LATIN).alias("damaged"), T.is_short_noise(t, LATIN).alias("short_noise"), T.is_fragment_noise(t, LATIN).alias("fragments"))


#: What the stand-in of a costly engine reads, by the length of an image.
READ_AGAIN = ("the river was cold", "brada", "", "and the stone")


def _engine(kind: str):
    """Stand-ins of engines: an image's bytes are its text, and their number decides what goes wrong."""

    def first(content: bytes) -> tuple[str, float]:
        if len(content) % 13 == 0:
            raise OSError("unreadable")
        return content.decode(), len(content) % 101 / 100.0

    made = {
        "first": first,
        "fallback": lambda content: (content.decode(), 0.4),
        "late": lambda content: ("the house of stone", 0.6) if len(content) % 2 == 0 else ("", 0.0),
        "deep": lambda content: (READ_AGAIN[len(content) % 4], 0.9),
    }
    return lambda: made[kind]


def read_loop(spark: SparkSession, d: str) -> DataFrame:
    """Documents as images through the whole read loop: every route is taken by some."""
    docs = tab.spread(tab.table(spark, d, "documents").select("doc_id", "source", "text"))
    mode = F.get(F.array(F.lit("aggressive"), F.lit("short"), F.lit("none")), (F.col("doc_id") % 3).cast("int"))
    images = docs.select(F.col("source").alias("video_id"), F.format_string("%012d", "doc_id").alias("frame_id"), (F.col("doc_id") * 10.0).alias("time"), F.col("text").cast("binary").alias("content"), mode.alias("deep_mode"))
    mark = noted(spark)
    seen = recognise.read_loop(images, {"paddle": _engine("first")}, {"tesseract": _engine("fallback")}, {"second": _engine("late")}, {"deep": _engine("deep")}, "by frame", script=LATIN)
    out = settled(seen, "read-loop", mark)
    return out.select("frame_id", "engine", "text", F.round("confidence", 6).alias("confidence"), F.round("score", 4).alias("score"), "emitted", "rejection", "route", "deep")


def sample_files(spark: SparkSession, d: str) -> DataFrame:
    """The samples file's lines, numbered."""
    mark = noted(spark)
    seen = written(_seen(spark, d, "balanced").withColumn("video_id", F.lit("all")), "observations")
    text = settled(inputs.samples_text(inputs.samples(seen)), "samples", mark)
    return text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, merge_key, char_profile, ocr_score, clean_reason_counts, noise_reasons, best_reading, rejection_counts, engine_counts, confidence_hist_equal, confidence_hist_quality,
        confidence_stats, blocks_exact, blocks_voted, block_report, block_votes, neighbor_noise, change_detection_diff, mask_jaccard, extraction_stats, gate_stats, gate_frames, common_region,
        temporal_neighbors_top5, call_cap, preset_grid, preset_choice, benchmark_report, benchmark_metrics, ocr_report, glossary_rewrite, corrections, translate_cached, translation_summary, timing_conformance,
        srt_lines, cleanup_blocks, candidate_signature, report_scan, progress_ladder, batch_progress, log_history, ratio_similarity, gap_sessions, deep_votes, deep_votes_alike, late_rows, late_row_counts, stream_blocks, observation_keys, region_settings, language_checks, sample_files, quality_report, quality_report_text, preset_trial, region_trial, blocks_alike, votes_alike,
        neighbor_noise_alike, read_loop,
    )
}
QUERIES |= vision.QUERIES

_R = "round_even"
_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_CONV = "cv AS (SELECT conv_id::VARCHAR AS video_id, turn + 1 AS block_no, turn * 2.5 AS start, turn * 2.5 + 2.25 AS \"end\", coalesce(text, '') AS text, role FROM conversations)"


def _best(preset: str) -> str:
    return f"""
    WITH c AS ({O.cleaned(preset)}),
    s AS (SELECT doc_id // 2 AS frame_id, CASE WHEN doc_id % 2 = 0 THEN 'tesseract' ELSE 'paddle' END AS engine, cleaned, confidence, reason, round({O.score("cleaned", "confidence", O.repeats("cleaned", 5))}, 9) AS score FROM c),
    best AS (SELECT frame_id, engine, cleaned, confidence, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, CASE engine WHEN 'tesseract' THEN 0 ELSE 1 END) AS k FROM s WHERE reason = 'accepted'),
    best_rows AS (SELECT f.frame_id, b.frame_id IS NOT NULL AS accepted, b.engine, coalesce(b.cleaned, '') AS text, round(coalesce(b.confidence, 0.0), 6) AS confidence, round(coalesce(b.score, 0.0), 4) AS score
      FROM (SELECT DISTINCT frame_id FROM s) f LEFT JOIN best b ON b.frame_id = f.frame_id AND b.k = 1)
"""


_BEST = _best("balanced")


def _observed(preset: str) -> str:
    """The same with ``seen``: emitted, rejection and the text that is kept (noise rules and local language sanity)."""
    flags = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in O.noise_flags("t"))
    w = O.words("t")
    j, n, common = O.joined(w), f"len({w})", O.size_of(O.words("lower(t)"), f"list_contains({O.listed(LATIN.common)}, x)")
    own = O.count("t", LATIN.letters)
    damaged = f"{own} > 20 AND {n} >= 3 AND {O.vowels(j)} / greatest(1, length({j})) >= 0.18 AND {O.size_of(w, 'length(x) <= 2')} / greatest(1, {n}) <= 0.55 AND {O.count(j, chr(92) + 'p{Lu}')} / greatest(1, length({j})) <= 0.65"
    return f"""{_best(preset)},
    why AS (SELECT frame_id, string_agg(engine || ':' || reason, '; ' ORDER BY CASE engine WHEN 'tesseract' THEN 0 ELSE 1 END) AS joint FROM s GROUP BY frame_id),
    nz AS (SELECT b.*, joint, {O.norm("text")} AS t FROM best_rows b JOIN why USING (frame_id)),
    fl AS MATERIALIZED (SELECT *, concat_ws(',', {flags}) AS found, {O.valid_short("t")} AS sh, {own} AS own, ({common} > 0 OR ({damaged})) AS sane FROM nz),
    bl0 AS (SELECT *, found <> '' AND own > 20 AND sane AS saved, found <> '' AND NOT sh AND NOT (found <> '' AND own > 20 AND sane) AS blocked FROM fl),
    rw AS (SELECT doc_id // 2 AS frame_id, coalesce(nullif(max(CASE WHEN doc_id % 2 = 1 THEN text END), ''), max(CASE WHEN doc_id % 2 = 0 THEN text END), '') AS raw FROM documents GROUP BY 1),
    seen AS (SELECT frame_id, frame_id::DOUBLE AS time, engine, confidence, accepted AND text <> '' AND NOT blocked AS emitted, CASE WHEN NOT accepted THEN joint WHEN blocked AND own > 20 THEN 'language_sanity_noise' WHEN blocked THEN 'noise_filter:' || found END AS rejection,
      CASE WHEN blocked THEN '' WHEN saved THEN t ELSE text END AS text, {O.norm("raw")} AS raw FROM bl0 JOIN rw USING (frame_id))
"""


def _joined_blocks(rows: str, gap: float, name: str) -> str:
    """CTEs ending in ``name``: video_id, block, start, e, confidence of runs of equal texts; ``rows`` has video_id, t, e, text, confidence, o (order)."""
    return f"""
    {name}_a AS (SELECT *, CASE WHEN lag(text) OVER w IS DISTINCT FROM text OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk FROM ({rows}) WINDOW w AS (PARTITION BY video_id ORDER BY t, o)),
    {name}_b AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS run FROM {name}_a),
    {name}_c AS (SELECT *, CASE WHEN coalesce(t - max(e) OVER (PARTITION BY video_id, run ORDER BY t, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap}, true) THEN 1 ELSE 0 END AS nb FROM {name}_b),
    {name}_d AS (SELECT *, sum(nb) OVER (PARTITION BY video_id ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS block FROM {name}_c),
    {name} AS (SELECT video_id, block, min(t) AS start, greatest(max(e), min(t) + 0.7) AS e, max(confidence) AS confidence FROM {name}_d GROUP BY video_id, block)
"""


def _bins(value: str, filtered: str = "true", bins: str = "quality") -> str:
    """The bins' counts as ``name=n``, in order."""
    return " || '; ' || ".join(f"'{name}=' || count(*) FILTER ({filtered} AND {O.hist(O.BINS[bins], value)} = '{name}')" for name, _ in O.BINS[bins])


def _reasons(keys: str = "") -> str:
    """Query: keys, reason, n, and where each reason first came up; of ``o``'s rejections."""
    part = f"SELECT {keys}time, i, CASE WHEN trim(p[i]) = '' THEN 'empty' ELSE trim(p[i]) END AS reason FROM (SELECT {keys}time, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT {keys}time, string_split(coalesce(rejection, ''), ',') AS p FROM o WHERE NOT emitted))"
    return f"SELECT {keys}reason, count(*) AS n, min({{'t': time, 'i': i}}) AS fst FROM ({part}) GROUP BY ALL"


_PARTS = "SELECT CASE WHEN trim(p) = '' THEN 'empty' ELSE trim(p) END AS reason"
_REPORT = f"""{_observed("recall")},
    o AS (SELECT *, 'v' || frame_id % 4 AS video_id FROM seen),
    {_joined_blocks("SELECT video_id, time AS t, time + 0.75 AS e, text, confidence, 0 AS o FROM o WHERE emitted", 4.0, "bk")},
    fr AS (SELECT 'v' || (doc_id // 2) % 4 AS video_id, doc_id, (doc_id % 101) / 100.0 * 100 AS area FROM documents),
    ob AS (SELECT video_id, count(*) AS seen_calls, count(*) FILTER (emitted) AS accepted, coalesce(avg(confidence) FILTER (emitted), 0.0) AS r_mean, coalesce(median(confidence) FILTER (emitted), 0.0) AS r_mid, {_bins("confidence", "emitted", "equal")} AS r_bins,
      count(*) FILTER (emitted AND engine = 'tesseract') AS n_t, count(*) FILTER (emitted AND engine = 'paddle') AS n_p FROM o GROUP BY video_id),
    rj AS (SELECT video_id, string_agg(reason || '=' || n, '; ' ORDER BY fst) AS reasons, string_agg('''' || reason || ''': ' || n, ', ' ORDER BY fst) AS named FROM ({_reasons("video_id, ")}) GROUP BY video_id),
    bb AS (SELECT video_id, count(*) AS blocks, avg(confidence) AS mean, median(confidence) AS mid, {_bins("confidence")} AS bins, avg(e - start) AS duration FROM bk GROUP BY video_id),
    st AS (SELECT video_id, count(*) AS sampled, count(*) FILTER (doc_id % 5 = 0) AS no_text, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 = 0) AS same, count(*) FILTER (doc_id % 17 = 0) AS failed,
      count(*) FILTER (doc_id % 17 <> 0 AND doc_id % 23 = 0) AS timeout, coalesce(avg(area) FILTER (doc_id % 3 > 0 AND area > 0), 0.0) AS area FROM fr GROUP BY video_id),
    rp AS (SELECT *, seen_calls + failed + timeout AS calls FROM ob LEFT JOIN rj USING (video_id) LEFT JOIN bb USING (video_id) LEFT JOIN st USING (video_id))
"""
_NO_BINS = "; ".join(f"{name}=0" for name, _ in O.BINS["quality"])


def _text_lines() -> str:
    """The lines of the text reports, in SQL."""
    braces = lambda c: f"'{{' || coalesce({c}, '') || '}}'"
    bins = "'''' || replace(replace(r_bins, '=', ''': '), '; ', ', ''')"
    fixed = {
        "quality_profile": "'default'", "subtitle_detect_mode": "'hybrid'", "total_frames_sampled": "sampled", "actual_ocr_calls": "sampled - no_text - same", "white_text_frames": "sampled - no_text", "skipped_same_subtitle_frames": "same",
        "skipped_same_subtitle": "same", "skipped_without_subtitles": "no_text", "readings.average_text_bbox_area": "printf('%.1f', area)", "accepted_ocr_results": "accepted", "noise_rejected": "calls - accepted", "empty_ocr_results": "seen_calls - accepted",
        "successful_ocr_calls": "accepted", "timeout_ocr_calls": "timeout", "failed_ocr_calls": "failed", "total_ocr_results": "calls", "readings.accepted_ratio": "printf('%.3f', accepted / greatest(1, calls))",
        "accepted_ratio_warning": "CASE WHEN accepted / greatest(1, calls) < 0.3 THEN 'filter_too_aggressive' ELSE '' END", "deep_analysis_attempted": "0", "deep_analysis_recovered": "0", "deep_analysis_rejected": "0",
        "rejection_reasons": braces("named"), "readings.average_confidence": "printf('%.3f', r_mean)", "readings.median_confidence": "printf('%.3f', r_mid)",
        "readings.confidence_histogram": braces(bins), "readings.engine_counts": "'{''tesseract'': ' || n_t || ', ''paddle'': ' || n_p || '}'",
    }
    lines = ", ".join(f"'{name}: ' || ({fixed[c]})" for name, c, _ in reports.REPORT_LINES)
    rule = "repeat('=', 40)"
    timing = f"'', 'TIMING', {rule}, 'subtitle_changes_or_ocr_crops: ' || (sampled - no_text - same), 'subtitle_blocks: ' || coalesce(blocks, 0), 'average_subtitle_duration: ' || printf('%.3f', coalesce(duration, 0.0)), ''"
    return f"""{_REPORT},
    x AS (SELECT * FROM rp),
    ln AS (
      SELECT video_id, unnest(['OCR REPORT', {rule}, {lines}, '', 'TOP OCR NOISE SAMPLES', {rule}, '', 'RECOMMENDATION', {rule}, {", ".join(map(O.q, reports.ADVICE))}, {timing}]) AS line FROM x
      UNION ALL SELECT video_id, '- [' || coalesce(rejection, '') || '] ' || substr(raw, 1, 300) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time) AS k FROM o WHERE NOT emitted AND raw <> '') WHERE k <= 25)
    SELECT video_id, line, count(*) AS times FROM ln GROUP BY ALL
"""


_DIFF = """
    WITH e AS (SELECT label::VARCHAR AS video_id, vec_id::DOUBLE AS time, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY time) AS b FROM e),
    s AS (SELECT video_id, time, b IS NULL AS first, CASE WHEN b IS NULL THEN 1.0 ELSE list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - b[i]))) / len(v) END AS diff FROM p),
    i AS (SELECT *, sum(CASE WHEN first OR diff >= 0.14 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS island FROM s),
    g AS (SELECT video_id, island::BIGINT AS island, min(time) AS time, max(time) + 0.75 AS end_time, round(arg_min(diff, time), 6) AS diff_score, count(*) AS frames FROM i GROUP BY video_id, island)
"""
def _emitted(ev: str) -> str:
    """CTEs: a query of evaluated texts as ``ev``, and ``em`` with what the noise filter leaves."""
    doubt = " OR ".join(f"({c})" for _, c in O.noise_flags("t"))
    return f"""ev AS MATERIALIZED ({ev}),
    nf AS MATERIALIZED (SELECT t, ({doubt}) AND NOT {O.valid_short("t")} AS blocked FROM (SELECT DISTINCT cleaned AS t FROM ev WHERE reason = 'accepted')),
    em AS (SELECT ev.*, reason = 'accepted' AND cleaned <> '' AND NOT coalesce(blocked, false) AS emitted FROM ev LEFT JOIN nf ON ev.cleaned = nf.t)"""


_GRID = f"""
    WITH {_emitted(O.evaluated())},
    sc AS (SELECT *, {O.score("cleaned", "confidence", O.repeats("cleaned", 5))} AS score FROM em),
    a AS (SELECT video_id, preset, count(*) AS sample, count(*) FILTER (emitted) AS accepted, coalesce(avg(confidence) FILTER (emitted), 0.0) AS avg_confidence, coalesce(avg(score) FILTER (emitted), 0.0) AS avg_score FROM sc GROUP BY ALL),
    g AS (SELECT *, sample - accepted AS dropped, (sample - accepted) / greatest(1, sample) AS noise_ratio, 10000.0 * accepted + 100.0 * avg_confidence + avg_score - (sample - accepted) / greatest(1, sample) AS composite FROM a)
"""
_LOGS = """
    lg AS (SELECT user_id AS job_id, event_id, ts, event_type, event_id % 50 AS n FROM events),
    pr AS (SELECT job_id, event_id, ts, CASE event_type WHEN 'view' THEN 30 + round_even(n / 50.0 * 35, 0) WHEN 'click' THEN 30 WHEN 'purchase' THEN 65 + round_even(n / 50.0 * 20, 0) WHEN 'signup' THEN 12 END::INTEGER AS percent,
      CASE event_type WHEN 'view' THEN 'OCR frame ' || n || '/50' WHEN 'click' THEN 'Video uloženo' WHEN 'purchase' THEN 'Překlad průběh: ' || n || '/50 titulků' WHEN 'signup' THEN 'yt-dlp' ELSE 'note ' || event_type END AS message FROM lg),
    pg AS (SELECT *, coalesce(max(percent) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS progress FROM pr)
"""


def _rewritten(t: str) -> str:
    """Whole words replaced; marks around every other character stand in for word edges."""
    t = _marked(t)
    for source, target in TERMS.items():
        t = f"regexp_replace({t}, '(?i)(^|\\x{{02}}){source}($|\\x{{02}})', '\\1{target}\\2', 'g')"
    return f"replace({t}, chr(2), '')"


def _marked(t: str) -> str:
    return f"regexp_replace({t}, '([^\\p{{L}}\\p{{N}}\\p{{M}}_])', chr(2) || '\\1' || chr(2), 'g')"


def _terms(t: str) -> str:
    """The terms that change a text: those that occur otherwise than written."""
    edge = lambda flag, word: f"len(regexp_extract_all({_marked(t)}, '{flag}(^|\\x{{02}}){word}($|\\x{{02}})'))"
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {edge('(?i)', source)} <> {edge('', target)} THEN 'glossary:{target}' END" for source, target in TERMS.items()) + ")"


_TRANSLATABLE = "regexp_replace(trim({n}, {p}), '([{lo}])([{up}])', '\\1 \\2', 'g')".format(n=O.norm("text"), p=O.q(T.PUNCTUATION), lo=LATIN.lower, up=LATIN.upper)

ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, {O.norm('text')} AS normalized FROM ({_DOCS})",
    "merge_key": f"SELECT doc_id, {O.key('text')} AS key FROM ({_DOCS})",
    "char_profile": f"""
        SELECT doc_id, {O.count("text", LATIN.letters)} AS script_letters, {O.count("text", chr(92) + "p{L}")} AS letters, {O.count("text", LATIN.foreign)} AS foreign_letters, {O.symbols("text")} AS symbols,
          {O.meaningful("text")} AS meaningful, len({O.words("text")}) AS words, {O.vowels("text")} AS vowels,
          {O.size_of(O.words(f"lower({O.norm('text')})"), f"list_contains({O.listed(LATIN.common)}, x)")} AS common_words, {O.valid_short("text")} AS valid_short
        FROM ({_DOCS})""",
    "ocr_score": f"SELECT doc_id, round({O.score('text', '(doc_id % 101) / 100.0', O.repeats('text', 5))}, 4) AS score FROM ({_DOCS})",
    "clean_reason_counts": f"SELECT preset, reason, count(*) AS n FROM ({O.evaluated()}) GROUP BY ALL",
    "noise_reasons": "SELECT doc_id, concat_ws(',', {}) AS reasons FROM (SELECT doc_id, {} AS t FROM ({}))".format(
        ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in O.noise_flags("t")), O.norm("text"), _DOCS
    ),
    "best_reading": f"{_BEST} SELECT * FROM best_rows",
    "engine_counts": f"{_BEST} SELECT v.engine, count(b.frame_id) AS n FROM (VALUES ('tesseract'), ('paddle'), ('compare')) v(engine) LEFT JOIN best_rows b ON b.engine = v.engine AND b.accepted GROUP BY v.engine",
    "rejection_counts": f"SELECT reason, count(*) AS n FROM ({O.cleaned('balanced')}) WHERE reason <> 'accepted' GROUP BY reason",
    "confidence_hist_equal": O.histogram(O.BINS["equal"]),
    "confidence_hist_quality": O.histogram(O.BINS["quality"]),
    "confidence_stats": f"""
        WITH {O.EVENTS}, s AS (SELECT text, count(*) AS calls, count(*) FILTER (confidence >= 0.1) AS n_accepted, coalesce(avg(confidence) FILTER (confidence >= 0.1), 0) AS a, coalesce(median(confidence) FILTER (confidence >= 0.1), 0) AS m FROM ev GROUP BY text)
        SELECT text, calls, n_accepted, round(a, 6) AS avg_confidence, round(m, 6) AS median_confidence, round(n_accepted / greatest(1, calls), 6) AS accepted_ratio, n_accepted / greatest(1, calls) < 0.3 AS low_yield FROM s""",
    "blocks_exact": f"{O.BLOCKS} SELECT video_id, block_no, round(start, 3) AS start, round(\"end\", 3) AS \"end\", text, round(confidence, 6) AS confidence, readings FROM bl",
    "block_report": f"{O.BLOCKS} SELECT video_id, count(*) AS blocks, round(avg(\"end\" - start), 3) AS avg_duration FROM bl GROUP BY video_id",
    "block_votes": f"""
        WITH {O.EVENTS}, g AS (SELECT video_id, text, count(*) AS votes, max(confidence) AS confidence FROM ev GROUP BY ALL),
        r AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS groups, row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, confidence DESC) AS k FROM g)
        SELECT video_id, text, votes, groups, round(confidence, 6) AS confidence FROM r WHERE k = 1""",
    "change_detection_diff": f"{_DIFF} SELECT * FROM g",
    "extraction_stats": f"{_DIFF}, n AS (SELECT video_id, count(*) AS sampled FROM e GROUP BY ALL) SELECT video_id, any_value(sampled) AS sampled, count(*) AS emitted, any_value(sampled) - count(*) AS skipped_same FROM g JOIN n USING (video_id) GROUP BY video_id",
    "mask_jaccard": """
        WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS m FROM embeddings),
        p AS (SELECT vec_id, m, lag(m) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e),
        c AS (SELECT vec_id, b IS NULL AS first, len(list_filter(range(1, len(m) + 1), lambda i: m[i] AND b[i])) AS a, len(list_filter(range(1, len(m) + 1), lambda i: m[i] OR b[i])) AS o FROM p)
        SELECT vec_id, CASE WHEN first THEN 0.0 WHEN o = 0 THEN 1.0 ELSE round(a / o, 6) END AS jaccard FROM c""",
    "common_region": """
        WITH e AS (SELECT label::VARCHAR AS video_id, vec_id, 0.7 + embedding[1]::DOUBLE / 2 AS a, 0.7 + embedding[2]::DOUBLE / 2 AS b FROM embeddings),
        p AS (SELECT video_id, median(a) AS a, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) AS k FROM e WHERE a > 0) WHERE k <= 200 GROUP BY video_id HAVING count(*) >= 10),
        s AS (SELECT video_id, median(b) AS b, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) AS k FROM e WHERE b > 0) WHERE k <= 200 GROUP BY video_id HAVING count(*) >= 10)
        SELECT video_id, round(greatest(0.55, least(0.82, a - 0.06)), 6) AS y1, round(greatest(greatest(0.55, least(0.82, a - 0.06)) + 0.12, least(0.99, b + 0.06)), 6) AS y2 FROM p JOIN s USING (video_id)""",
    "temporal_neighbors_top5": f"""
        WITH {O.EVENTS}, p AS (SELECT a.video_id, a.event_id AS f, b.event_id AS g, abs(a.t - b.t) AS d, b.t AS u FROM ev a JOIN ev b ON a.video_id = b.video_id AND abs(a.t - b.t) <= 7200),
        r AS (SELECT *, row_number() OVER (PARTITION BY video_id, f ORDER BY d, u, g) AS k FROM p)
        SELECT video_id, printf('%012d', f) AS frame_id, printf('%012d', g) AS neighbour_id, round(d, 3) AS distance, k AS rank FROM r WHERE k <= 5""",
    "call_cap": f"""
        WITH {O.EVENTS}, u AS (SELECT video_id::BIGINT % 8 AS v, t, event_id FROM ev),
        d AS (SELECT v, least({O.FAST[2]}, greatest({O.FAST[1]}, floor((max(t) - min(t)) * (v + 1) / 5760 / 60 * {O.FAST[0]})))::BIGINT AS cap FROM u GROUP BY v),
        r AS (SELECT v, event_id, cap, row_number() OVER (PARTITION BY v ORDER BY t, event_id) AS k FROM u JOIN d USING (v))
        SELECT v AS video_id, count(*) AS kept, max(event_id) AS last_id, any_value(cap) AS cap FROM r WHERE k <= cap GROUP BY v""",
    "preset_grid": f"{_GRID} SELECT video_id, preset, sample, accepted, dropped, round(avg_confidence, 4) AS avg_confidence, round(avg_score, 4) AS avg_score, round(noise_ratio, 4) AS noise_ratio, round(composite, 4) AS composite FROM g",
    "preset_choice": f"{_GRID}, k AS (SELECT g.*, row_number() OVER (PARTITION BY video_id ORDER BY accepted DESC, round(avg_confidence, 9) DESC, round(noise_ratio, 9), round(composite, 6) DESC, rank) AS n FROM g JOIN {O.RANKS} USING (preset)) SELECT video_id, preset, accepted, sample FROM k WHERE n = 1",
    "glossary_rewrite": f"WITH {_CONV}, r AS (SELECT *, {_rewritten('text')} AS n FROM cv) SELECT video_id, block_no::INTEGER AS block_no, n AS text, {_terms('text')} AS terms, n = text AS unchanged FROM r",
    "corrections": f"WITH {_CONV}, r AS (SELECT *, {_rewritten('text')} AS n FROM cv) SELECT video_id, block_no AS index, {O.srt_time('start')} AS start, {O.srt_time(chr(34) + 'end' + chr(34))} AS \"end\", text AS original, n AS corrected, {_terms('text')} AS reason, 0.5::DOUBLE AS confidence FROM r WHERE n <> text",
    "translate_cached": f"""
        WITH {_CONV}, s AS (SELECT *, {O.norm(_TRANSLATABLE)} AS src FROM cv), c AS (SELECT DISTINCT src FROM s WHERE role = 'assistant')
        SELECT video_id, block_no::INTEGER AS block_no, CASE WHEN s.src = '' THEN text WHEN c.src IS NOT NULL THEN 'cs:' || s.src ELSE s.src END AS translated,
          CASE WHEN s.src = '' THEN 'empty' WHEN c.src IS NOT NULL THEN 'cached' ELSE 'copied' END AS status FROM s LEFT JOIN c ON s.src = c.src""",
    "translation_summary": f"""
        WITH {_CONV}, s AS (SELECT {O.norm(_TRANSLATABLE)} AS src FROM cv), a AS (SELECT count(*) AS t, count(*) FILTER (src <> '' AND length(src) > 200) AS f, count(DISTINCT src) FILTER (src <> '') AS u FROM s)
        SELECT t AS total_blocks, greatest(0, t - f) AS translated_blocks, f AS failed_blocks, u AS unique_misses, CASE WHEN f > 0 AND f >= t THEN 'translation_failed' WHEN f > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM a""",
    "timing_conformance": f"WITH {_CONV} SELECT video_id, count(*) AS blocks, count(*) FILTER (role = 'user' AND block_no > 3) AS mismatches, count(*) FILTER (role = 'user' AND block_no > 3) = 0 AS conformant FROM cv GROUP BY video_id",
    "srt_lines": f"""
        WITH {_CONV}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", text) AS k FROM cv WHERE trim(text) <> '')
        SELECT video_id, k AS block_no, k || chr(10) || {O.srt_time("start")} || ' --> ' || {O.srt_time('"end"')} || chr(10) || text || chr(10) AS cue FROM n""",
    "candidate_signature": f"""
        WITH {O.EVENTS}, f AS (SELECT *, confidence / 2 AS y1, confidence / 2 + 0.125 AS y2, lag(text) OVER (PARTITION BY video_id ORDER BY t, event_id) IS DISTINCT FROM text AS changed FROM ev),
        h AS (SELECT video_id, t, ('0x' || substr(md5(round(t * 1000)::BIGINT || '|' || round(e * 1000)::BIGINT || '|' || printf('%012d', event_id) || '|' || round(y1 * 10000)::BIGINT || '|' || round(y2 * 10000)::BIGINT), 1, 15))::BIGINT AS k FROM f WHERE changed AND text <> 'signup')
        SELECT video_id, count(*) AS n, round(min(t), 3) AS first_time, round(max(t), 3) AS last_time, sha1(sum(k)::VARCHAR) AS digest FROM h GROUP BY video_id""",
    "report_scan": "SELECT doc_id, n_chars AS failed_frames, 0::BIGINT AS timeout_frames, doc_id % 10 / 10 AS ratio, lang AS title FROM documents",
    "progress_ladder": f"WITH {_LOGS} SELECT job_id, event_id, coalesce(percent, -1) AS percent, progress FROM pg",
    "batch_progress": f"WITH {_LOGS} SELECT {_R}(avg(p), 0)::INTEGER AS overall_progress FROM (SELECT max(progress) AS p FROM pg GROUP BY job_id)",
    "log_history": f"""
        WITH {_LOGS}, d AS (SELECT *, lag(message) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS b FROM pr),
        r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM d WHERE b IS DISTINCT FROM message)
        SELECT job_id, event_id, message FROM r WHERE k <= 3""",
    "gap_sessions": f"""
        WITH {O.EVENTS}, g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY video_id ORDER BY t) > 21600, true) THEN 1 ELSE 0 END AS b FROM ev),
        s AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT video_id, round(min(t), 3) AS start, round(max(t) + 21600, 3) AS "end", count(*) AS readings, round(max(confidence), 6) AS confidence FROM s GROUP BY video_id, k""",
}
ORACLE_SQL["blocks_voted"] = ORACLE_SQL["stream_blocks"] = ORACLE_SQL["blocks_exact"]
_PARTED = f"regexp_replace({O.norm('text')}, '([{LATIN.lower}])([{LATIN.upper}])', '\\1 \\2', 'g')"
_TIDY = f"trim(regexp_replace({_PARTED}, '[ ]+([,.!?;:])', '\\1', 'g'), {O.q(T.PUNCTUATION)})"
ORACLE_SQL["cleanup_blocks"] = f"""
    WITH {_CONV}, c AS (SELECT video_id, block_no, {_TIDY} AS t FROM cv), w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS k FROM c),
    d AS (SELECT *, t = '' OR (len(k) >= 3 AND {O.size_of("k", "length(x) <= 2")} / greatest(1, len(k)) > 0.70) OR {O.repeats("t", 6)} AS gone FROM w)
    SELECT video_id, block_no::INTEGER AS block_no, {O.norm("t")} AS text FROM d WHERE NOT gone
"""
_W, _LW = O.words("t"), O.words("lower(t)")
_J, _OWN = O.joined(_W), O.count("t", LATIN.letters)
_SAFE = f"({O.joined(_LW, ' ')} IN ({', '.join(map(O.q, LATIN.safe_phrases))}) OR {O.size_of(_LW, f'length(x) >= 3 AND list_contains({O.listed(LATIN.safe_words)}, x)')} > 0)"
_FEW = O.size_of(_LW, "length(x) <= 2")
ORACLE_SQL["language_checks"] = f"""
    WITH n AS (SELECT doc_id, text AS raw, {O.norm("text")} AS t FROM ({_DOCS})),
    f AS (SELECT doc_id, {O.valid_short("t")} AS sh, {O.size_of(O.words("lower(t)"), f"list_contains({O.listed(LATIN.common)}, x)")} AS common, {_OWN} AS own, len({_W}) AS n, length({_J}) AS chars, {O.vowels(_J)} AS v,
        {O.size_of(_W, "length(x) >= 3")} AS longer, {O.size_of(_W, "length(x) <= 2")} AS few, {O.count(_J, chr(92) + "p{Lu}")} AS up, {" OR ".join(f"({c})" for _, c in O.noise_flags("t"))} AS noisy FROM n),
    g AS (SELECT *, n > 0 AND (sh OR (NOT noisy AND chars >= 5 AND v / greatest(1, chars) >= 0.22 AND (common > 0 OR longer >= 2 OR chars >= 12))) AS good FROM f),
    b AS (SELECT doc_id, {_OWN} AS own, {_SAFE} AS safe, len({_LW}) AS n, {_FEW} AS few, {O.size_of(_LW, "length(x) <= 3")} AS tiny, {O.size_of(_LW, "length(x) >= 4")} AS longer,
        (regexp_matches(t, '[{LATIN.letters}]')::INT + regexp_matches(t, '[{LATIN.foreign}]')::INT + regexp_matches(t, '[\\x{{0370}}-\\x{{03ff}}]')::INT) AS scripts, {O.count(O.joined(_LW), LATIN.vowels)} AS v
      FROM (SELECT doc_id, raw AS t FROM n))
    SELECT doc_id, good, sh OR common > 0 OR good AS acceptable, g.own > 20 AND g.n >= 3 AND g.v / greatest(1, chars) >= 0.18 AND g.few / greatest(1, g.n) <= 0.55 AND up / greatest(1, chars) <= 0.65 AS damaged,
      b.own BETWEEN 1 AND 19 AND NOT safe AND (b.few / greatest(1, b.n) > 0.50 OR b.tiny = b.n OR scripts >= 2 OR (b.own >= 4 AND b.v / greatest(1, b.own) < 0.20)) AS short_noise,
      b.own >= 20 AND NOT safe AND b.n >= 4 AND b.few / greatest(1, b.n) >= 0.55 AND b.longer < 2 AS fragments
    FROM g JOIN b USING (doc_id)
"""

# the gate as a recursion over each video's frames: what it knows is a row's columns
ORACLE_SQL["gate_frames"] = """
    WITH RECURSIVE f AS (SELECT label::VARCHAR AS video_id, vec_id::DOUBLE AS t, embedding[1]::DOUBLE > -0.1 AS seen, embedding::DOUBLE[] AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    g AS (
      SELECT DISTINCT video_id, 0::BIGINT AS n, NULL::DOUBLE AS t, '' AS state, 0.0::DOUBLE AS diff, false AS active, NULL::DOUBLE AS read_at, NULL::DOUBLE[] AS s FROM f
      UNION ALL
      SELECT video_id, n, t, state, diff, state <> 'no_text' AS active, CASE WHEN state = 'emit' THEN t ELSE read_at END, CASE state WHEN 'no_text' THEN NULL WHEN 'emit' THEN own ELSE s END FROM (
        SELECT *, CASE WHEN NOT seen THEN 'no_text' WHEN active AND diff < 0.2 AND (alike > 0.4 OR (alike >= 0.75 * 0.4 AND t - read_at < 2.0)) THEN 'same' ELSE 'emit' END AS state FROM (
          SELECT f.video_id, f.n, f.t, f.seen, f.s AS own, g.s AS s, g.active, g.read_at,
            CASE WHEN g.s IS NULL THEN 1.0 ELSE list_sum(list_transform(range(1, len(f.s) + 1), lambda i: abs(f.s[i] - g.s[i]))) / len(f.s) END AS diff,
            CASE WHEN g.s IS NULL THEN 0.0 ELSE len(list_filter(range(1, len(f.s) + 1), lambda i: f.s[i] > 0 AND g.s[i] > 0)) / greatest(1, len(list_filter(range(1, len(f.s) + 1), lambda i: f.s[i] > 0 OR g.s[i] > 0))) END AS alike
          FROM g JOIN f ON f.video_id = g.video_id AND f.n = g.n + 1))),
    e AS (SELECT *, sum(CASE WHEN state = 'emit' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM g WHERE n > 0)
    SELECT video_id, t AS time, CASE WHEN state = 'emit' THEN max(t) FILTER (state <> 'no_text') OVER (PARTITION BY video_id, k) ELSE t END + 0.75 AS end_time, round(diff, 6) AS diff_score, state FROM e
"""


def _read_loop_sql() -> str:
    flags = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in O.noise_flags("t"))
    w = O.words("t")
    j, n, common = O.joined(w), f"len({w})", O.size_of(O.words("lower(t)"), f"list_contains({O.listed(LATIN.common)}, x)")
    own = O.count("t", LATIN.letters)
    damaged = f"{n} >= 3 AND {O.vowels(j)} / greatest(1, length({j})) >= 0.18 AND {O.size_of(w, 'length(x) <= 2')} / greatest(1, {n}) <= 0.55 AND {O.count(j, chr(92) + 'p{Lu}')} / greatest(1, length({j})) <= 0.65"
    score = lambda t, c: f"round({O.score(t, c, O.repeats(t, 5))}, 9)"
    phrase = "CASE k " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(READ_AGAIN)) + " END"
    return f"""
    WITH c AS ({O.cleaned("recall")}),
    a AS (SELECT doc_id, strlen(text) AS len, CASE WHEN strlen(text) % 13 = 0 THEN 'tesseract' ELSE 'paddle' END AS engine, CASE WHEN strlen(text) % 13 = 0 THEN 0.4 ELSE strlen(text) % 101 / 100.0 END AS conf, reason, cleaned, doc_id % 3 AS mode, strlen(text) % 4 AS k
      FROM c JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL),
    b AS (SELECT *, reason = 'accepted' AS ok, {O.norm("cleaned")} AS t FROM a),
    f AS MATERIALIZED (SELECT *, concat_ws(',', {flags}) AS found, {O.valid_short("t")} AS sh, {own} AS own, ({common} > 0 OR ({damaged})) AS sane, {n} AS n, {O.meaningful("t")} AS chars FROM b),
    g AS (SELECT *, ok AND (found <> '' OR n < 2 OR chars < 4) AND (mode = 0 OR (mode = 1 AND sh)) AS again, ok AND found <> '' AND NOT sh AS bad FROM f),
    h AS (SELECT *, CASE WHEN again AND k IN (0, 3) THEN 'recovered' WHEN again AND bad THEN 'rejected' WHEN again THEN 'kept' END AS deep,
      CASE WHEN NOT ok THEN 'none' WHEN again THEN 'deep' WHEN NOT bad THEN 'clean' WHEN own > 20 THEN 'sanity' ELSE 'noise' END AS route FROM g),
    i AS (SELECT *, CASE WHEN NOT ok OR deep = 'rejected' OR (route = 'sanity' AND NOT sane) OR route = 'noise' THEN '' WHEN deep = 'recovered' THEN {phrase} WHEN route = 'sanity' THEN t ELSE cleaned END AS kept,
      CASE WHEN deep = 'recovered' THEN greatest(conf, 0.9) WHEN NOT ok THEN 0.0 ELSE conf END AS kept_conf FROM h),
    l AS (SELECT *, CASE WHEN len % 2 = 0 AND (NOT ok OR {score("'the house of stone'", "0.6")} > {score("cleaned", "conf")}) THEN 'second' WHEN ok THEN engine END AS chosen FROM i WHERE kept = ''),
    m AS (SELECT doc_id, chosen AS engine, CASE chosen WHEN 'second' THEN 'the house of stone' ELSE coalesce(nullif(cleaned, ''), '') END AS text, CASE WHEN chosen = 'second' THEN 0.6 WHEN chosen IS NULL THEN 0.0 ELSE conf END AS conf, chosen IS NOT NULL AS emitted,
        CASE WHEN chosen IS NULL THEN engine || ':' || reason || '; second:empty_after_cleanup' END AS rejection, 'late' AS route, deep FROM l
      UNION ALL SELECT doc_id, engine, kept, kept_conf, true, NULL, route, deep FROM i WHERE kept <> '')
    SELECT printf('%012d', doc_id) AS frame_id, engine, text, round(conf, 6) AS confidence, round(CASE WHEN emitted THEN {score("text", "conf")} ELSE 0.0 END, 4) AS score, emitted, rejection, route, deep FROM m
"""


ORACLE_SQL["read_loop"] = _read_loop_sql()
_BENCH = f"""
    WITH {_emitted(O.evaluated())},
    fr AS (SELECT em.*, regexp_matches(coalesce(text, ''), '\\p{{L}}') AS has FROM em JOIN documents USING (doc_id)),
    {_joined_blocks("SELECT preset || '/' || video_id AS video_id, (doc_id // 2)::DOUBLE AS t, doc_id // 2 + 0.75 AS e, cleaned AS text, confidence, doc_id AS o FROM fr WHERE has AND emitted", 1.2, "bk")},
    n AS (SELECT split_part(video_id, '/', 1) AS preset, count(*) AS blocks FROM bk GROUP BY ALL),
    a AS (SELECT preset, count(*) AS frames, count(*) FILTER (has) AS c, count(*) FILTER (has AND emitted) AS h, coalesce(avg(confidence) FILTER (has AND emitted), 0.0) AS m, coalesce(median(confidence) FILTER (has AND emitted), 0.0) AS mid FROM fr GROUP BY preset),
    z AS (SELECT a.*, coalesce(blocks, 0) AS blocks, rank + 1.0 AS seconds FROM a LEFT JOIN n USING (preset) JOIN {O.RANKS} USING (preset))
"""
ORACLE_SQL["benchmark_metrics"] = f"""{_BENCH}
    SELECT preset, c AS ocr_candidates, h AS ocr_hits, round(m, 6) AS average_confidence, round(mid, 6) AS median_confidence, 0::BIGINT AS timeout_frames, 0::BIGINT AS failed_frames, h AS successful_frames,
      blocks::BIGINT AS subtitle_blocks, round(seconds::DOUBLE, 6) AS processing_seconds, round(frames / seconds::DOUBLE, 6) AS processing_speed_candidates_per_second FROM z
"""
ORACLE_SQL["benchmark_report"] = f"""{_BENCH},
    r AS (SELECT preset, '<tr><td>' || preset || '</td><td>' || c || '</td><td>' || h || '</td><td>' || blocks || '</td><td>' || printf('%.3f', m) || '</td><td>0</td><td>0</td><td>' || printf('%.2f', frames / seconds::DOUBLE) || '</td></tr>' AS row FROM z)
    SELECT '<!doctype html><meta charset=''utf-8''><title>OCR benchmark</title><h1>OCR benchmark</h1><table><thead><tr><th>Preset</th><th>OCR candidates</th><th>OCR hits</th><th>Subtitle blocks</th><th>Average confidence</th><th>Timeout frames</th><th>Failed frames</th><th>Candidates/s</th></tr></thead><tbody>'
      || string_agg(row, '' ORDER BY preset) || '</tbody></table>' AS html FROM r
"""
ORACLE_SQL["ocr_report"] = f"""{_observed("recall")},
    o AS (SELECT * FROM seen),
    {_joined_blocks("SELECT 'v' || frame_id % 64 AS video_id, time AS t, time + 0.75 AS e, text, confidence, 0 AS o FROM seen WHERE emitted", 64.0, "bk")},
    a AS (SELECT count(*) AS calls, count(*) FILTER (emitted) AS accepted, count(*) FILTER (NOT emitted) AS rejected, coalesce(avg(confidence) FILTER (emitted), 0.0) AS mean, coalesce(median(confidence) FILTER (emitted), 0.0) AS mid, {_bins("confidence", "emitted", "equal")} AS histogram FROM seen),
    b AS (SELECT count(*) AS n, coalesce(avg(e - start), 0.0) AS d FROM bk),
    k AS (SELECT string_agg(reason || '=' || n, '; ' ORDER BY fst) AS r FROM ({_reasons()}))
    SELECT calls AS actual_ocr_calls, accepted, rejected, round(mean, 6) AS average_confidence, round(mid, 6) AS median_confidence, round(d, 6) AS average_subtitle_duration, round(accepted / greatest(1, calls), 6) AS accepted_ratio,
      n AS subtitle_blocks_generated, histogram, coalesce(r, '') AS rejections FROM a, b, k
"""
ORACLE_SQL["sample_files"] = f"""{_observed("balanced")},
    r AS (SELECT emitted, rejection, CASE WHEN emitted THEN text ELSE substr(raw, 1, 300) END AS v, row_number() OVER (PARTITION BY emitted ORDER BY time) AS k FROM seen WHERE emitted OR raw <> ''),
    l AS (SELECT [0, k] AS o, k || '. ' || v AS line FROM r WHERE emitted AND k <= 100 UNION ALL SELECT [2, k], k || '. [' || rejection || '] ' || v FROM r WHERE NOT emitted AND k <= 100
      UNION ALL VALUES ([-1, 0], 'ACCEPTED OCR SAMPLES'), ([-1, 1], repeat('=', 40)), ([1, 0], ''), ([1, 1], 'DROPPED OCR SAMPLES'), ([1, 2], repeat('=', 40)), ([3, 0], ''))
    SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS line_no, line FROM l
"""
ORACLE_SQL["quality_report"] = f"""{_REPORT}
    SELECT video_id, sampled AS total_frames_sampled, sampled - no_text AS frames_with_subtitles, sampled - no_text AS white_text_frames, no_text AS skipped_without_subtitles, same AS skipped_same_subtitle, same AS skipped_same_subtitle_frames,
      sampled - no_text - same AS actual_ocr_calls, accepted AS successful_ocr_calls, failed AS failed_ocr_calls, timeout AS timeout_ocr_calls, calls AS total_ocr_results, accepted AS accepted_ocr_results, calls - accepted AS noise_rejected,
      'default' AS quality_profile, 'hybrid' AS subtitle_detect_mode, round(area, 1) AS average_text_bbox_area, round(accepted / greatest(1, calls), 3) AS accepted_ratio, CASE WHEN accepted / greatest(1, calls) < 0.3 THEN 'filter_too_aggressive' ELSE '' END AS accepted_ratio_warning,
      0::BIGINT AS deep_analysis_attempted, 0::BIGINT AS deep_analysis_recovered, 0::BIGINT AS deep_analysis_rejected, coalesce(reasons, '') AS rejection_reasons, round(coalesce(mean, round(r_mean, 3)), 6) AS average_confidence, round(coalesce(mid, round(r_mid, 3)), 6) AS median_confidence,
      coalesce(bins, '{_NO_BINS}') AS confidence_histogram, '0.08 0.92 0.78 0.93' AS used_crop, false AS auto_region_used, coalesce(blocks, 0)::BIGINT AS subtitle_blocks_generated, 'raw.srt' AS raw_srt FROM rp
"""
ORACLE_SQL["quality_report_text"] = _text_lines()
_REGION = O.evaluated(("recall",)).replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '[^\\p{L}\\n ]+', ' ', 'g')", 1)
ORACLE_SQL["preset_trial"] = f"""
    WITH own AS ({O.evaluated()}), reg AS ({_REGION}),
    f AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE regexp_matches(coalesce(text, ''), '\\p{{L}}')),
    {_emitted("SELECT x.* FROM (SELECT *, preset AS label FROM own UNION ALL SELECT *, 'auto-region' AS label FROM reg) x JOIN f USING (doc_id) WHERE k <= 20")},
    sc AS (SELECT *, {O.score("cleaned", "confidence", O.repeats("cleaned", 5))} AS score FROM em),
    a AS (SELECT video_id, label, preset, count(*) AS sample, count(*) FILTER (emitted) AS accepted, coalesce(avg(confidence) FILTER (emitted), 0.0) AS m, coalesce(avg(score) FILTER (emitted), 0.0) AS s FROM sc GROUP BY ALL),
    o AS (SELECT *, (sample - accepted) / greatest(1, sample) AS noise FROM a),
    r AS (SELECT o.*, row_number() OVER (PARTITION BY video_id ORDER BY accepted DESC, round(m, 9) DESC, round(noise, 9), round(10000.0 * accepted + 100.0 * m + s - noise, 6) DESC, coalesce(rank, 9)) AS k FROM o LEFT JOIN {O.RANKS} ON r.preset = o.label),
    n AS (SELECT video_id, count(*) AS n FROM em WHERE label = 'recall' GROUP BY video_id)
    SELECT video_id, CASE WHEN n >= 4 THEN label END AS label, CASE WHEN n >= 4 THEN preset END AS preset, CASE WHEN n >= 4 THEN accepted END AS accepted, n AS sample FROM r JOIN n USING (video_id) WHERE k = 1
"""
ORACLE_SQL["region_trial"] = """
    WITH e AS (SELECT label::VARCHAR AS video_id, vec_id, embedding[1] > -0.05 AS a, embedding[2] > 0.0 AS b, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    u AS (SELECT video_id, max(vec_id) AS until, count(*) FILTER (a) AS initial_hits FROM e WHERE k <= 40 GROUP BY video_id),
    h AS (SELECT video_id, count(*) FILTER (b) AS region_hits FROM e JOIN u USING (video_id) WHERE vec_id <= until GROUP BY video_id)
    SELECT video_id, initial_hits, region_hits, video_id = '3' OR region_hits >= greatest(4, floor(initial_hits * 0.65)) AS use_region, video_id = '3' AS cached FROM u JOIN h USING (video_id)
"""
_ALIKE = f"""{O.EVENTS},
    al AS (SELECT video_id, event_id, t, e, confidence, text AS kind, [text, text, trim(regexp_replace(text, '(.)', '\\1 ', 'g')), text][event_id % 4 + 1] || {O.listed(tuple(x.partition("}")[2] for x in SPELLINGS))}[event_id % 4 + 1] AS text FROM ev),
    sp AS (SELECT text, {" OR ".join(f"({c})" for _, c in O.noise_flags("t"))} AS doubt FROM (SELECT DISTINCT text, {O.norm("text")} AS t FROM al))
"""


def _voted(keys: str, rows: str) -> str:
    """Recursive CTE ``vt``: the text of each key's readings (in ``rows`` with n, their order), by the voting rule within one group."""
    own = ", ".join(f"r.{k} = v.{k}" for k in keys.split(", ")).replace(", ", " AND ")
    return f"""
    rw AS MATERIALIZED ({rows}),
    vt AS (
      SELECT {keys}, n, text, confidence, greatest(0.0, CASE WHEN doubt THEN -12.0 ELSE 8.0 END) AS score FROM rw WHERE n = 1
      UNION ALL
      SELECT {", ".join(f"r.{k}" for k in keys.split(", "))}, r.n, CASE WHEN NOT r.doubt AND length(r.text) > length(v.text) AND r.confidence >= 0.80 * greatest(v.confidence, r.confidence) THEN r.text ELSE v.text END,
        greatest(v.confidence, r.confidence), greatest(v.score, CASE WHEN r.doubt THEN -12.0 ELSE 8.0 END)
      FROM vt v JOIN rw r ON {own} AND r.n = v.n + 1),
    en AS (SELECT {keys}, arg_max(text, n) AS text, max(n) AS votes, max(confidence) AS confidence, max(score) AS score FROM vt GROUP BY {keys})
"""


_ALIKE_BLOCKS = O.BLOCKS.replace("WITH ", "", 1).replace(O.EVENTS + ",", "", 1).replace("FROM ev ", "FROM al ").replace("lag(text)", "lag(kind)").replace("IS DISTINCT FROM text", "IS DISTINCT FROM kind")
ORACLE_SQL["blocks_alike"] = f"""
    WITH RECURSIVE {_ALIKE}, {_ALIKE_BLOCKS},
    {_voted("video_id, block_no", "SELECT d.video_id, d.block_no, row_number() OVER (PARTITION BY d.video_id, d.block_no ORDER BY t, event_id) AS n, d.text, d.confidence, doubt FROM d JOIN sp USING (text)")}
    SELECT bl.video_id, bl.block_no, round(start, 3) AS start, round("end", 3) AS "end", en.text, round(en.confidence, 6) AS confidence, readings, round(en.score, 4)::DOUBLE AS score FROM bl JOIN en ON bl.video_id = en.video_id AND bl.block_no = en.block_no
"""
ORACLE_SQL["votes_alike"] = f"""
    WITH RECURSIVE {_ALIKE},
    {_voted("video_id, kind", "SELECT al.video_id, kind, row_number() OVER (PARTITION BY al.video_id, kind ORDER BY t, event_id) AS n, al.text, confidence, doubt FROM al JOIN sp USING (text)")},
    fs AS (SELECT video_id, kind, min((t, event_id)) AS first FROM al GROUP BY ALL),
    rk AS (SELECT en.*, count(*) OVER (PARTITION BY video_id) AS groups, row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, confidence DESC, score DESC, length(text) DESC, first) AS k FROM en JOIN fs USING (video_id, kind))
    SELECT video_id, text, votes, groups, round(score, 4)::DOUBLE AS score, round(confidence, 6) AS confidence FROM rk WHERE k = 1
"""


ORACLE_SQL["observation_keys"] = f"""
    WITH {O.EVENTS}, f AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY t, event_id) IS DISTINCT FROM text AS changed FROM ev),
    h AS (SELECT video_id, t, ('0x' || substr(md5(round(t * 1000)::BIGINT || '|' || round(e * 1000)::BIGINT || '|' || printf('%012d', event_id) || '|0|0'), 1, 15))::BIGINT AS k FROM f WHERE changed),
    g AS (SELECT video_id, video_id::BIGINT AS u, count(*) AS n, round(min(t) * 1000)::BIGINT AS a, round(max(t) * 1000)::BIGINT AS z, sha1(sum(k)::VARCHAR) AS c FROM h GROUP BY video_id),
    j AS (SELECT *, CASE WHEN u % 5 > 0 THEN sha1(video_id) END AS f FROM g),
    k AS (SELECT *, substr(sha1('{{"candidate_digest":"' || c || '","crop":"0.08 0.92 0.78 0.93","deep":"short","detect_changes":"False","detect_mode":"hybrid","end_ms":"null","engine":"tesseract","first_ms":"' || a || '","input_hash":"' || coalesce(f, 'null')
      || '","last_ms":"' || z || '","mask_similarity":"0.9","max_calls":"500","max_frames":"null","min_gap":"2.0","n":"' || n || '","noise":"standard","preprocess":"auto","preset":"balanced","quality_profile":"default","sample_rate":"0.75","sanity":"ollama","speed":"balanced","start_ms":"'
      || CASE WHEN u % 2 > 0 THEN round(u / 4 * 1000)::BIGINT::VARCHAR ELSE 'null' END || '","version":"5"}}'), 1, 16) AS digest FROM j)
    SELECT video_id, digest, coalesce(substr(f, 1, 16), 'no_video_hash') || '_' || digest AS cache_key FROM k
"""
ORACLE_SQL["region_settings"] = """
    WITH e AS (SELECT label::VARCHAR AS video_id, label, vec_id, embedding[1] > -0.05 AS a, embedding[2]::DOUBLE > 0.02 AS b, 0.7 + embedding[3]::DOUBLE / 2 AS y1, 0.8 + embedding[4]::DOUBLE / 2 AS y2, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE label IS NOT NULL),
    p1 AS (SELECT video_id, y1, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) AS k FROM e WHERE y1 > 0), p2 AS (SELECT video_id, y2, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) AS k FROM e WHERE y2 > 0),
    r1 AS (SELECT video_id, greatest(0.55, least(0.82, median(y1) - 0.06)) AS y1 FROM p1 WHERE k <= 200 GROUP BY video_id HAVING count(*) >= 10),
    r2 AS (SELECT video_id, median(y2) + 0.06 AS y2 FROM p2 WHERE k <= 200 GROUP BY video_id HAVING count(*) >= 10),
    rg AS (SELECT video_id, y1, greatest(y1 + 0.12, least(0.99, y2)) AS y2 FROM r1 JOIN r2 USING (video_id)),
    u AS (SELECT video_id, label, max(vec_id) FILTER (k <= CASE WHEN label < 5 THEN 60 ELSE 20 END) AS until, count(*) FILTER (a AND k <= CASE WHEN label < 5 THEN 60 ELSE 20 END) AS hits FROM e GROUP BY ALL),
    h AS (SELECT video_id, label, any_value(hits) AS hits, count(*) FILTER (b AND vec_id <= until + 0.75) AS more FROM e JOIN u USING (video_id, label) GROUP BY ALL),
    c AS (SELECT h.*, rg.y1, rg.y2, rg.y1 IS NOT NULL AND more >= greatest(4, floor(hits * 0.65)) AS use_region,
      substr(sha1('{"_crop":"0.1 0.9 0.6 0.95","_detect":"hybrid","_identity":"/media/' || video_id || ':' || label * 1000 || ':' || label * 60 || '","_preset":"recall","_rate":"0.75","_speed":"balanced"}'), 1, 16) AS settings_digest FROM h LEFT JOIN rg USING (video_id))
    SELECT video_id, settings_digest, CASE WHEN use_region THEN 0.08 ELSE 0.1 END::DOUBLE AS x1, CASE WHEN use_region THEN 0.92 ELSE 0.9 END::DOUBLE AS x2, round(CASE WHEN use_region THEN y1 ELSE 0.6 END, 6) AS y1, round(CASE WHEN use_region THEN y2 ELSE 0.95 END, 6) AS y2, use_region, label < 5 AS cached FROM c
"""
_LATE = """
    WITH e AS (SELECT event_id, epoch_us(ts) AS u, floor((epoch_us(ts) / 1e6 + value * 1800.0) / 432000.0) AS arrival FROM events),
    b AS (SELECT *, dense_rank() OVER (ORDER BY arrival) - 1 AS batch FROM e),
    m AS (SELECT batch, max(max(u)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000000 AS mark FROM b GROUP BY batch),
    r AS (SELECT event_id, batch, coalesce(u <= mark, false) AS late, CASE WHEN u <= mark THEN (mark - u) / 1e6 END AS behind FROM b JOIN m USING (batch))
"""
ORACLE_SQL["late_rows"] = f"{_LATE} SELECT event_id, batch, late, round(behind, 3) AS behind FROM r"
ORACLE_SQL["late_row_counts"] = f"{_LATE} SELECT batch, count(*) AS readings, count(*) FILTER (late) AS late, round(max(behind), 3) AS worst FROM r GROUP BY batch"


def _shown() -> str:
    turns = lambda texts: f"{O.listed(texts)}[event_id % {len(texts)} + 1]"
    return "CASE text " + " ".join(f"WHEN '{kind}' THEN {turns(texts)}" for kind, texts in SHOWN.items()) + " ELSE '' END"


def _deep_votes_sql() -> str:
    flags = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in O.noise_flags("t"))
    w = O.words("t")
    common = O.size_of(O.words("lower(t)"), f"list_contains({O.listed(LATIN.common)}, x)")
    return f"""
    WITH {O.EVENTS},
    bs AS (SELECT video_id, CASE WHEN video_id::BIGINT % 2 = 0 THEN 'all' ELSE ts::DATE::VARCHAR END AS frame_id, event_id, confidence, {_shown()} AS base FROM ev),
    rd AS (SELECT *, 0 AS v, base AS text FROM bs UNION ALL SELECT *, 1, CASE WHEN base <> '' AND event_id % 3 = 0 THEN base || 's' ELSE '' END FROM bs UNION ALL SELECT *, 2, CASE WHEN base <> '' AND confidence >= 0.2 THEN base || '!' ELSE '' END FROM bs),
    rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY event_id, v) AS n FROM rd),
    sc AS (SELECT *, {O.score("text", "confidence", O.repeats("text", 5))} AS score FROM rk WHERE n <= 24 AND text <> ''),
    ld AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, base ORDER BY score DESC, n) AS k FROM sc),
    gr AS (SELECT video_id, frame_id, base, count(*) AS votes, max(confidence) AS confidence, max(score) AS score, max(CASE WHEN k = 1 THEN text END) AS text, min(n) AS first FROM ld GROUP BY ALL),
    wn AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY votes DESC, confidence DESC, score DESC, length(text) DESC, first) AS k FROM gr),
    tx AS MATERIALIZED (SELECT t, concat_ws(',', {flags}) AS found, {O.valid_short("t")} AS sh, {common} AS common, len({w}) AS n, length({O.joined(w)}) AS chars, {O.vowels(O.joined(w))} AS vow, {O.size_of(w, "length(x) >= 3")} AS longer, {O.meaningful("t")} AS sense FROM (SELECT DISTINCT text AS t FROM wn WHERE k = 1)),
    ok AS (SELECT *, sh OR common > 0 OR (n > 0 AND found = '' AND chars >= 5 AND vow / greatest(1, chars) >= 0.22 AND (longer >= 2 OR chars >= 12)) AS fit FROM tx),
    oc AS (SELECT f.video_id, f.frame_id, w.text, w.confidence, CASE WHEN w.votes IS NULL THEN 'deep_no_text' WHEN NOT fit THEN 'deep_rejected_language_validity:' || coalesce(nullif(found, ''), 'no_common_word') WHEN w.votes >= 2 THEN 'deep_vote'
        WHEN sh THEN 'deep_valid_short' WHEN found = '' AND sense >= 4 THEN 'deep_single_valid' ELSE 'deep_unconfirmed_noise:' || coalesce(nullif(found, ''), 'unknown') END AS outcome
      FROM (SELECT DISTINCT video_id, frame_id FROM rk) f LEFT JOIN wn w ON w.video_id = f.video_id AND w.frame_id = f.frame_id AND w.k = 1 LEFT JOIN ok ON ok.t = w.text)
    SELECT video_id, frame_id, outcome, CASE WHEN outcome IN ('deep_vote', 'deep_valid_short', 'deep_single_valid') THEN text ELSE '' END AS text, CASE WHEN outcome IN ('deep_vote', 'deep_valid_short', 'deep_single_valid') THEN round(confidence, 6) ELSE 0.0 END AS confidence FROM oc
"""


ORACLE_SQL["deep_votes_alike"] = _deep_votes_sql()


def _short_ratios() -> str:
    """Rows (a, b, ratio) of the short texts' keys, by the same library as the operator: SQL has no such function."""
    keys = ["".join(c for c in x.lower() if c.isalnum()) for x in SHORT_TEXTS]
    return ", ".join(f"({O.q(a)}, {O.q(b)}, {B.likeness(a, b)!r})" for a in dict.fromkeys(keys) for b in dict.fromkeys(keys))


ORACLE_SQL["neighbor_noise_alike"] = f"""
    WITH {O.EVENTS}, x AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id)::INTEGER AS block_no, {O.listed(SHORT_TEXTS)}[(event_id * 7 + event_id // 3) % {len(SHORT_TEXTS)} + 1] AS text FROM ev),
    f0 AS (SELECT text, text AS t, {O.key("text")} AS key FROM (SELECT DISTINCT text FROM x)),
    f1 AS (SELECT text, key, {_OWN} AS own, {_SAFE} AS safe, len({_LW}) AS n, {_FEW} AS few, {O.size_of(_LW, "length(x) <= 3")} AS tiny, {O.size_of(_LW, "length(x) >= 4")} AS longer, {O.count(O.joined(_LW), LATIN.vowels)} AS v FROM f0),
    f AS (SELECT text, key, own BETWEEN 1 AND 19 AND NOT safe AND (few / greatest(1, n) > 0.50 OR tiny = n OR (own >= 4 AND v / greatest(1, own) < 0.20)) AS short,
      own >= 20 AND NOT safe AND n >= 4 AND few / greatest(1, n) >= 0.55 AND longer < 2 AS fragments FROM f1),
    b AS (SELECT x.*, key, short, short OR fragments AS sus, lag(key) OVER w AS pk, lag(short) OVER w AS ps, lead(key) OVER w AS nk, lead(short) OVER w AS ns FROM x JOIN f USING (text) WINDOW w AS (PARTITION BY video_id ORDER BY block_no)),
    rt(a, b, ratio) AS (VALUES {_short_ratios()})
    SELECT video_id, block_no, text FROM b LEFT JOIN rt p ON p.a = key AND p.b = pk AND NOT ps LEFT JOIN rt n ON n.a = key AND n.b = nk AND NOT ns
    WHERE NOT sus OR greatest(coalesce(p.ratio, 0.0), coalesce(n.ratio, 0.0)) >= 0.55
"""
ORACLE_SQL["gate_stats"] = """
    WITH RECURSIVE f AS (SELECT label::VARCHAR AS video_id, vec_id::DOUBLE AS t, embedding[1] > -0.1 AS detected, list_transform(embedding, lambda x: x > 0) AS mask, embedding::DOUBLE[] AS small, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
    g AS (
      SELECT video_id, 0::BIGINT AS rn, '' AS state, false AS active, NULL::DOUBLE AS read_at, NULL::BOOLEAN[] AS mask, NULL::DOUBLE[] AS small FROM (SELECT DISTINCT video_id FROM f)
      UNION ALL
      SELECT video_id, rn, state, state <> 'no_text' AND (state = 'emit' OR active), CASE WHEN state = 'emit' THEN t ELSE read_at END,
        CASE state WHEN 'emit' THEN own_mask WHEN 'same' THEN mask END, CASE state WHEN 'emit' THEN own_small WHEN 'same' THEN small END
      FROM (
        SELECT *, CASE WHEN NOT detected THEN 'no_text' WHEN active AND diff < 0.2 AND (alike > 0.4 OR (alike >= 0.75 * 0.4 AND read_at IS NOT NULL AND t - read_at < 2.0)) THEN 'same' ELSE 'emit' END AS state
        FROM (
          SELECT g.video_id, f.rn, f.t, f.detected, g.active, g.read_at, g.mask, g.small, f.mask AS own_mask, f.small AS own_small,
            CASE WHEN g.small IS NULL THEN 1.0 ELSE list_sum(list_transform(range(1, len(f.small) + 1), lambda i: abs(f.small[i] - g.small[i]))) / len(f.small) END AS diff,
            CASE WHEN g.mask IS NULL THEN 0.0 WHEN len(list_filter(range(1, len(f.mask) + 1), lambda i: f.mask[i] OR g.mask[i])) = 0 THEN 1.0
              ELSE len(list_filter(range(1, len(f.mask) + 1), lambda i: f.mask[i] AND g.mask[i])) / len(list_filter(range(1, len(f.mask) + 1), lambda i: f.mask[i] OR g.mask[i])) END AS alike
          FROM g JOIN f ON f.video_id = g.video_id AND f.rn = g.rn + 1)))
    SELECT video_id, count(*) AS sampled, count(*) FILTER (state <> 'no_text') AS with_text, count(*) FILTER (state = 'no_text') AS skipped_no_text, count(*) FILTER (state = 'same') AS skipped_same, count(*) FILTER (state = 'emit') AS calls
    FROM g WHERE rn > 0 GROUP BY video_id
"""
ORACLE_SQL |= vision.ORACLE_SQL
