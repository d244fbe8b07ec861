"""Configurations compared in one query: readings under every preset at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRESETS, SEARCH_ORDER, Crop, presets_table
from ..functions import text as T
from ..functions.core import ladder, let
from ..functions.scripts import CYRILLIC, Script
from . import quality
from .candidates import common_region, is_candidate


def _under(presets: list[str] | None, script: Script) -> Column:
    return T.clean_under(F.coalesce("text", F.lit("")), [(name, *PRESETS[name][:2]) for name in presets or list(PRESETS)], script)


def cleaned(readings: DataFrame, presets: list[str] | None = None, script: Script = CYRILLIC) -> DataFrame:
    """Readings under every preset's cleaner alone: adds preset, cleaned, reason; what is kept of them is ``evaluate``'s to tell."""
    df = readings.select("*", F.explode(_under(presets, script)).alias("_x"))
    return df.withColumns({"preset": F.col("_x.preset"), "cleaned": F.col("_x.r.cleaned"), "reason": F.col("_x.r.reason")}).drop("_x")


def evaluate(readings: DataFrame, presets: list[str] | None = None, script: Script = CYRILLIC, noise_mode: str = "standard", sanity: str = "off") -> DataFrame:
    """Readings under every preset: adds preset, cleaned, reason, emitted, kept, rejection, score; one row for each pair.

    ``reason`` is the cleaner's; ``emitted``, ``kept`` (the text, empty where it
    goes) and ``rejection`` are the read loop's, with its noise filter and, where
    asked for, language sanity.  All presets' results of a reading are computed in
    its own row, from features that they share, each different cleaned text is
    judged once, and then they are unfolded, so readings aren't joined or moved.
    """
    each = _under(presets, script)

    def judged(found: Column) -> Column:
        accepted = F.filter(found, lambda x: (x["r"]["reason"] == "accepted") & (x["r"]["cleaned"] != ""))
        texts = F.array_distinct(F.transform(accepted, lambda x: x["r"]["cleaned"]))
        verdicts = F.transform(texts, lambda t: F.struct(t.alias("cleaned"), quality.verdict(t, noise_mode, script, sanity).alias("v")))
        of = lambda x, seen: F.get(F.filter(seen, lambda v: v["cleaned"] == x["r"]["cleaned"]), F.lit(0))["v"]
        return let(verdicts, lambda seen: F.transform(found, lambda x: F.struct(x["preset"].alias("preset"), x["r"].alias("r"), of(x, seen).alias("v"))))

    df = readings.select("*", F.explode(let(each, judged)).alias("_x"))
    ok = F.col("_x.r.reason") == "accepted"
    kept = F.when(ok, F.coalesce("_x.v.text", F.lit(""))).otherwise(F.lit(""))
    df = df.withColumns({"preset": F.col("_x.preset"), "cleaned": F.col("_x.r.cleaned"), "reason": F.col("_x.r.reason"), "kept": kept})
    df = df.withColumns({"emitted": F.col("kept") != "", "rejection": F.when(F.col("kept") == "", F.when(ok, F.coalesce("_x.v.rejection", F.lit("empty"))).otherwise(F.col("reason")))}).drop("_x")
    return df.withColumn("score", T.candidate_score(F.col("kept"), F.col("confidence"), script))


def scores(evaluated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Emitted (``accepted``) and dropped readings, their mean score and confidence, noise ratio and composite score of each preset."""
    ok = F.col("emitted")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    df = evaluated.groupBy(*(keys or []), "preset").agg(F.count("*").alias("sample"), F.count_if(ok).alias("accepted"), mean("confidence").alias("avg_confidence"), mean("score").alias("avg_score"))
    df = df.withColumn("dropped", F.col("sample") - F.col("accepted"))
    df = df.withColumn("noise_ratio", F.greatest(F.lit(0), F.col("dropped")) / F.greatest(F.lit(1), F.col("sample")))
    return df.withColumn("composite", 10000.0 * F.col("accepted") + 100.0 * F.col("avg_confidence") + F.col("avg_score") - F.col("noise_ratio"))


def best_preset(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The preset of the most accepted readings, then confidence, least noise and score; earlier trials win ties."""
    ranks = presets_table(scored.sparkSession).select("preset", "rank")
    order = F.struct(F.col("accepted"), F.round("avg_confidence", 9), -F.round("noise_ratio", 9), F.round("composite", 6), -F.col("rank"))
    df = scored.join(F.broadcast(ranks), "preset")  # one row for each preset
    return df.groupBy(*(keys or [])).agg(F.max_by("preset", order).alias("preset"), F.max_by("accepted", order).alias("accepted"), F.max_by("sample", order).alias("sample"))


def trial(readings: DataFrame, regions: DataFrame | None = None, script: Script = CYRILLIC, sample: int = 100, least: int = 4) -> DataFrame:
    """video_id, label, preset, accepted, sample of each video's best configuration.

    The first ``sample`` readings of a video's candidates (frames with a text that
    changed; all frames, where the readings don't say) are cleaned and judged under
    every preset; with ``regions`` (readings of the same frames from a detected region) the preset
    ``recall`` is tried on those too, as ``auto-region``.  Videos of fewer than
    ``least`` readings keep what they have: label and preset are null.  The
    highest count of emitted readings wins, then confidence, least noise and
    score, then the earlier trial.
    """
    first = lambda df: sample_per_key(df.where(is_candidate(df)), ["video_id"], ["time", "frame_id"], sample)
    own = first(readings)
    counts = own.groupBy("video_id").agg(F.count("*").alias("_n"))
    tried = scores(evaluate(own, script=script), ["video_id"]).withColumn("label", F.col("preset"))
    if regions is not None:
        tried = tried.unionByName(scores(evaluate(first(regions), ["recall"], script), ["video_id"]).withColumn("label", F.lit("auto-region")))
    trials = {name: i for i, name in enumerate([*SEARCH_ORDER, "auto-region"])}
    rank = ladder(*[(F.col("label") == name, i) for name, i in trials.items()], otherwise=len(trials))
    order = F.struct(F.col("accepted"), F.round("avg_confidence", 9), -F.round("noise_ratio", 9), F.round("composite", 6), -rank)
    best = tried.groupBy("video_id").agg(*[F.max_by(c, order).alias(c) for c in ("label", "preset", "accepted")])
    enough = F.col("_n") >= least
    return counts.join(best, "video_id").select("video_id", *[F.when(enough, F.col(c)).alias(c) for c in ("label", "preset", "accepted")], F.col("_n").alias("sample"))


def chosen_readings(readings: DataFrame, trials: DataFrame, regions: DataFrame | None = None, script: Script = CYRILLIC, default: str = "recall") -> DataFrame:
    """All readings cleaned under their video's winner, from the detected region where that won: the run after the trial."""
    won = trials.select("video_id", F.coalesce("preset", F.lit(default)).alias("_p"), F.coalesce(F.col("label") == "auto-region", F.lit(False)).alias("_region"))
    source = readings.withColumn("_from", F.lit(False))
    if regions is not None:
        source = source.unionByName(regions.withColumn("_from", F.lit(True)))
    else:
        won = won.withColumn("_region", F.lit(False))
    mine = source.join(won, "video_id").where(F.col("_from") == F.col("_region")).drop("_from", "_region")
    return evaluate(mine, script=script).where(F.col("preset") == F.col("_p")).drop("_p")


def region_is_better(hits: int, initial: int) -> bool:
    """Whether a detected region replaces the initial crop."""
    return hits >= max(4, int(0.65 * initial))


def region_trial(initial: DataFrame, regional: DataFrame, settings: DataFrame | None = None, sample: int = 120, rate: float = 0.75) -> DataFrame:
    """video_id, initial_hits, region_hits, use_region, cached: the balanced mode's choice of region.

    ``initial`` and ``regional`` are candidates (video_id, time, has_subtitle) of
    the usual crop and of the detected region; only the time of the first
    ``sample`` initial ones counts, to the end of the last (``end_time``, where
    that is known) and ``rate`` more.  ``settings`` (video_id, use_region) are choices
    made before; they are taken over, and nothing is counted for those videos'
    verdict.  A video without a detected region keeps its crop.
    """
    first = sample_per_key(initial, ["video_id"], ["time"], sample)
    end = F.coalesce("end_time", "time") if "end_time" in first.columns else F.col("time")
    until = first.groupBy("video_id").agg((F.max(end) + rate).alias("_until"), F.count_if("has_subtitle").alias("initial_hits"))
    hits = regional.join(until.select("video_id", "_until"), "video_id").where(F.col("time") <= F.col("_until")).groupBy("video_id").agg(F.count_if("has_subtitle").alias("region_hits"))
    df = until.drop("_until").join(hits, "video_id", "left")
    better = F.coalesce(F.col("region_hits") >= F.greatest(F.lit(4), F.floor(F.col("initial_hits") * 0.65)), F.lit(False))
    if settings is None:
        return df.select("video_id", "initial_hits", F.coalesce("region_hits", F.lit(0)).alias("region_hits"), better.alias("use_region"), F.lit(False).alias("cached"))
    known = settings.select("video_id", F.col("use_region").alias("_known"))
    df = df.join(known, "video_id", "left")
    return df.select("video_id", "initial_hits", F.coalesce("region_hits", F.lit(0)).alias("region_hits"), F.coalesce("_known", better).alias("use_region"), F.col("_known").isNotNull().alias("cached"))


def region_settings(keys: DataFrame, initial: DataFrame, regional: DataFrame, stored: DataFrame | None = None, crop: Crop = Crop(), sample: int = 120) -> DataFrame:
    """video_id, settings_digest, x1, x2, y1, y2, use_region, cached: the crop that each video is read with.

    ``keys`` has video_id and settings_digest, one row each; ``stored`` has
    settings_digest and the values of earlier choices, which are taken over
    whole: nothing is detected or counted for those videos again.  For the others
    the detected region of ``initial`` (with text boxes) is tried; a video
    without one keeps its crop.  The rows without ``cached`` are what a caller
    adds to ``stored``.
    """
    values = ("x1", "x2", "y1", "y2", "use_region")
    known = None if stored is None else keys.join(stored.select("settings_digest", *values), "settings_digest")
    left = keys if known is None else keys.join(known.select("video_id"), "video_id", "left_anti")
    mine = initial.join(left.select("video_id"), "video_id", "left_semi")
    found = common_region(mine).select("video_id", F.col("y1").alias("_y1"), F.col("y2").alias("_y2"))
    tried = region_trial(mine, regional.join(found.select("video_id"), "video_id", "left_semi"), sample=sample).select("video_id", F.col("use_region").alias("_use"))
    df = left.join(found, "video_id", "left").join(tried, "video_id", "left")  # one row for each video
    use = F.coalesce(F.col("_use") & F.col("_y1").isNotNull(), F.lit(False))
    usual = Crop()
    side = lambda tried, own: F.when(use, tried).otherwise(F.lit(own))
    sides = {"x1": side(F.lit(usual.x1), crop.x1), "x2": side(F.lit(usual.x2), crop.x2), "y1": side(F.col("_y1"), crop.y1), "y2": side(F.col("_y2"), crop.y2)}
    chosen = df.select("video_id", "settings_digest", *[c.alias(name) for name, c in sides.items()], use.alias("use_region"))
    chosen = chosen.withColumn("cached", F.lit(False))
    return chosen if known is None else chosen.unionByName(known.select("video_id", "settings_digest", *values).withColumn("cached", F.lit(True)))


def benchmark(evaluated: DataFrame, blocks: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """The benchmark's ten figures of each preset (D18, K10). ``blocks`` has preset; ``seconds`` (preset, seconds) is what its run took.

    Frames without a text of their own, or the same as before, are no candidates
    and count for the speed alone; only candidates are read.
    """
    asked = is_candidate(evaluated)
    ok = asked & F.col("emitted")
    conf = F.when(ok, F.col("confidence"))
    status = lambda s: F.count_if(asked & (F.col("status") == s)) if "status" in evaluated.columns else F.lit(0).cast("bigint")
    a = evaluated.groupBy("preset").agg(
        F.count_if(asked).alias("ocr_candidates"), F.count_if(ok).alias("ocr_hits"), F.coalesce(F.avg(conf), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.median(conf), F.lit(0.0)).alias("median_confidence"), status("timeout").alias("timeout_frames"), status("failed").alias("failed_frames"),
        F.count_if(ok).alias("successful_frames"), F.count("*").alias("_frames"),
    )
    b = blocks.groupBy("preset").agg(F.count("*").alias("subtitle_blocks"))
    took = F.lit(None).cast("double") if seconds is None else F.when(F.col("seconds").isNotNull(), F.greatest(F.lit(0.001), F.col("seconds")))
    df = a.join(b, "preset", "left")  # one row for each preset
    df = df if seconds is None else df.join(seconds, "preset", "left")
    df = df.withColumns({"subtitle_blocks": F.coalesce("subtitle_blocks", F.lit(0)), "processing_seconds": took})
    return df.withColumn("processing_speed_candidates_per_second", F.col("_frames") / F.col("processing_seconds")).drop("_frames", "seconds")


def benchmark_html(report: DataFrame) -> DataFrame:
    """The report as one HTML page; it has a row for each preset."""
    cell = lambda fmt, c: F.format_string(f"<td>{fmt}</td>", F.coalesce(F.col(c), F.lit(0)))
    row = F.concat(
        F.lit("<tr>"), F.concat(F.lit("<td>"), F.col("preset"), F.lit("</td>")), cell("%d", "ocr_candidates"), cell("%d", "ocr_hits"), cell("%d", "subtitle_blocks"),
        cell("%.3f", "average_confidence"), cell("%d", "timeout_frames"), cell("%d", "failed_frames"), cell("%.2f", "processing_speed_candidates_per_second"), F.lit("</tr>"),
    )
    heads = "".join(f"<th>{h}</th>" for h in ("Preset", "OCR candidates", "OCR hits", "Subtitle blocks", "Average confidence", "Timeout frames", "Failed frames", "Candidates/s"))
    w = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preset", row.alias("row")))), lambda x: x["row"]), "")
    page = F.concat(F.lit(f"<!doctype html><meta charset='utf-8'><title>OCR benchmark</title><h1>OCR benchmark</h1><table><thead><tr>{heads}</tr></thead><tbody>"), w, F.lit("</tbody></table>"))
    return report.agg(page.alias("html"))


def sample_per_key(df: DataFrame, keys: list[str], order: str | list[str], n: int) -> DataFrame:
    """The first rows of each key (L4); Spark cuts groups before they are moved."""
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
