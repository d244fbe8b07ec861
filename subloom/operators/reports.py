"""Aggregates and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ladder
from ..sources import inputs

# fixed values: upper edges of the histograms' bins; the last bin is open
EQUAL_BINS = (("0.0-0.2", 0.2), ("0.2-0.4", 0.4), ("0.4-0.6", 0.6), ("0.6-0.8", 0.8), ("0.8-1.0", None))
QUALITY_BINS = (("0.00-0.50", 0.50), ("0.50-0.70", 0.70), ("0.70-0.85", 0.85), ("0.85-0.95", 0.95), ("0.95-1.00", None))


def bin_of(value: Column, bins: tuple = EQUAL_BINS) -> Column:
    return ladder(*[(value < edge, name) for name, edge in bins[:-1]], otherwise=bins[-1][0])


def histogram(df: DataFrame, column: str, bins: tuple = EQUAL_BINS, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n: every bin has a row, empty ones too."""
    name = bin_of(F.col(column), bins)
    counts = df.groupBy(*(keys or [])).agg(*[F.count_if(F.col(column).isNotNull() & (name == b)).alias(b) for b, _ in bins])
    stack = ", ".join(f"'{b}', `{b}`" for b, _ in bins)
    return counts.selectExpr(*(keys or []), f"stack({len(bins)}, {stack}) as (bin, n)")


def exact_median(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, median: the exact median of a column of doubles, found 16 bits at a time (A4).

    A double's bits, with those of negative ones turned round, are in the order of
    the numbers.  Each of four steps counts the values that share the bits found
    so far by their next 16: at most 65,536 counts a key and rank, combined where
    rows are read, whatever the number of distinct values and however large one
    key.  Nulls and NaN don't count; keys without a value have no row.
    """
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(column).cast("double") + F.lit(0.0)).cast("bigint")
    turned = lambda b: F.when(b < 0, b.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(b)
    own = [F.coalesce(F.to_json(F.struct(*keys)), F.lit("{}")).alias("_k")] if keys else [F.lit("").alias("_k")]
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(*keys, *own, bits.alias("_b")).select(*keys, "_k", turned(F.col("_b")).alias("_b"))
    named = rows.groupBy("_k", *keys).agg(F.count("*").alias("_n"))
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), F.floor((F.col("_n") - 1 + i) / 2).alias("_rank")) for i in (0, 1)])
    state = named.select("_k", F.inline(ranks)).withColumn("_p", F.lit(0).cast("bigint"))
    for step in range(4):
        digit = F.shiftright("_b", 48) if step == 0 else F.shiftright("_b", 48 - 16 * step).bitwiseAND(F.lit(0xFFFF))
        same = rows.select("_k", "_b").withColumn("_at", F.lit(0).cast("bigint") if step == 0 else F.shiftright("_b", 64 - 16 * step)).withColumn("_d", digit)
        met = same.join(state.withColumnRenamed("_p", "_at"), ["_k", "_at"])
        counts = met.groupBy("_k", "_i", "_rank", "_at", "_d").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_k", "_i").orderBy("_d"))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
        prefix = F.col("_d") if step == 0 else F.shiftleft("_at", 16).bitwiseOR(F.col("_d"))
        state = found.select("_k", "_i", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"), prefix.cast("bigint").alias("_p"))
    value = F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), turned(F.col("_p"))).cast("double")
    middle = state.select("_k", value.alias("_v")).groupBy("_k").agg((F.sum("_v") / 2).alias("median"))
    return named.join(middle, "_k").select(*keys, "median")


def confidence_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, accepted share, mean and exact median of the confidences (A1-A4)."""
    ok = F.col("accepted")
    conf = F.when(ok, F.col("confidence"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(ok).alias("n_accepted"), F.coalesce(F.avg(conf), F.lit(0.0)).alias("avg_confidence"))
    middle = exact_median(df.where(ok), keys, "confidence")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = counts.alias("a").join(middle.alias("b"), reduce(and_, same), "left") if keys else counts.join(middle, F.lit(True), "left")  # two single rows
    columns = [F.col(f"a.{k}").alias(k) for k in keys]
    return (
        joined.select(*columns, "calls", "n_accepted", "avg_confidence", F.coalesce("median", F.lit(0.0)).alias("median_confidence"))
        .withColumn("accepted_ratio", F.col("n_accepted") / F.greatest(F.lit(1), F.col("calls")))
        .withColumn("low_yield", F.col("accepted_ratio") < 0.3)
    )


def engine_counts(observations: DataFrame, engines: DataFrame) -> DataFrame:
    """engine, n: engines that were never chosen have 0 (A8). ``engines`` is a short list."""
    return engines.join(observations.groupBy("engine").agg(F.count("*").alias("_n")), "engine", "left").select("engine", F.coalesce("_n", F.lit(0)).alias("n"))


def average_area(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Mean text area among detected frames with a positive one (A10)."""
    positive = F.when(F.col("has_subtitle") & (F.col("text_bbox_area") > 0), F.col("text_bbox_area"))
    return candidates.groupBy(*keys).agg(F.coalesce(F.avg(positive), F.lit(0.0)).alias("avg_area"))


def average_duration(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Block count and mean duration."""
    return blocks.groupBy(*keys).agg(F.count("*").alias("blocks"), F.avg(F.col("end") - F.col("start")).alias("avg_duration"))


def reason_counts(observations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rejection_reasons: array of (reason, n) in the order in which reasons first came up.

    Whole rejections are counted first, so that only distinct ones are parted.
    """
    at = F.min(F.struct("time", "frame_id"))
    whole = observations.where(~F.col("emitted")).groupBy(*keys, F.coalesce("rejection", F.lit("")).alias("rejection")).agg(F.count("*").alias("n"), at.alias("at"))
    each = whole.select(*keys, "n", "at", F.posexplode(F.split("rejection", ",")).alias("i", "reason"))
    each = each.withColumn("reason", F.when(F.trim("reason") == "", F.lit("empty")).otherwise(F.trim("reason")))
    each = each.groupBy(*keys, "reason").agg(F.sum("n").alias("n"), F.min(F.struct("at", "i")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "reason", "n")))
    return each.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("n"))).alias("rejection_reasons"))


def _bin_counts(column: str, bins: tuple) -> Column:
    name = bin_of(F.col(column), bins)
    return F.array(*[F.struct(F.lit(b).alias("bin"), F.count_if(F.col(column).isNotNull() & (name == b)).alias("n")) for b, _ in bins])


def _no_bins(bins: tuple) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(0).cast("bigint").alias("n")) for b, _ in bins])


def reading_totals(observations: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what reports say of readings, one partial aggregate of them: counts, mean, bins, engines, retries; and the exact median beside it."""
    conf = F.when(F.col("emitted"), F.col("confidence"))
    deep = F.col("deep") if "deep" in observations.columns else F.lit(None).cast("string")
    df = observations.withColumns({"_conf": conf, "_deep": deep})
    out = df.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if("emitted").alias("accepted"), F.count_if(F.col("_deep").isNotNull()).alias("deep_attempted"), F.count_if(F.col("_deep") == "recovered").alias("deep_recovered"),
        F.count_if(F.col("_deep") == "rejected").alias("deep_rejected"), F.avg("_conf").alias("mean"), _bin_counts("_conf", EQUAL_BINS).alias("bins"),
        F.array(*[F.struct(F.lit(e).alias("engine"), F.count_if(F.col("emitted") & (F.col("engine") == e)).alias("n")) for e in ("tesseract", "paddle")]).alias("engines"),
    )
    middle = exact_median(observations.where("emitted"), keys, "confidence")
    return out.join(middle, keys, "left") if keys else out.join(middle, F.lit(True), "left")


def ocr_report(observations: DataFrame, blocks: DataFrame) -> DataFrame:
    """The quality report of everything as one row (K3, K7): counts, confidences, bins, blocks and (reason, n) in order of appearance."""
    b = blocks.agg(F.count("*").alias("subtitle_blocks_generated"), F.coalesce(F.avg(F.col("end") - F.col("start")), F.lit(0.0)).alias("average_subtitle_duration"))
    one = F.lit(True)
    joined = reading_totals(observations, []).join(b, one).join(reason_counts(observations.withColumn("_all", F.lit(0)), ["_all"]).drop("_all"), one, "left")  # single rows
    return joined.select(
        F.col("calls").alias("actual_ocr_calls"), "accepted", (F.col("calls") - F.col("accepted")).alias("rejected"), F.coalesce("mean", F.lit(0.0)).alias("average_confidence"), F.coalesce("median", F.lit(0.0)).alias("median_confidence"),
        F.col("bins").alias("confidence_histogram"), "subtitle_blocks_generated", "average_subtitle_duration", F.coalesce("rejection_reasons", F.array().cast("array<struct<reason: string, n: bigint>>")).alias("rejection_reasons"),
        (F.col("accepted") / F.greatest(F.lit(1), F.col("calls"))).alias("accepted_ratio"),
    )


def as_printed(column: str, digits: int) -> Column:
    """A number as the text report prints it, read back."""
    return F.format_string(f"%.{digits}f", F.col(column)).cast("double")


def quality_report(
    observations: DataFrame, blocks: DataFrame, stats: DataFrame, statuses: DataFrame, candidates: DataFrame, profile: str = "default", detect_mode: str = "hybrid", crop: tuple = (0.08, 0.92, 0.78, 0.93), auto_region: bool = False, raw_srt: str = ""
) -> DataFrame:
    """A video's quality report, a row with the report document's 29 fields, and what only the text report shows in ``readings``.

    Needs observations (video_id, time, frame_id, emitted, engine, confidence,
    rejection; ``deep`` where frames were retried), blocks (video_id,
    confidence), stats (the gate's), statuses (video_id, status of each reading)
    and candidates (video_id, has_subtitle, text_bbox_area).  Frames that failed
    or took too long are calls without a result.  Numbers that the document
    takes from the text report have its digits; without a block's confidence the
    readings' are given.  Every part is aggregated by video where it is read, and
    the parts meet on the video.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    seen = reading_totals(observations, ["video_id"])
    why = reason_counts(observations, ["video_id"])
    middle = exact_median(blocks, ["video_id"], "confidence").withColumnRenamed("median", "_mid")
    made = blocks.groupBy("video_id").agg(F.count("*").alias("blocks"), F.avg("confidence").alias("_mean"), _bin_counts("confidence", QUALITY_BINS).alias("_bins"))
    read = statuses.groupBy("video_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("failed", "timeout")])
    area = average_area(candidates, ["video_id"])
    gated = stats.select("video_id", "sampled", "with_text", "skipped_no_text", "skipped_same", F.col("calls").alias("_emitted"))
    out = seen
    for other in (why, made, middle, read, gated, area):
        out = out.join(other, "video_id", "left")
    calls = F.col("calls") + n("failed") + n("timeout")
    df = out.withColumns({"_calls": calls, "_ratio": F.col("accepted") / F.greatest(F.lit(1), calls), "mean": F.coalesce("mean", F.lit(0.0)), "median": F.coalesce("median", F.lit(0.0)), "_area": F.coalesce("avg_area", F.lit(0.0))})
    df = df.withColumns({"_p_ratio": as_printed("_ratio", 3), "_p_area": as_printed("_area", 1), "_p_mean": as_printed("mean", 3), "_p_mid": as_printed("median", 3)})
    none = F.array().cast("array<struct<reason: string, n: bigint>>")
    readings = F.struct(F.col("_ratio").alias("accepted_ratio"), F.col("_area").alias("average_text_bbox_area"), F.col("mean").alias("average_confidence"), F.col("median").alias("median_confidence"), F.col("bins").alias("confidence_histogram"), F.col("engines").alias("engine_counts"), F.col("calls").alias("observed"))
    return df.select(
        "video_id", n("sampled").alias("total_frames_sampled"), n("with_text").alias("frames_with_subtitles"), n("with_text").alias("white_text_frames"), n("skipped_no_text").alias("skipped_without_subtitles"),
        n("skipped_same").alias("skipped_same_subtitle"), n("skipped_same").alias("skipped_same_subtitle_frames"), n("_emitted").alias("actual_ocr_calls"), n("accepted").alias("successful_ocr_calls"),
        n("failed").alias("failed_ocr_calls"), n("timeout").alias("timeout_ocr_calls"), n("_calls").alias("total_ocr_results"), n("accepted").alias("accepted_ocr_results"), (n("_calls") - n("accepted")).alias("noise_rejected"),
        F.lit(profile).alias("quality_profile"), F.lit(detect_mode).alias("subtitle_detect_mode"), F.col("_p_area").alias("average_text_bbox_area"), F.col("_p_ratio").alias("accepted_ratio"),
        F.when(F.col("_ratio") < 0.3, F.lit("filter_too_aggressive")).otherwise(F.lit("")).alias("accepted_ratio_warning"), n("deep_attempted").alias("deep_analysis_attempted"),
        n("deep_recovered").alias("deep_analysis_recovered"), n("deep_rejected").alias("deep_analysis_rejected"), F.coalesce("rejection_reasons", none).alias("rejection_reasons"),
        F.coalesce("_mean", "_p_mean").alias("average_confidence"), F.coalesce("_mid", "_p_mid").alias("median_confidence"), F.coalesce("_bins", _no_bins(QUALITY_BINS)).alias("confidence_histogram"),
        F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x1", "x2", "y1", "y2"), crop, strict=True)]).alias("used_crop"), F.lit(auto_region).alias("auto_region_used"),
        n("blocks").alias("subtitle_blocks_generated"), F.lit(raw_srt).alias("raw_srt"), readings.alias("readings"),
    )


# fixed values: the text report's lines after its head (name, column, format), and its advice
REPORT_LINES = (
    ("quality_profile", "quality_profile", "%s"), ("subtitle_detect_mode", "subtitle_detect_mode", "%s"), ("sampled_frames_total", "total_frames_sampled", "%d"), ("ocr_frames", "actual_ocr_calls", "%d"),
    ("actual_ocr_calls", "total_ocr_results", "%d"), ("white_text_frames", "white_text_frames", "%d"), ("skipped_same_subtitle_frames", "skipped_same_subtitle_frames", "%d"),
    ("skipped_same_subtitle", "skipped_same_subtitle", "%d"), ("white_text_detected_frames", "white_text_frames", "%d"), ("skipped_without_subtitles", "skipped_without_subtitles", "%d"),
    ("average_text_bbox_area", "readings.average_text_bbox_area", "%.1f"), ("used_ocr_results", "accepted_ocr_results", "%d"), ("dropped_ocr_results", "noise_rejected", "%d"),
    ("empty_ocr_results", "empty_ocr_results", "%d"), ("successful_frames", "successful_ocr_calls", "%d"), ("timeout_frames", "timeout_ocr_calls", "%d"), ("failed_frames", "failed_ocr_calls", "%d"),
    ("total_ocr_results", "total_ocr_results", "%d"), ("accepted_ocr_results", "accepted_ocr_results", "%d"), ("noise_rejected", "noise_rejected", "%d"), ("accepted_ratio", "readings.accepted_ratio", "%.3f"),
    ("accepted_ratio_warning", "accepted_ratio_warning", "%s"), ("deep_analysis_attempted", "deep_analysis_attempted", "%d"), ("deep_analysis_recovered", "deep_analysis_recovered", "%d"),
    ("deep_analysis_rejected", "deep_analysis_rejected", "%d"), ("rejection_reasons", "rejection_reasons", "map"), ("average_ocr_confidence", "readings.average_confidence", "%.3f"),
    ("median_ocr_confidence", "readings.median_confidence", "%.3f"), ("confidence_histogram", "readings.confidence_histogram", "map"), ("engine_counts", "readings.engine_counts", "map"),
)
ADVICE = (
    "Pokud je titulků málo, zkuste --ocr-preset recall, širší crop nebo --subtitle-detect-mode white-text.",
    "Pokud je moc šumu, zkuste --subtitle-detect-mode hybrid, --ocr-preset balanced nebo strict a zkontrolujte temp/debug_detection.",
)


def report_text(report: DataFrame, observations: DataFrame, samples: int = 25) -> DataFrame:
    """video_id, value: the report as text, with the first rejected readings as they came.

    ``report`` is ``quality_report``'s; observations have time, frame_id, raw,
    emitted and rejection.  Blank readings are no samples; long ones are cut at
    300 characters.
    """
    dropped = inputs.samples(observations.where("not emitted"), samples)
    line = F.concat(F.lit("- ["), F.coalesce("rejection", F.lit("")), F.lit("] "), F.col("text"))
    noisy = dropped.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]).alias("noise"))
    df = report.withColumn("empty_ocr_results", F.col("readings.observed") - F.col("accepted_ocr_results")).join(noisy, "video_id", "left")

    def as_map(c: str) -> Column:
        # pairs of a name and a number
        entry = lambda e: F.concat(F.lit("'"), e[names[c][0]], F.lit("': "), e[names[c][1]].cast("string"))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.col(c), entry), ", "), F.lit("}"))

    names = {"rejection_reasons": ("reason", "n"), "readings.confidence_histogram": ("bin", "n"), "readings.engine_counts": ("engine", "n")}
    lines = [F.concat(F.lit(f"{name}: "), as_map(c) if fmt == "map" else F.format_string(fmt, F.col(c))) for name, c, fmt in REPORT_LINES]
    rule = F.lit("=" * 40)
    head = F.array(F.lit("OCR REPORT"), rule, *lines, F.lit(""), F.lit("TOP OCR NOISE SAMPLES"), rule)
    tail = F.array(F.lit(""), F.lit("RECOMMENDATION"), rule, *[F.lit(x) for x in ADVICE])
    noise = F.coalesce("noise", F.array().cast("array<string>"))
    return df.select("video_id", F.concat(F.array_join(F.concat(head, noise, tail), "\n"), F.lit("\n")).alias("value"))


def with_timing(texts: DataFrame, changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text reports with their timing section; ``changes`` has video_id, calls (K4)."""
    times = average_duration(blocks, ["video_id"])
    df = texts.join(changes.select("video_id", "calls"), "video_id", "left").join(times, "video_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    section = F.format_string(
        "\nTIMING\n" + "=" * 40 + "\nsubtitle_changes_or_ocr_crops: %d\nsubtitle_blocks: %d\naverage_subtitle_duration: %.3f\n", number("calls"), number("blocks"), F.coalesce("avg_duration", F.lit(0.0))
    )
    return df.select("video_id", F.concat("value", section).alias("value"))


def scan_report(reports: DataFrame, keys: dict[str, str], column: str = "value") -> DataFrame:
    """Adds the values of ``key: value`` lines, as int, double, string or map; missing ones are 0 or empty."""
    out = {}
    for key, kind in keys.items():
        head = f"(?m)^{key}:"
        if kind == "int":
            out[key] = F.coalesce(F.regexp_extract(column, head + r"\s*(\d+)", 1).try_cast("bigint"), F.lit(0))
        elif kind == "double":
            out[key] = F.coalesce(F.regexp_extract(column, head + r"[ \t]*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
        elif kind == "map":
            text = F.translate(F.regexp_extract(column, head + r"[ \t]*(\{.*\})", 1), "'", '"')
            out[key] = F.coalesce(F.from_json(text, "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
        else:
            out[key] = F.btrim(F.regexp_extract(column, head + r"[ \t]*([^\n]*)", 1))
    return reports.withColumns(out)
