"""Sources and sinks other than subtitle files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Crop, Options, noise_mode, sanity_mode
from ..functions.text import normalize
from ..schema import CACHE


def videos(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content, modificationTime of media files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def frames_in(frames: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Frames of a time range; the range reaches the scan."""
    if start is not None and end is not None and end <= start:
        raise ValueError("the end comes after the start")
    if start is not None:
        frames = frames.where(F.col("time") >= float(start))
    return frames if end is None else frames.where(F.col("time") <= float(end))


def urls(spark: SparkSession, path: str | None, single: str = "") -> DataFrame:
    """url: one for each line that isn't blank; without any, the single one; without that, an error."""
    trimmed = F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("url")
    given = spark.createDataFrame([(single,)], "value string").select(trimmed).where("url <> ''")
    lines = spark.read.text(path).select(trimmed).where("url <> ''") if path else given.limit(0)
    if not lines.isEmpty():
        return lines
    if given.isEmpty():
        raise ValueError("no url")
    return given


def translation_cache(spark: SparkSession, path: str) -> DataFrame:
    """source_text, target_text, engine of a cache folder; empty where there is none."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def log_rows(logs: DataFrame, path: str) -> None:
    """Append log lines (job_id, seq, message) to the logs' table, a folder for each job."""
    logs.write.mode("append").partitionBy("job_id").parquet(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; unreadable ones give nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def cached_observations(cache: DataFrame, wanted: DataFrame, metadata: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits: cached rows whose digest and metadata equal the wanted ones; misses: wanted runs without.

    Both are hash joins on the digest and metadata; null metadata equals null.
    """
    same = cache["digest"] == wanted["digest"]
    for c in metadata:
        same = same & cache[c].eqNullSafe(wanted[c])
    return cache.join(wanted, same, "left_semi"), wanted.join(cache, same, "left_anti")


def with_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``digest``: 16 hex digits over the columns."""
    return df.withColumn("digest", F.substring(F.sha1(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in sorted(columns)]))), 1, 16))


#: Goes up when readings are made otherwise, so that older caches no longer hit.
OBSERVATIONS_VERSION = 5


def observation_key(runs: DataFrame, o: Options, version: int = OBSERVATIONS_VERSION) -> DataFrame:
    """Adds what a run's readings depend on: twenty named fields, ``digest`` over them and the candidates' signature, and ``cache_key``.

    Needs input_hash (a file's SHA-1; null where there is no file), start_time and
    end_time of the range, and the signature's n, first_time, last_time and
    candidate_digest.  Times count to the millisecond.
    """
    crop = o.crop or Crop()
    named = {
        "version": version, "quality_profile": o.quality_profile, "sample_rate": o.sample_rate, "crop": f"{crop.x1} {crop.x2} {crop.y1} {crop.y2}", "engine": o.engine, "preset": o.preset, "preprocess": o.preprocess,
        "detect_mode": o.detect_mode, "speed": o.speed, "deep": o.deep, "sanity": sanity_mode(o), "noise": noise_mode(o), "max_frames": o.max_frames, "max_calls": o.max_calls, "min_gap": o.min_gap,
        "mask_similarity": o.mask_similarity, "detect_changes": o.detect_changes,
    }
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    times = {f"{c.removesuffix('_time')}_ms": ms(c) for c in ("start_time", "end_time", "first_time", "last_time")}
    fixed = {name: F.lit(None if value is None else str(value)).cast("string") for name, value in named.items()}
    df = with_digest(runs.withColumns(fixed | times), [*named, *times, "input_hash", "n", "candidate_digest"])
    video = F.coalesce(F.nullif(F.substring("input_hash", 1, 16), F.lit("")), F.lit("no_video_hash"))
    return df.withColumn("cache_key", F.concat(video, F.lit("_"), "digest"))


def settings_key(files: DataFrame, o: Options) -> DataFrame:
    """Adds ``settings_digest``: the file as it is (path, length, modificationTime in seconds) and the options that a choice of region depends on."""
    crop = o.crop or Crop()
    named = {"_speed": o.speed, "_preset": o.preset, "_rate": o.sample_rate, "_detect": o.detect_mode, "_crop": f"{crop.x1} {crop.x2} {crop.y1} {crop.y2}"}
    at = F.floor(F.unix_micros(F.col("modificationTime").cast("timestamp")) / 1000000)
    identity = F.concat_ws(":", "path", F.col("length").cast("string"), at.cast("string"))
    df = files.withColumns({"_identity": identity} | {name: F.lit(str(value)) for name, value in named.items()})
    return with_digest(df, ["_identity", *named]).select(*files.columns, F.col("digest").alias("settings_digest"))


def file_digests(files: DataFrame) -> DataFrame:
    """path, sha1 of whole files."""
    return files.select("path", F.sha1("content").alias("sha1"))


def write_json(df: DataFrame, path: str) -> None:
    """Reports and audits."""
    df.write.mode("overwrite").json(path)


def write_cache(df: DataFrame, path: str, by: str = "digest") -> None:
    """Keyed caches; each key is a folder that a later read can skip to."""
    df.write.mode("append").partitionBy(by).parquet(path)


def samples(observations: DataFrame, n: int = 100) -> DataFrame:
    """video_id, emitted, k, rejection, text: each video's first accepted texts, and its first rejected readings as they came.

    At most ``n`` of each; rejected readings are cut at 300 characters, and blank
    ones are none.
    """
    w = Window.partitionBy("video_id", "emitted").orderBy("time", "frame_id")
    own = F.when(F.col("emitted"), F.col("text")).otherwise(F.col("raw"))
    there = F.when(F.col("emitted"), F.col("text") != "").otherwise(F.col("raw").rlike(r"(?U)[^\s\x1c-\x1f]"))  # a rejected reading is tidied once it is known to be a sample
    df = observations.where(there).select("video_id", "time", "frame_id", "emitted", "rejection", own.alias("text"))
    first = df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    shown = F.when(F.col("emitted"), F.col("text")).otherwise(F.substring(normalize(F.col("text")), 1, 300))
    return first.select("video_id", "emitted", "k", "rejection", shown.alias("text"))


def samples_text(listed: DataFrame) -> DataFrame:
    """video_id, value: the samples as the text of a file (K5)."""
    line = F.concat(F.col("k").cast("string"), F.lit(". "), F.when(F.col("emitted"), F.lit("")).otherwise(F.concat(F.lit("["), F.coalesce("rejection", F.lit("")), F.lit("] "))), F.col("text"))
    part = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("k", line.alias("line"))))), lambda x: x["line"])  # noqa: E731  at most n lines
    both = listed.groupBy("video_id").agg(part(F.col("emitted")).alias("_a"), part(~F.col("emitted")).alias("_d"))
    rule = F.lit("=" * 40)
    lines = F.concat(F.array(F.lit("ACCEPTED OCR SAMPLES"), rule), "_a", F.array(F.lit(""), F.lit("DROPPED OCR SAMPLES"), rule), "_d")
    return both.select("video_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def engine_comparison(readings: DataFrame, engines: list[str], n: int = 100) -> DataFrame:
    """One row a frame with every engine's text, the first ``n`` frames (K6)."""
    wide = readings.groupBy("video_id", "frame_id", "time").pivot("engine", engines).agg(F.first("text"))
    return wide.orderBy("video_id", "time", "frame_id").limit(n)


def allowed(df: DataFrame, names: list[str], column: str = "filename") -> DataFrame:
    """Rows of an allow-list."""
    return df.where(F.col(column).isin(names))
