"""Jobs and their logs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode


def progress_events(logs: DataFrame) -> DataFrame:
    """Logs (job_id, seq, message) with the monotone progress after each line."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    df = logs.withColumn("_p", timecode.progress(F.col("message")))
    so_far = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.max("_p.percent").over(w), F.lit(0))))
    return df.withColumns({"percent": F.col("_p.percent"), "stage": F.last("_p.stage", ignorenulls=True).over(w), "progress": so_far}).drop("_p")


def without_repeats(logs: DataFrame, column: str = "message") -> DataFrame:
    """Lines that differ from the one before."""
    w = Window.partitionBy("job_id").orderBy("seq")
    return logs.withColumn("_b", F.lag(column).over(w)).where(~F.col("_b").eqNullSafe(F.col(column)) | F.col("_b").isNull()).drop("_b")


def last_n(logs: DataFrame, n: int = 1200) -> DataFrame:
    """The latest lines of each job."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return logs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def job_status(events: DataFrame, jobs: DataFrame, ocr_reports: DataFrame, translation_reports: DataFrame) -> DataFrame:
    """Jobs with their progress and report figures; absent reports give 0."""
    latest = events.groupBy("job_id").agg(F.max("progress").alias("progress"), F.max_by("stage", "seq").alias("stage"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = jobs.join(latest, "job_id", "left").join(ocr_reports, "job_id", "left").join(translation_reports, "job_id", "left")
    return out.select(*jobs.columns, zero("progress"), "stage", zero("actual_ocr_calls"), zero("subtitle_blocks_generated"), zero("translated_blocks"), "translation_status")


def batch_progress(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mean progress of all jobs, halves to even; 0 without jobs."""
    per = jobs.select("job_id").join(events.groupBy("job_id").agg(F.max("progress").alias("p")), "job_id", "left")
    return per.agg(F.coalesce(F.bround(F.avg(F.coalesce("p", F.lit(0))), 0), F.lit(0)).cast("int").alias("overall_progress"))


def estimated_end(frames: DataFrame, interval: int = 100) -> DataFrame:
    """Remaining time at every ``interval``-th and the last frame of a job (W10). Needs job_id, index, total, elapsed."""
    left = F.col("elapsed") / F.col("index") * (F.col("total") - F.col("index"))
    return frames.where((F.col("index") % interval == 0) | (F.col("index") == F.col("total"))).withColumn("eta", timecode.eta(left))
