"""Schemas of the engine's tables, and the defaults of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .functions.scripts import CYRILLIC, Script

VIDEOS = "video_id string, fps double, width int, height int, duration_s double"
CANDIDATES = (
    "video_id string, frame_id string, time double, end_time double, image_path string, changed boolean, diff_score double, has_subtitle boolean, white_text_detected boolean, "
    "text_component_count int, text_bbox_area double, text_bbox_y1 double, text_bbox_y2 double, mask_similarity double"
)
READINGS = "video_id string, frame_id string, time double, engine string, variant string, text string, confidence double"
OBSERVATIONS = "video_id string, frame_id string, time double, end double, text string, score double, confidence double, engine string"
BLOCKS = "video_id string, block_no int, start double, end double, text string, score double, confidence double"
CACHE = "source_text string, target_text string, engine string"


def normalize_observations(df: DataFrame, sample_rate: float, script: Script = CYRILLIC) -> DataFrame:
    """Observations with the defaults of a reading: end, score and confidence may be missing or null."""
    for name, kind in (("end", "double"), ("score", "double"), ("confidence", "double"), ("frame_id", "string"), ("engine", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select(
        "video_id",
        F.col("frame_id").cast("string").alias("frame_id"),
        F.col("time").cast("double").alias("time"),
        F.coalesce(F.col("end").cast("double"), F.col("time").cast("double") + sample_rate).alias("end"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), text.candidate_score(F.coalesce("text", F.lit("")), script=script)).alias("score"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        "engine",
    )
