"""The driver's tables as readings, frames and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan of fewer partitions than there are cores, dealt to all: rules on whole texts cost far more than moving them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def seconds(ts) -> F.Column:
    """Seconds of a timestamp without zone, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user is a video, the event type its text."""
    e = table(spark, sf_dir, "events")
    t = seconds(F.col("ts"))
    return e.select(
        F.col("user_id").cast("string").alias("video_id"),
        F.format_string("%012d", "event_id").alias("frame_id"),
        "event_id",
        "user_id",
        "ts",
        t.alias("time"),
        (t + 600.0).alias("end"),
        F.col("event_type").alias("text"),
        F.lit(0.0).alias("score"),
        (F.col("value") / 500.0).alias("confidence"),
    )


def document_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as readings: two neighbouring documents are one frame's two engines."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select(
        F.col("source").alias("video_id"),
        F.floor(F.col("doc_id") / 2).alias("frame_id"),
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.lit("tesseract")).otherwise(F.lit("paddle")).alias("engine"),
        F.coalesce("text", F.lit("")).alias("text"),
        ((F.col("doc_id") % 101) / 100.0).alias("confidence"),
    )


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as blocks: a turn lasts two and a half seconds."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 2.5
    return c.select(
        F.col("conv_id").cast("string").alias("video_id"),
        (F.col("turn") + 1).cast("int").alias("block_no"),
        start.cast("double").alias("start"),
        (start + 2.25).cast("double").alias("end"),
        F.coalesce("text", F.lit("")).alias("text"),
        "role",
        F.lit(0.0).alias("score"),
        F.lit(0.5).alias("confidence"),
    )


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: a label is a video, its vectors are thumbnails in order of id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("video_id"), "vec_id", F.col("vec_id").cast("double").alias("time"), F.col("embedding").alias("small"))
