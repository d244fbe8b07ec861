"""Late rows of a stream, kept and counted instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def route_late(stream: DataFrame, folder: str, checkpoint: str, delay: float, ts: str = "ts") -> StreamingQuery:
    """Writes what a stream holds now to ``folder``, every row with ``late`` and ``behind``; it can be run again for what came since.

    A row is late if its time isn't after the latest time of all earlier batches
    less ``delay`` seconds, a watermark's rule; ``behind`` says by how many
    seconds, and is null for rows on time.  Rows without a time are on time.  So
    late and other rows together are the input.  A batch is written under its
    own number, with the latest time so far beside it: one that is run again
    after a failure takes its own place, and finds the same earlier time.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("latest timestamp").parquet(f"{folder}/marks/{n - 1}") if n else None
        latest = before.first().latest if before is not None else None
        mark = F.lit(latest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay))
        behind = (F.unix_micros(mark) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
        rows = batch.withColumn("behind", F.when(behind >= 0, behind)).withColumn("late", F.col("behind").isNotNull())
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={n}")
        there = spark.read.schema(rows.schema).parquet(f"{folder}/rows/batch={n}")
        there.agg(F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(latest).cast("timestamp")).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/{n}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def routed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All routed rows with batch, late and behind; a filter on ``late`` or ``batch`` reads those folders only. ``schema`` is the stream's."""
    return spark.read.schema(f"{schema}, behind double, batch long, late boolean").parquet(f"{folder}/rows")


def late_counts(rows: DataFrame) -> DataFrame:
    """batch, readings, late, worst: how many rows came, how many of them late, and the furthest behind in seconds."""
    return rows.groupBy("batch").agg(F.count("*").alias("readings"), F.count_if("late").alias("late"), F.max("behind").alias("worst"))
