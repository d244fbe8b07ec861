"""Which frames are read: gates, change detection and caps."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, pixels

DEDUP_OUT = "video_id string, frame_id string, time double, end_time double, diff_score double, mask_similarity double, state string"


def detect_changes(frames: DataFrame, threshold: float = 7.5, rate: float = 0.75, order: str = "time") -> DataFrame:
    """Frames that differ from the one before, and how long each lasts (W1 in diff mode, W2).

    Needs video_id, ``order`` and ``small`` (thumbnail).  As every frame becomes
    the next one's predecessor, this is an offset and a running count.  Thumbnails
    stay in the first window; the second has numbers only.
    """
    w = Window.partitionBy("video_id").orderBy(order)
    before = F.lag("small").over(w)
    diff = F.when(before.isNull(), F.lit(1.0)).otherwise(arrays.mean_difference(F.col("small"), before))
    # the first frame has no predecessor: its score is 1.0, and it always starts an island
    first = F.row_number().over(w) == 1
    scored = frames.withColumn("diff_score", diff).withColumn("changed", first | (F.col("diff_score") >= threshold)).drop("small")
    islands = scored.withColumn("island", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("video_id", "island").agg(
        F.min(order).alias("time"),
        (F.max(order) + rate).alias("end_time"),
        F.min_by("diff_score", order).alias("diff_score"),
        F.count("*").alias("frames"),
    )


def extraction_stats(frames: DataFrame, islands: DataFrame) -> DataFrame:
    """video_id, sampled, emitted, skipped_same."""
    a = frames.groupBy("video_id").agg(F.count("*").alias("sampled"))
    b = islands.groupBy("video_id").agg(F.count("*").alias("emitted"))
    return a.join(b, "video_id", "left").select("video_id", "sampled", F.coalesce("emitted", F.lit(0)).alias("emitted"), (F.col("sampled") - F.coalesce("emitted", F.lit(0))).alias("skipped_same"))


class Gate:
    """The state machine of white-text and hybrid mode; one frame at a time, in order of time."""

    def __init__(self, hybrid: bool = True, threshold: float = 7.5, similarity: float = 0.9, min_gap: float = 2.0, detect_changes: bool = False):
        self.diffing, self.threshold = hybrid or detect_changes, threshold
        self.similarity, self.min_gap = similarity, min_gap
        self.nearly = float(Decimal("0.75") * Decimal(repr(float(similarity))))  # 0.75 * 0.4 in doubles is over 0.3
        self.active, self.read_at, self.mask, self.small, self.has_image = False, None, None, None, False

    @staticmethod
    def jaccard(a, b) -> float:
        if a is None or b is None or len(a) != len(b):
            return 0.0
        either = np.logical_or(a, b).sum()
        return float(np.logical_and(a, b).sum() / either) if either else 1.0

    def step(self, t: float, detected: bool, mask, small) -> tuple[str, float]:
        """(state, difference): ``emit``, ``no_text`` or ``same``."""
        diff = 0.0
        if self.diffing:
            diff = 1.0 if self.small is None else float(np.abs(np.asarray(small, float) - np.asarray(self.small, float)).mean())
        if not detected:
            self.active, self.mask, self.small, self.has_image = False, None, None, False
            return "no_text", diff
        alike = self.jaccard(self.mask, mask)
        moved = self.active and diff >= self.threshold
        waited = self.read_at is None or t - self.read_at >= self.min_gap
        if self.active and not moved and (alike > self.similarity or (alike >= self.nearly and not waited and self.has_image)):
            return "same", diff
        self.active, self.read_at, self.mask, self.has_image = True, t, mask, True
        if self.diffing:
            self.small = small
        return "emit", diff


def text_runs(frames: DataFrame, cell: float = 600.0) -> DataFrame:
    """Adds ``run``: how many frames without text come before a frame; those of a run, and the one that ends it, share a number.

    The count is carried over cells of time: a partial aggregate for each cell, a
    window over a video's cells, and a window inside each cell, so that one long
    video is spread over all tasks.
    """
    df = frames.withColumn("_cell", F.floor(F.col("time") / cell))
    gone = (~F.coalesce(F.col("detected"), F.lit(False))).cast("long")
    before = Window.partitionBy("video_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy("video_id", "_cell").agg(F.sum(gone).alias("_n"))
    carried = cells.select("video_id", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("video_id", "_cell").orderBy("time", "frame_id").rowsBetween(Window.unboundedPreceding, -1)
    met = df.withColumn("_own", F.coalesce(F.sum(gone).over(own), F.lit(0))).join(carried, ["video_id", "_cell"])
    return met.withColumn("run", F.col("_before") + F.col("_own")).drop("_cell", "_before", "_own")


_GATED = pa.schema([("video_id", pa.string()), ("frame_id", pa.string()), ("time", pa.float64()), ("end_time", pa.float64()), ("diff_score", pa.float64()), ("mask_similarity", pa.float64()), ("state", pa.string())])


def _vectors(column: pa.Array, kind: type) -> Iterator[np.ndarray | None]:
    """The lists of a column as arrays; null items count as 0."""
    kinds = {bool: pa.bool_(), float: pa.float64()}
    ends, flat = column.offsets.to_numpy(), column.values.cast(kinds[kind]).fill_null(kind(0)).to_numpy(zero_copy_only=False)
    for i, there in enumerate(column.is_valid().to_pylist()):
        yield flat[ends[i] : ends[i + 1]] if there else None


def gate_frames(frames: DataFrame, rate: float = 0.75, **options) -> DataFrame:
    """Every frame with the gate's decision; emitted rows last until the last frame that repeats them.

    Needs video_id, frame_id, time, detected, mask, small.  The decision depends
    on the last *emitted* mask, which no window function can express, so frames
    are folded in order.  A frame without text clears all that the gate knows but
    the time of its last reading, which the next emitted frame overwrites before
    it is asked for; so runs of frames with text, each with the frame that ends
    it, are folded apart.  A task holds one emitted mask and nothing else.
    Frames without a time are left out.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gate, last = None, None, None

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _GATED.types, strict=True)], schema=_GATED)

        for batch in batches:
            out: list[list] = []
            plain = [batch.column(c).to_pylist() for c in ("video_id", "run", "frame_id", "time", "detected")]
            for video, run, frame, t, detected, mask, small in zip(*plain, _vectors(batch.column("mask"), bool), _vectors(batch.column("small"), float), strict=True):
                if (video, run) != at:
                    out += [last] if last else []
                    at, gate, last = (video, run), Gate(**options), None
                state, diff = gate.step(t, bool(detected), mask, small)
                row = [video, frame, t, t + rate, diff, 1.0 if state == "emit" else 0.0, state]
                if state == "emit":
                    out += [last] if last else []
                    last = row
                    continue
                if state == "same":
                    last[3] = t + rate
                out.append(row)
            if out:
                yield batch_of(out)
        if last:
            yield batch_of([last])

    ready = text_runs(frames.select("video_id", "frame_id", "time", "detected", "mask", "small").where("time is not null"))
    ready = ready.repartition("video_id", "run").sortWithinPartitions("video_id", "run", "time", "frame_id")
    return ready.mapInArrow(fold, DEDUP_OUT)


def gate_stats(gated: DataFrame) -> DataFrame:
    """video_id, sampled, with_text, skipped_no_text, skipped_same, calls."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    return gated.groupBy("video_id").agg(
        F.count("*").alias("sampled"), F.count_if(F.col("state") != "no_text").alias("with_text"), is_("no_text").alias("skipped_no_text"), is_("same").alias("skipped_same"), is_("emit").alias("calls")
    )


def sample_grid(videos: DataFrame, rate: float, start: float = 0.0, end: float | None = None) -> DataFrame:
    """video_id, index, time: instants from start to end, both included."""
    last = F.col("duration_s") if end is None else F.least(F.col("duration_s"), F.lit(float(end)))
    n = F.floor((last - start) / rate)
    return videos.where(last >= start).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("index")).withColumn("time", F.lit(float(start)) + F.col("index") * rate)


def common_region(candidates: DataFrame, limit: int = 200) -> DataFrame:
    """video_id, y1, y2 of the usual text band, from the first positive boxes (A12); videos with fewer than ten have none."""
    w = Window.partitionBy("video_id").orderBy("time")
    out = None
    for name in ("text_bbox_y1", "text_bbox_y2"):
        part = candidates.where(F.col(name) > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
        part = part.groupBy("video_id").agg(F.median(name).alias(name), F.count("*").alias("_n")).where("_n >= 10").drop("_n")
        out = part if out is None else out.join(part, "video_id")
    y1 = F.greatest(F.lit(0.55), F.least(F.lit(0.82), F.col("text_bbox_y1") - 0.06))
    return out.withColumn("y1", y1).select("video_id", "y1", F.greatest(F.col("y1") + 0.12, F.least(F.lit(0.99), F.col("text_bbox_y2") + 0.06)).alias("y2"))


def neighbours(frames: DataFrame, window: float = 1.0, limit: int = 5) -> DataFrame:
    """video_id, frame_id, neighbour_id, distance, rank: the nearest frames within a time window, itself included.

    Frames of one time have the same neighbours.  In order of time, with no more
    than ``limit`` frames of each time, the nearest ones of a time's first frame
    are at most ``2 * limit - 1`` rows away on either side, so a bounded frame of
    a window has them, and another hands them to the rest of that time.  A video
    is cut into cells of time; frames at an edge stand in the next cell too, so
    that one long video is spread over all tasks and nothing is joined.  Equal
    distances are ordered by time, then id.  Frames without a time have none.
    """
    width = 64.0 * window
    t, cell = F.col("time"), F.floor(F.col("time") / width)
    copies = F.array(cell, F.when(t - cell * width <= window, cell - 1), F.when((cell + 1) * width - t <= window, cell + 1))
    df = frames.select("video_id", "frame_id", t.cast("double").alias("time")).where("time is not null")
    df = df.select("*", cell.alias("_home"), F.explode(F.array_compact(copies)).alias("_cell"))
    of_time = Window.partitionBy("video_id", "_cell", "time").orderBy("frame_id")
    df = df.withColumn("_n", F.row_number().over(of_time)).withColumn("_more", F.col("_n") > limit)
    around = Window.partitionBy("video_id", "_cell", "_more").orderBy("time", "frame_id").rowsBetween(-(2 * limit - 1), 2 * limit - 1)
    distance = lambda x: F.abs(x["time"] - F.col("time"))
    near = F.transform(F.collect_list(F.struct("time", "frame_id")).over(around), lambda x: F.struct(distance(x).alias("distance"), x["time"].alias("u"), x["frame_id"].alias("neighbour_id")))
    near = F.slice(F.array_sort(F.filter(near, lambda x: x["distance"] <= window)), 1, limit)
    df = df.withColumn("_near", F.when(F.col("_n") == 1, near))
    df = df.withColumn("_near", F.first("_near", ignorenulls=True).over(of_time)).where(F.col("_cell") == F.col("_home"))
    each = df.select("video_id", "frame_id", F.posexplode("_near").alias("_at", "_x"))
    return each.select("video_id", "frame_id", "_x.neighbour_id", "_x.distance", (F.col("_at") + 1).alias("rank"))


def is_candidate(frames: DataFrame) -> Column:
    """Whether a frame is to be read: it has a text and that changed.

    Where frames don't have ``has_subtitle`` or ``changed``, that part holds for
    all; a null ``has_subtitle`` is none, a null ``changed`` is a change.
    """
    text = F.coalesce("has_subtitle", F.lit(False)) if "has_subtitle" in frames.columns else F.lit(True)
    return text & (F.coalesce("changed", F.lit(True)) if "changed" in frames.columns else F.lit(True))


def signature(frames: DataFrame) -> DataFrame:
    """video_id, n, first_time, last_time, digest of the candidates among the frames, in any order.

    The digest is a sum of the rows' hashes, so it is combined where rows are
    read, whatever a video's size.  A row is its times to the millisecond (without
    an end, its time is), its frame and its text box to four digits (0 where it
    has none), so other crops of the same times don't share it.
    """
    scaled = lambda c, by: F.round(c * by).cast("bigint").cast("string")
    box = [scaled(F.coalesce(c, F.lit(0.0)) if c in frames.columns else F.lit(0.0), 10000) for c in ("text_bbox_y1", "text_bbox_y2")]
    row = F.md5(F.concat_ws("|", scaled(F.col("time"), 1000), scaled(F.coalesce("end_time", "time"), 1000), F.col("frame_id"), *box))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    df = frames.where(is_candidate(frames)).groupBy("video_id")
    return df.agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.sha1(F.sum(number).cast("string")).alias("digest"))


def with_text(images: DataFrame, legacy: bool = False) -> DataFrame:
    """Frames with what their crops' pixels tell: ``detected``, ``mask`` and ``small`` for the gate, ``boxes``, ``n_components``, ``bright``, ``text_box`` and ``crop``.

    Needs pixels, width and height, which go.  Pixels become components in one
    pass of a kernel; which of them are letters and whether they are a subtitle
    is told by expressions.  ``text_box`` is there wherever letters are, ``crop``
    only where text was detected.  What is no image has no text and nulls.
    """
    width, height = F.col("width"), F.col("height")
    df = images.withColumn("_of", pixels.text_of(F.col("pixels"), width, height, legacy)).drop("pixels")
    df = df.withColumn("_kept", arrays.kept_components(F.col("_of.components"), width, height, legacy))
    bright = F.col("_of.bright")
    found = F.coalesce(arrays.is_subtitle(F.col("_kept"), width, height, bright, bright, legacy), F.lit(False))
    df = df.withColumn("detected", found).withColumn("text_box", F.when(F.size("_kept") > 0, arrays.envelope(F.col("_kept"))))
    box = [F.col(f"text_box.{k}") for k in ("x1", "y1", "x2", "y2")]
    df = df.withColumn("crop", F.when(F.col("detected"), arrays.padded_crop(*box, width, height)))
    keep = [F.col(f"`{c}`") for c in images.columns if c not in ("pixels", "width", "height", "detected", "mask", "small", "boxes", "n_components", "bright", "text_box", "crop")]
    parts = [F.col("_of.mask").alias("mask"), F.col("_of.small").alias("small"), F.col("_kept").alias("boxes"), F.size("_of.components").alias("n_components"), bright.alias("bright")]
    return df.select(*keep, "detected", *parts, "text_box", "crop")


def decode(files: DataFrame, decoder) -> DataFrame:
    """Rows of an injected decoder over a ``binaryFile`` scan: path, content -> dicts of the given schema.

    ``decoder`` has ``schema`` (DDL) and ``rows(path, content)``; a file that
    can't be decoded gives a row with its error, so nothing is lost silently.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                try:
                    out += [{"path": r.path, "error": None, **row} for row in decoder.rows(r.path, r.content)]
                except Exception as e:  # noqa: BLE001  any decoder's failure becomes data
                    out.append({"path": r.path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=["path", "error", *names])

    names = [c.split()[0] for c in decoder.schema.split(", ")]
    return files.select("path", "content").mapInPandas(run, f"path string, error string, {decoder.schema}")
