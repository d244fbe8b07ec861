"""Folds that are cut where readings and frames are independent, against the plain fold of whole videos."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from subloom.operators import blocks as B
from subloom.operators import candidates as C

OBS = "video_id string, frame_id string, time double, end double, text string, score double, confidence double"
TEXTS = ["дом у реки", "дом у реки!", "лес", "лес стоит", "гора", "аб вг де", ""]


def readings(seed: int, n: int, videos: int = 3, step: float = 1.4) -> list[tuple]:
    draw, out = random.Random(seed), []
    for v in range(videos):
        t = 0.0
        for i in range(n):
            t += draw.choice([0.0, 0.25, step * draw.random(), step, 40.0 if draw.random() < 0.1 else 0.5])
            out.append((f"v{v}", f"{i:05d}", t, t + draw.choice([0.0, 0.5, 0.75, 3.0 * draw.random(), 90.0 if draw.random() < 0.01 else 0.2]), draw.choice(TEXTS), draw.random(), draw.random()))
    return out


def plain_blocks(spark, rows: list[tuple], max_gap: float = 1.2) -> list[tuple]:
    """The fold over each whole video."""
    ready = B.prepared(spark.createDataFrame(rows, OBS)).orderBy("video_id", "time", "frame_id").collect()
    out = []
    for v in sorted({r.video_id for r in ready}):
        own = [(r.time, r.end, r.text, r.key, r.score, r.confidence, r.suspicious) for r in ready if r.video_id == v]
        out += [(v, i, b["start"], b["end"], b["text"], b["score"], b["confidence"], b["readings"]) for i, b in enumerate(B.fold_blocks(own, max_gap, 0.86, 0.7), 1)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_islands_are_those_of_whole_videos(spark, seed):
    rows = readings(seed, 150)
    got = B.build_blocks(spark.createDataFrame(rows, OBS).repartition(5)).orderBy("video_id", "block_no").collect()
    assert [tuple(r) for r in got] == plain_blocks(spark, rows)


def test_one_long_video_is_cut(spark):
    """No island of a video of 200,000 readings holds more than its ten, and blocks are numbered through."""
    rows = spark.range(200_000).select(F.lit("v").alias("video_id"), F.format_string("%09d", "id").alias("frame_id"), (F.col("id") + F.floor(F.col("id") / 10) * 5.0).alias("time"), F.concat(F.lit("текст "), F.floor(F.col("id") / 5) % 2).alias("text"))
    rows = rows.select("video_id", "frame_id", "time", (F.col("time") + 0.9).alias("end"), "text", F.lit(1.0).alias("score"), F.lit(0.5).alias("confidence"))
    islands = B.gap_islands(rows, 1.2).groupBy("island").count()
    assert islands.agg(F.max("count"), F.count("*")).first()[:] == (10, 20_000)
    got = B.build_blocks(rows).agg(F.count("*"), F.max("block_no"), F.countDistinct("block_no"), F.sum("readings")).first()
    assert got[0] == got[1] == got[2] and got[3] == 200_000


def test_readings_without_time_and_empty_tables(spark):
    rows = [("v", "1", None, 1.0, "дом", 1.0, 0.5), ("v", "2", 2.0, 2.5, "дом", 1.0, 0.5)]
    assert B.build_blocks(spark.createDataFrame(rows, OBS)).count() == 1
    assert B.build_blocks(spark.createDataFrame([], OBS)).collect() == []


FRAME = "video_id string, frame_id string, time double, detected boolean, mask array<boolean>, small array<double>"


def frames(seed: int, n: int = 400) -> list[tuple]:
    draw, out = random.Random(seed), []
    for v in ("a", "b"):
        mask, small = [True] * 8, [0.0] * 4
        for i in range(n):
            if draw.random() < 0.3:
                mask = [draw.random() < 0.5 for _ in range(8)]
            if draw.random() < 0.3:
                small = [draw.random() * 20 for _ in range(4)]
            on = draw.random() > 0.2
            out.append((v, f"{i:04d}", i * draw.choice([3.0]) if seed else float(i), None if draw.random() < 0.02 else on, None if draw.random() < 0.05 else list(mask), list(small)))
    return out


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"hybrid": False}), (2, {"similarity": 0.4, "threshold": 3.0}), (3, {"hybrid": False, "detect_changes": True, "min_gap": 10.0})])
def test_gate_over_runs_is_the_gate_over_whole_videos(spark, seed, options):
    rows = frames(seed)
    want = []
    for v in ("a", "b"):
        gate, last = C.Gate(**options), None
        for _, frame, t, detected, mask, small in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            state, diff = gate.step(t, bool(detected), mask, small)
            if state == "same":
                last[3] = t + 0.75
            want.append([v, frame, t, t + 0.75, round(diff, 9), state])
            if state == "emit":
                last = want[-1]
    got = C.gate_frames(spark.createDataFrame(rows, FRAME).repartition(5), **options)
    assert sorted([r.video_id, r.frame_id, r.time, r.end_time, round(r.diff_score, 9), r.state] for r in got.collect()) == sorted(want)
    assert {r[5] for r in want} == {"emit", "no_text", "same"}


def test_neighbours_against_brute_force(spark):
    draw = random.Random(7)
    rows = [(v, f"{i:04d}", draw.choice([0.0, 0.5, 63.5, 64.0, 64.25, 128.0, round(200 * draw.random(), 2)])) for v in ("a", "b") for i in range(300)] + [("a", "9999", None), ("c", "0001", -3.0)]
    want = []
    for v, f, t in rows:
        if t is not None:
            near = sorted((abs(t - u), u, g) for w, g, u in rows if w == v and u is not None and abs(t - u) <= 1.0)[:5]
            want += [(v, f, g, round(d, 9), k) for k, (d, _, g) in enumerate(near, 1)]
    out = C.neighbours(spark.createDataFrame(rows, "video_id string, frame_id string, time double"))
    assert sorted((r.video_id, r.frame_id, r.neighbour_id, round(r.distance, 9), r["rank"]) for r in out.collect()) == sorted(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_very_many_frames_of_one_time(spark):
    rows = spark.range(100_000).select(F.lit("v").alias("video_id"), F.format_string("%06d", "id").alias("frame_id"), F.lit(5.0).alias("time"))
    out = C.neighbours(rows)
    assert out.count() == 500_000 and out.select("neighbour_id").distinct().count() == 5


def test_gate_bound_of_nearly_alike_masks_is_exact():
    """Masks alike by exactly three quarters of 0.4 are the same text while the last reading is near; 0.75 * 0.4 in doubles is over 0.3."""
    first, then = [True] * 5 + [False] * 5, [False] * 2 + [True] * 8
    gate = C.Gate(threshold=0.2, similarity=0.4)
    assert C.Gate.jaccard(first, then) == 0.3
    assert gate.step(0.0, True, first, [0.0])[0] == "emit"
    assert gate.step(1.0, True, then, [0.0])[0] == "same"
