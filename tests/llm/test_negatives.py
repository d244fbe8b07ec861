"""Hard negatives against plain sorting of all scores."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from subloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed: int = 1, n: int = 260, dims: int = 9) -> list[tuple]:
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(10)]
    out = []
    for i in range(n):
        label = draw.randrange(10)
        out.append((i, [float(np.float32((c + draw.gauss(0, 0.7)) / 4)) for c in centres[label]], label))
    return out


AWKWARD = [(300, None, 1), (350, [1.0, None] * 4, 2), (400, [float("nan")] * 9, 3), (450, [float("inf")] * 9, 3), (500, [0.5] * 9, None), (None, [0.5] * 9, 3), (550, [], 4), (600, [0.25, 0.5], 4), (50, [0.3] * 9, 5), (50, [0.3] * 9, 5), (14, [0.1] * 9, 9)]


def brute(table: list[tuple]) -> Counter:
    kept = []
    for i, v, label in table:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = Counter()
    for at, (a, va, la) in enumerate(kept):
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(va, vb, strict=False)), b, lb) for k, (b, vb, lb) in enumerate(kept) if k != at]
        positives = sorted((s for s in scored if s[2] == la), key=lambda s: (-s[0], s[1]))[:5]
        for ps, p, _ in positives:
            fit = sorted((s for s in scored if s[2] != la and 50 * ps <= 100 * s[0] <= 95 * ps), key=lambda s: (-s[0], s[1]))[:3]
            out.update((a, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(fit, 1))
    return out


def table(spark, some):
    return spark.createDataFrame(some, SCHEMA).repartition(3)


def got(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "panel", "stripe", "sent"), [(4_096, 1_024, 32, 8 << 20), (50, 4, 3, 0)])
def test_against_brute_force(spark, monkeypatch, block, panel, stripe, sent):
    for name, value in (("ROWS", block), ("PANEL", panel), ("STRIPE", stripe), ("SENT", sent)):
        monkeypatch.setattr(negatives, name, value)
    some = rows() + AWKWARD
    want = brute(some)
    assert got(negatives.mined(table(spark, some))) == want and len(want) > 50


def test_copies_of_one_row(spark, monkeypatch):
    """A third of all rows is one row: each copy is an anchor, and each other copy its positive."""
    monkeypatch.setattr(negatives, "ROWS", 16)
    some = rows(2, 60) + [(100, [0.5] * 9, 3)] * 30 + [(101, [0.4] * 9, 4)] * 8
    assert got(negatives.mined(table(spark, some))) == brute(some)


@pytest.mark.parametrize("chunks", [1, 3, 20])
def test_chunks_of_dimensions_add_up(spark, chunks):
    some = rows(3, 120)
    data = table(spark, some).select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), negatives.integers(F.col("embedding")).alias("v"))
    assert got(negatives.hard_negatives(data, F.col("vec_id") % 50 == 0, chunks=chunks)) == brute(some)


def test_scores_are_not_written(spark, monkeypatch):
    """A thousand anchors: what is written grows with rows and with the best, not with all scores."""
    some = [(50 * i, v, label) for i, v, label in rows(7, 1000)]
    written, write = {}, negatives.materialise

    def noted(df, name, **how):
        out = write(df, name, **how)
        written[name] = sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(negatives, "materialise", noted)
    assert got(negatives.mined(table(spark, some))) == brute(some)
    assert written and sum(written.values()) < 1_000_000


@pytest.mark.parametrize("most", [2**11, 2**24, 2**30])
def test_scores_of_any_size(spark, most):
    """Sums that single and double floats hold, and those that neither does."""
    draw = random.Random(most)
    table_ = [(i, draw.randrange(3), [draw.randrange(-most // 9, most) for _ in range(3)]) for i in range(120)]
    data = spark.createDataFrame(table_, "vec_id long, label int, v array<long>").repartition(3)
    want = Counter()
    for a, la, va in table_[::5]:
        scored = [(-sum(x * y for x, y in zip(va, vb, strict=True)), b, lb) for b, lb, vb in table_ if b != a]
        for ps, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            fit = sorted(x for x in scored if x[2] != la and -50 * ps <= -100 * x[0] <= -95 * ps)[:3]
            want.update((a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(fit, 1))
    assert got(negatives.hard_negatives(data, F.col("vec_id") % 5 == 0)) == want and len(want) > 100


def test_large_numbers_are_exact():
    draw = np.random.default_rng(4)
    a, b = draw.integers(-(2**28), 2**28, (5, 7)), draw.integers(-(2**28), 2**28, (6, 7))
    assert (negatives.product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])).all()


@pytest.mark.parametrize("score", [-7, 0, 1, 19, 20, 21, 4_000_001])
def test_windows_are_whole_numbers(score):
    lo, hi = negatives.bounds(score, (50, 95))
    around = range(-30, 60) if abs(score) < 100 else range(score // 2 - 5, score + 5)
    assert [x for x in around if 50 * score <= 100 * x <= 95 * score] == [x for x in around if lo <= x <= hi]


def test_clashing_columns_and_empty_tables(spark):
    some = rows(6, 120)
    clashing = table(spark, some)
    for name in ("v", "panel", "stripe", "block", "a", "place", "kind", "anchor"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    assert got(negatives.mined(clashing)) == brute(some)
    empty = negatives.mined(table(spark, []))
    assert empty.collect() == [] and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mined(table(spark, [(1, [0.5], 1), (2, [0.5], 2)])).collect() == []
