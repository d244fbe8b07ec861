"""Masks, thumbnails and boxes as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mask(values: Column, threshold: float = 0.0) -> Column:
    """Boolean mask of the values over a threshold."""
    return F.transform(values, lambda x: x > threshold)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common true places; 1 for two empty masks, 0 for a null mask or unlike sizes (F32)."""
    both = _total(F.zip_with(a, b, lambda x, y: (x & y).cast("double")))
    either = _total(F.zip_with(a, b, lambda x, y: (x | y).cast("double")))
    known = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(~F.coalesce(known, F.lit(False)), F.lit(0.0)).when(either == 0, F.lit(1.0)).otherwise(both / either)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two thumbnails."""
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.size(a)


def envelope(boxes: Column) -> Column:
    """struct(x1, y1, x2, y2, area, n) of components (x, y, w, h, area): the area is what they fill, not their boxes' (A22)."""
    of = lambda f: F.transform(boxes, f)
    return F.struct(
        F.array_min(of(lambda b: b["x"])).alias("x1"),
        F.array_min(of(lambda b: b["y"])).alias("y1"),
        F.array_max(of(lambda b: b["x"] + b["w"])).alias("x2"),
        F.array_max(of(lambda b: b["y"] + b["h"])).alias("y2"),
        _total(of(lambda b: b["area"].cast("double"))).alias("area"),
        F.size(boxes).alias("n"),
    )


def kept_components(components: Column, width: Column, height: Column, legacy: bool = False) -> Column:
    """Components (x, y, w, h, area) that can be letters (F34, second step)."""

    def fits(c: Column) -> Column:
        box = F.greatest(F.lit(1), c["w"] * c["h"])
        density = c["area"] / box
        return (
            c["h"].between(10, 80)
            & (c["w"] >= 18)
            & (c["area"] >= 35)
            & (c["area"] <= width * height * 0.18)
            & density.between(0.06, 0.82)
            & (c["w"] / F.greatest(F.lit(1), c["h"]) >= 0.35)
            & ~((c["w"] > width * 0.92) & (c["h"] > height * 0.45))
            & (c["y"] + c["h"] / 2 >= height * (0.33 if legacy else 0.50))
        )

    return F.filter(components, fits)


def is_subtitle(components: Column, width: Column, height: Column, raw_share: Column, bright_share: Column, legacy: bool = False) -> Column:
    """Whether kept components form a subtitle (F34, last step)."""

    def decide(e: Column) -> Column:
        w, h = e["x2"] - e["x1"], e["y2"] - e["y1"]
        tests = [
            raw_share <= (0.42 if legacy else 0.32),
            (e["n"] >= 2) | (e["area"] >= 220),
            w >= F.greatest(F.lit(50.0), width * 0.12),
            ((e["x1"] + e["x2"]) / 2).between(width * 0.18, width * 0.82),
            (e["y1"] + e["y2"]) / 2 >= height * (0.38 if legacy else 0.50),
            (bright_share <= 0.24) | ((e["n"] >= 3) & (raw_share <= 0.32)),
        ]
        if not legacy:
            tests += [(h >= 10) & (h <= F.least(F.lit(80.0), height * 0.70)), (h <= 45) | ((e["n"] >= 7) & (w >= width * 0.50))]
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    return (F.size(components) > 0) & F.coalesce(let(envelope(components), decide), F.lit(False))


def padded_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Text box with a margin, within the image."""
    px, py = F.greatest(F.lit(12), F.floor(width * 0.025)), F.greatest(F.lit(8), F.floor(height * 0.06))
    return F.struct(
        F.greatest(F.lit(0), x1 - px).cast("int").alias("x1"),
        F.greatest(F.lit(0), y1 - py).cast("int").alias("y1"),
        F.least(width, x2 + px).cast("int").alias("x2"),
        F.least(height, y2 + py).cast("int").alias("y2"),
    )


def first_non_empty(*arrays: Column) -> Column:
    """The first array with items."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def reading(texts: Column, scores: Column) -> Column:
    """struct(text, confidence) of a recogniser's result arrays."""
    text = F.array_join(F.filter(F.transform(texts, F.trim), lambda x: x != ""), " ")
    mean = F.when(F.size(scores) > 0, _total(F.transform(scores, lambda s: s.cast("double"))) / F.size(scores)).otherwise(F.lit(0.0))
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def word_reading(words: Column) -> Column:
    """struct(text, confidence) of recognised words (text, conf in percent, negative for none)."""
    text = F.array_join(F.filter(F.transform(words, lambda w: F.trim(w["text"])), lambda x: x != ""), " ")
    conf = F.filter(F.transform(words, lambda w: w["conf"].cast("double")), lambda c: c >= 0)
    return F.struct(text.alias("text"), F.when(F.size(conf) > 0, _total(F.transform(conf, lambda c: c / 100.0)) / F.size(conf)).otherwise(F.lit(0.0)).alias("confidence"))
