"""Options of a run: presets, profiles and the modes derived from them. Frozen values; every rewrite returns a new one."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: cleaning presets (least script share, least script letters, merge similarity), in order of preference
PRESETS = {
    "strict": (0.35, 4, 0.72),
    "balanced": (0.25, 3, 0.68),
    "recall": (0.12, 2, 0.58),
    "maximum_recall": (0.08, 1, 0.54),
}
#: Order in which automatic selection tries them.
SEARCH_ORDER = ("maximum_recall", "recall", "balanced", "strict")
# fixed values: candidates a minute, least and most, by speed
BUDGETS = {"fast": (24, 300, 1600), "balanced": (34, 500, 2200)}
PREPROCESS_MODES = ("none", "grayscale", "contrast", "threshold", "adaptive", "denoise", "simple", "subtitle")


@dataclass(frozen=True)
class Crop:
    x1: float = 0.08
    x2: float = 0.92
    y1: float = 0.78
    y2: float = 0.93

    def __post_init__(self):
        if not (0 <= self.x1 < self.x2 <= 1 and 0 <= self.y1 < self.y2 <= 1):
            raise ValueError(f"a crop needs 0 <= start < end <= 1: {self}")


@dataclass(frozen=True)
class Options:
    """What a run does, with its defaults."""

    engine: str = "paddle"
    preset: str = "recall"
    preprocess: str = "auto"
    style: str = "auto"
    detect_mode: str = "hybrid"
    quality_profile: str = "default"
    speed: str = "balanced"
    deep: str = "none"
    sample_rate: float = 0.75
    detect_changes: bool = False
    change_threshold: float = 7.5
    min_gap: float = 2.0
    mask_similarity: float = 0.9
    crop: Crop | None = None
    min_ratio: float | None = None
    min_chars: int | None = None
    merge_similarity: float | None = None
    max_frames: int | None = None
    max_calls: int | None = None
    disable_paddle: bool = False
    translator: str = "none"
    full_range: bool = True

    def __post_init__(self):
        for name, known in (
            ("preset", {*PRESETS, "legacy_good"}),
            ("quality_profile", {"default", "legacy_good", "old_perfect"}),
            ("speed", {"fast", "balanced", "quality"}),
            ("deep", {"none", "short", "aggressive"}),
            ("detect_mode", {"diff", "white-text", "hybrid"}),
            ("preprocess", {"auto", *PREPROCESS_MODES}),
            ("translator", {"none", "auto", "ollama", "google"}),
        ):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {sorted(known)}")


def with_quality_profile(o: Options) -> Options:
    """A profile's fixed choices."""
    shared = {"engine": "paddle", "preset": "recall", "deep": "none", "speed": "quality", "sample_rate": 0.5, "detect_changes": False, "max_frames": None, "max_calls": None}
    if o.quality_profile == "old_perfect":
        return replace(o, **shared, detect_mode="white-text", preprocess="none", style="white", crop=Crop(0.02, 0.98, 0.55, 0.98))
    if o.quality_profile == "legacy_good":
        return replace(o, **shared, detect_mode="hybrid", preprocess="subtitle", crop=o.crop or Crop(0.03, 0.97, 0.68, 0.96))
    return o


def with_speed_profile(o: Options) -> Options:
    """What a speed allows (C4)."""
    if o.speed == "quality":
        return replace(o, deep="short") if o.quality_profile == "default" and o.deep == "none" else o
    o = replace(
        o,
        engine="paddle" if o.engine == "tesseract" and not o.disable_paddle else o.engine,
        preset="recall" if o.preset == "maximum_recall" else o.preset,
        preprocess="subtitle" if o.preprocess == "auto" else o.preprocess,
    )
    if o.speed == "fast":
        return replace(o, deep="none", detect_changes=True, detect_mode="white-text", sample_rate=max(o.sample_rate, 0.90))
    return replace(o, deep="short" if o.deep == "aggressive" else o.deep, sample_rate=max(o.sample_rate, 0.75))


def resolve(o: Options) -> Options:
    return with_speed_profile(with_quality_profile(o))


def preset_values(o: Options) -> tuple[float, int, float]:
    """Least share, least letters and merge similarity: the user's own go first."""
    share, chars, merge = PRESETS.get(o.preset, PRESETS["recall"])
    pick = lambda own, default: default if own is None else own
    return pick(o.min_ratio, share), pick(o.min_chars, chars), pick(o.merge_similarity, merge)


def sanity_mode(o: Options) -> str:
    return "off" if o.quality_profile == "old_perfect" or o.speed == "fast" else "ollama"


def noise_mode(o: Options) -> str:
    return {"old_perfect": "off", "legacy_good": "mild"}.get(o.quality_profile, "standard")


def searches_automatically(o: Options) -> bool:
    """Whether the preset is chosen by trial."""
    return o.quality_profile != "old_perfect" and o.crop is None and o.speed != "fast"


def model_url(explicit: str | None = None, environ: Mapping[str, str] = os.environ, in_container: bool = False) -> str:
    """Where a model server is asked: the given address, the environment's, the container's host, this machine."""
    host = "host.docker.internal" if in_container else "localhost"
    found = explicit or environ.get("OLLAMA_BASE_URL") or environ.get("OLLAMA_HOST") or f"http://{host}:11434"
    return (found if "://" in found else f"http://{found}").rstrip("/")


def needs_rerun(o: Options, duration_s: float, blocks: int) -> bool:
    """The guard against a poor yield."""
    return o.quality_profile == "default" and o.speed == "quality" and o.full_range and 50 * 60 <= duration_s <= 70 * 60 and blocks < 450


def call_limit(duration_s: Column, speed: str) -> Column:
    """Most candidates of a video of so many seconds; null for no limit (L3)."""
    if speed not in BUDGETS:
        return F.lit(None).cast("int")
    rate, least, most = BUDGETS[speed]
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(duration_s / 60 * rate))).cast("int")


def presets_table(spark: SparkSession) -> DataFrame:
    """preset, min_ratio, min_chars, merge_similarity, rank (order of trial): four rows."""
    rows = [(name, *PRESETS[name], rank) for rank, name in enumerate(SEARCH_ORDER)]
    return spark.createDataFrame(rows, "preset string, min_ratio double, min_chars int, merge_similarity double, rank int")
