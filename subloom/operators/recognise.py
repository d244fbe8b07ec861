"""Recognition with injected engines: one row per engine and variant, failures as rows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from queue import Empty, Queue

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PREPROCESS_MODES
from ..functions import pixels
from ..functions import text as T
from ..functions.core import ladder
from ..functions.scripts import CYRILLIC, Script
from ..shared import written
from . import quality
from .blocks import deep_vote
from .candidates import neighbours
from .enrich import Translator, asked

Recogniser = Callable[[bytes], tuple[str, float]]
SPATIAL = ("crop", "crop_up", "crop_down")


def call_with_timeout(call: Callable[[], object], seconds: float) -> tuple[str, object]:
    """(ok | timeout | failed, result or error); a call that hangs is left behind in a daemon thread."""
    answer: Queue = Queue(1)

    def work() -> None:
        try:
            answer.put(("ok", call()))
        except Exception as e:  # noqa: BLE001
            answer.put(("failed", f"{type(e).__name__}: {e}"))

    threading.Thread(target=work, daemon=True).start()
    try:
        return answer.get(timeout=seconds)
    except Empty:
        return "timeout", None


def read(images: DataFrame, engines: dict[str, Callable[[], Recogniser]], seconds: float = 30.0) -> DataFrame:
    """video_id, frame_id, time, variant, engine, text, confidence, status.

    ``engines`` maps a name to a factory; a factory runs once in each Python
    worker, where its model stays loaded.  A frame's failure is its own row and
    doesn't touch other frames.
    """
    schema = "video_id string, frame_id string, time double, variant string, engine string, text string, confidence double, status string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {name: make() for name, make in engines.items()}
        for part in parts:
            rows = []
            for r in part.itertuples():
                for name, engine in loaded.items():
                    if r.content is None:
                        rows.append((r.video_id, r.frame_id, r.time, r.variant, name, "", 0.0, "missing"))
                        continue
                    status, got = call_with_timeout(lambda e=engine, c=r.content: e(bytes(c)), seconds)
                    text, confidence = got if status == "ok" else ("", 0.0)
                    rows.append((r.video_id, r.frame_id, r.time, r.variant, name, text, float(confidence), status))
            yield pd.DataFrame(rows, columns=["video_id", "frame_id", "time", "variant", "engine", "text", "confidence", "status"])

    if "variant" not in images.columns:
        images = images.withColumn("variant", F.lit("crop:none"))
    return images.select("video_id", "frame_id", "time", "variant", "content").mapInPandas(run, schema)


def read_with_fallback(images: DataFrame, engine: dict[str, Callable[[], Recogniser]], fallback: dict[str, Callable[[], Recogniser]], seconds: float = 30.0) -> DataFrame:
    """Readings of one engine; what it failed on is read by another, what took too long is not.

    Readings are written, so that no image is read twice by the same engine.
    """
    first = written(read(images, engine, seconds), "readings")
    failed = first.where("status = 'failed'").select("video_id", "frame_id", "variant").distinct()
    keys = ["video_id", "frame_id"] + ["variant"] * ("variant" in images.columns)
    again = read(images.join(failed.select(*keys).distinct(), keys, "left_semi"), fallback, seconds)
    return first.unionByName(written(again, "readings"))


def last_chance(images: DataFrame, chosen: DataFrame, engine: dict[str, Callable[[], Recogniser]], preset: str = "recall", script: Script = CYRILLIC, seconds: float = 30.0) -> DataFrame:
    """``chosen`` with frames that came out without a text read once more, by another engine.

    The new reading passes the cleaner and the choice like any other; where it
    fails too, the first verdict stays.
    """
    keys = ["video_id", "frame_id", "time"]
    empty = chosen.where("text = ''").select(*keys)
    readings = written(read(images.join(empty, keys, "left_semi"), engine, seconds), "readings").where("status = 'ok'")
    better = quality.choose_best(quality.clean(readings, preset, script), keys, tuple(engine), script).where("accepted")
    kept = chosen.join(better.select(*keys), keys, "left_anti")
    return kept.unionByName(better.select(*chosen.columns))


def deep_retry(
    images: DataFrame,
    wanted: DataFrame,
    engine: dict[str, Callable[[], Recogniser]],
    transform: Callable[[bytes, str], bytes] = pixels.portable_variant,
    preset: str = "recall",
    mode: str = "auto",
    script: Script = CYRILLIC,
    window: float = 1.0,
    limit: int = 5,
    votes: int = 24,
    seconds: float = 8.0,
) -> DataFrame:
    """video_id, frame_id, text, confidence, outcome of the ``wanted`` frames, read again with more effort (U4).

    The nearest frames in time, themselves included, are read in every variant;
    readings that the cleaner accepts and that aren't noise, or are known short
    texts, vote, the first ``votes`` by nearness and variant.  A frame's variants
    are read once, however many frames ask for them.
    """
    near = neighbours(images.select("video_id", "frame_id", "time"), window, limit).join(wanted.select("video_id", "frame_id").distinct(), ["video_id", "frame_id"], "left_semi")
    near = written(near, "deep-neighbours")
    shots = images.join(near.select("video_id", F.col("neighbour_id").alias("frame_id")).distinct(), ["video_id", "frame_id"], "left_semi")
    each = variants(shots, mode)
    ranks = each.sparkSession.createDataFrame(list(enumerate(variant_names(mode))), "variant_rank int, variant string")
    readings = written(read(transform_images(each, transform), engine, seconds), "deep-readings").where("status = 'ok'")
    cleaned = quality.noise(quality.clean(readings, preset, script), "cleaned", "standard", script).select("video_id", "frame_id", "variant", "cleaned", "confidence", "reason", "noise")
    cleaned = written(cleaned, "deep-cleaned")  # a filter on reasons would be pushed to the scan and clean each text once more for each use
    fit = cleaned.where((F.col("reason") == "accepted") & (~F.col("noise.suspicious") | F.col("noise.is_valid_short"))).join(F.broadcast(ranks), "variant")  # a row for each variant
    fit = fit.select("video_id", F.col("frame_id").alias("neighbour_id"), "variant_rank", F.col("cleaned").alias("text"), "confidence")
    cast = near.select("video_id", "frame_id", "neighbour_id", F.col("rank").alias("neighbour_rank")).join(fit, ["video_id", "neighbour_id"])
    voted = deep_vote(cast, script, votes)
    none = {"text": "", "confidence": 0.0, "outcome": "deep_no_text"}  # every frame has an outcome, those without a fit reading too
    asked_for = wanted.select("video_id", "frame_id").distinct().join(voted, ["video_id", "frame_id"], "left")
    return asked_for.select("video_id", "frame_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])


def recovered(chosen: DataFrame, retried: DataFrame, noise_mode: str = "standard", script: Script = CYRILLIC) -> DataFrame:
    """``chosen`` with what the retry gave, and ``deep``: recovered, rejected, kept, or null for frames not retried.

    A text that was recovered takes the frame's place; one that was not takes
    away a suspicious text, but for known short ones, which are kept like texts
    that aren't suspicious.
    """
    again = retried.select("video_id", "frame_id", F.col("text").alias("_text"), F.col("confidence").alias("_confidence"), "outcome")
    tried, found = F.col("outcome").isNotNull(), F.coalesce(F.col("_text") != "", F.lit(False))
    met = chosen.join(again, ["video_id", "frame_id"], "left").withColumn("_doubt", F.when(tried & ~found, F.col("text")))
    df = quality.noise(met, "_doubt", noise_mode, script)  # other texts aren't looked at
    lost = tried & ~found & F.col("noise.suspicious") & ~F.col("noise.is_valid_short")
    return df.withColumns(
        {
            "text": F.when(found, F.col("_text")).when(lost, F.lit("")).otherwise(F.col("text")),
            "confidence": F.when(found, F.greatest("confidence", "_confidence")).otherwise(F.col("confidence")),
            "reason": F.when(found | lost, F.col("outcome")).otherwise(F.col("reason")),
            "accepted": F.col("accepted") & ~lost,
            "deep": F.when(found, F.lit("recovered")).when(lost, F.lit("rejected")).when(tried, F.lit("kept")),
        }
    ).select(*chosen.columns, "deep")


Engines = dict[str, Callable[[], Recogniser]]


def read_loop(
    images: DataFrame,
    engine: Engines,
    fallback: Engines | None = None,
    late: Engines | None = None,
    deep: Engines | None = None,
    deep_mode: str = "none",
    transform: Callable[[bytes, str], bytes] = lambda content, variant: content,
    preset: str = "recall",
    noise_mode: str = "standard",
    sanity: str = "local",
    model: Translator | None = None,
    script: Script = CYRILLIC,
    window: float = 1.0,
    preprocess: str = "subtitle",
    seconds: float = 30.0,
) -> DataFrame:
    """Frames to observations, the whole way: read, choose, read again, judge, last chance.

    Needs video_id, frame_id, time and content; with ``deep_mode='by frame'`` a
    column deep_mode too.  Adds engine, text, confidence, score, raw, emitted,
    rejection, route and deep.  A frame takes one route and each engine sees it
    once:

    - a frame on which an engine takes too long, or that no engine could read,
      is no observation; what ``engine`` fails on ``fallback`` reads;
    - ``deep``: texts that ask for more effort are read again in variants by
      ``deep``, and stay as that leaves them;
    - ``sanity``: other suspicious texts of more than twenty letters stay by rule,
      or by ``model``'s word where the rule denies it, with spacing repaired;
    - ``noise``: other suspicious texts go;
    - ``late``: frames left without a text are read by an engine not yet asked,
      and the choice among all their readings is final.

    Readings and each branch's answers are written once; a branch runs on its own
    rows only.
    """
    keys = ["video_id", "frame_id", "time"]
    order = tuple(dict.fromkeys(["tesseract", *engine, *(fallback or {}), *(late or {})]))
    plain = images.select(*keys, "content")
    readings = read_with_fallback(plain, engine, fallback, seconds) if fallback else written(read(plain, engine, seconds), "readings")
    slow = readings.where("status = 'timeout'").select(*keys).distinct()
    fit = readings.where("status = 'ok'").join(slow, keys, "left_anti")
    chosen = written(quality.choose_best(quality.clean(fit, preset, script), keys, order, script), "chosen")
    if deep is not None and deep_mode != "none":
        asked_for = chosen
        mode: str | object = deep_mode
        if deep_mode == "by frame":
            asked_for, mode = chosen.join(images.select(*keys, "deep_mode"), keys), F.col("deep_mode")
        wanted = written(asked_for.where((F.col("text") != "") & T.needs_deep_retry(F.col("text"), mode, script)).select("video_id", "frame_id"), "wanted")
        chosen = recovered(chosen, deep_retry(plain, wanted, deep, transform, preset, preprocess, script, window), noise_mode, script)
    else:
        chosen = chosen.withColumn("deep", F.lit(None).cast("string"))
    seen = quality.observations(chosen.withColumn("_chosen", F.col("text")), noise_mode, script, sanity)
    if model is not None and sanity != "off":
        seen = written(seen, "judged")
        doubt = (F.col("route") == "sanity") & ~F.col("emitted")
        told = sanity_by_model(seen.where(doubt).withColumn("text", F.col("_chosen")), model, script)
        told = told.withColumns({"text": F.when(F.col("sane.valid"), F.col("sane.repaired")).otherwise(F.lit("")), "emitted": F.col("sane.valid"), "rejection": F.when(~F.col("sane.valid"), F.col("sane.reason"))})
        seen = seen.where(~doubt).unionByName(told.select(*seen.columns))
    seen = seen.drop("_chosen")
    if late is not None:
        seen = written(seen, "judged")
        lost = seen.where("not emitted")
        asked_before = readings.where(F.col("engine").isin(*late)).select(*keys).distinct()
        more = written(read(plain.join(lost.select(*keys), keys, "left_semi").join(asked_before, keys, "left_anti"), late, seconds), "readings").where("status = 'ok'")
        both = more.unionByName(fit.join(more.select(*keys).distinct(), keys, "left_semi"))
        again = quality.choose_best(quality.clean(both, preset, script), keys, order, script)
        again = again.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("accepted", "engine", "text", "confidence", "score", "reason", "raw")])
        df = lost.join(again, keys, "left")
        read_late = F.col("_accepted").isNotNull()
        new = {c: F.when(read_late, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("accepted", "engine", "text", "confidence", "score", "reason", "raw")}
        new |= {"emitted": F.coalesce("_accepted", F.lit(False)), "rejection": F.when(F.coalesce("_accepted", F.lit(False)), F.lit(None)).when(read_late, F.col("_reason")).otherwise(F.col("rejection")), "route": F.when(read_late, F.lit("late")).otherwise(F.col("route"))}
        seen = seen.where("emitted").unionByName(df.withColumns(new).select(*seen.columns))
    return seen.withColumn("score", F.when(F.col("emitted"), T.candidate_score(F.col("text"), F.col("confidence"), script)).otherwise(F.lit(0.0)))


def sanity_by_model(suspicious: DataFrame, model: Translator, script: Script = CYRILLIC) -> DataFrame:
    """Adds ``sane`` (valid, repaired, reason): by rule where that suffices, else by a model's word (P10, U8).

    The model sees each distinct repaired text once, and only those that the
    rules leave in doubt; it answers VALID or NOISE, anything else is no answer.
    """
    df = suspicious.withColumn("_s", T.language_sanity(F.col("text"), script)).withColumn("source_text", F.col("_s.repaired"))
    answers = asked(df.where("not _s.valid").select("source_text").distinct(), model, "answer")
    word = F.upper(F.trim(F.coalesce("answer", F.lit(""))))
    valid = F.col("_s.valid") | word.startswith("VALID")
    reason = ladder((F.col("_s.valid"), F.col("_s.reason")), (word.startswith("VALID"), "ollama_language_sanity"), (word.startswith("NOISE"), "ollama_language_noise"), otherwise=F.col("_s.reason"))
    out = df.join(answers, "source_text", "left").withColumn("sane", F.struct(valid.alias("valid"), F.col("_s.repaired").alias("repaired"), reason.alias("reason")))
    return out.select(*suspicious.columns, "sane")


def model_answers(listed: object, model: str) -> tuple[bool, bool]:
    """From a server's list of models: whether it can be asked, and whether it has the model, by full or short name.

    None means that it could not be reached; a server that doesn't list the
    model is asked all the same.
    """
    if listed is None:
        return False, False
    entries = listed.get("models", []) if isinstance(listed, dict) else []
    names = {str(e.get("name", "")) for e in entries if isinstance(e, dict)}
    return True, model in names or model.split(":")[0] in {n.split(":")[0] for n in names}


def variant_names(mode: str = "subtitle") -> list[str]:
    """Spatial and preprocessing variants, in the order in which they vote."""
    modes = ["subtitle", "grayscale", "adaptive", "contrast", "threshold", "denoise", "simple"]
    if mode in PREPROCESS_MODES and mode not in modes:
        modes.insert(0, mode)
    return [f"{s}:{m}" for s in SPATIAL for m in [*modes, "invert"]]


def variants(frames: DataFrame, mode: str = "subtitle") -> DataFrame:
    """A row for each spatial and preprocessing variant, with its rank."""
    each = F.array(*[F.struct(F.lit(i).alias("variant_rank"), F.lit(n).alias("variant")) for i, n in enumerate(variant_names(mode))])
    return frames.select("*", F.explode(each).alias("_v")).select(*frames.columns, "_v.*")


def transform_images(images: DataFrame, transform: Callable[[bytes, str], bytes] = pixels.portable_variant) -> DataFrame:
    """Images of each variant.

    Portable graymaps and pixmaps are transformed by the library's kernels; a
    transform of compressed images is injected, as it must decode them first.
    """

    @F.pandas_udf("binary")
    def run(content: pd.Series, variant: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else transform(bytes(c), v) for c, v in zip(content, variant, strict=True)])

    return images.withColumn("content", run("content", "variant"))
