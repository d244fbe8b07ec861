"""From readings to observations: clean, choose, reject with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRESETS
from ..functions import text as T
from ..functions.core import ladder, let
from ..functions.scripts import CYRILLIC, Script


def clean(df: DataFrame, preset: str = "recall", script: Script = CYRILLIC, min_ratio: float | None = None, min_chars: int | None = None) -> DataFrame:
    """Adds ``cleaned`` and ``reason``."""
    share, chars, _ = PRESETS.get(preset, PRESETS["recall"])
    out = T.clean_with_reason(F.coalesce("text", F.lit("")), preset, share if min_ratio is None else min_ratio, chars if min_chars is None else min_chars, script)
    return df.withColumn("_c", out).withColumns({"cleaned": F.col("_c.cleaned"), "reason": F.col("_c.reason")}).drop("_c")


def noise(df: DataFrame, column: str = "cleaned", mode: str = "standard", script: Script = CYRILLIC) -> DataFrame:
    """Adds ``noise`` (struct of suspicious, reasons, meaningful_chars, is_valid_short) by the mode's rules."""
    text = F.col(column)
    found = {"standard": T.noise_reasons, "mild": T.mild_noise_reasons}.get(mode)
    why = found(text, script) if found else F.array().cast("array<string>")
    df = df.withColumn("_n", why)
    return df.withColumn(
        "noise",
        F.struct(
            (F.size("_n") > 0).alias("suspicious"),
            F.col("_n").alias("reasons"),
            F.char_length(T.meaningful(text)).alias("meaningful_chars"),
            T.is_valid_short(text, script).alias("is_valid_short"),
        ),
    ).drop("_n")


def choose_best(readings: DataFrame, keys: list[str], engine_order: tuple[str, ...] = ("tesseract", "paddle"), script: Script = CYRILLIC) -> DataFrame:
    """Of each key's cleaned readings the accepted one of the highest score; earlier engines win ties.

    Groups where nothing is accepted keep an empty text and every engine's reason;
    ``raw`` is a reading as it came, of the last engine that read anything.  One
    partial aggregation: a key's readings never meet in one task before it.
    """
    rank = ladder(*[(F.col("engine") == e, F.lit(i)) for i, e in enumerate(engine_order)], otherwise=F.lit(len(engine_order)))
    scored = readings.withColumn("_score", F.round(T.candidate_score(F.col("cleaned"), F.col("confidence"), script), 9)).withColumn("_rank", rank)
    score, rank = F.col("_score"), F.col("_rank")
    ok = F.col("reason") == "accepted"
    order = F.struct(score.alias("score"), (-rank).alias("first"))
    picked = F.struct(F.col("engine"), F.col("cleaned").alias("text"), F.col("confidence"), score.alias("score"))
    why = F.struct(rank.alias("rank"), F.concat(F.col("engine"), F.lit(":"), F.col("reason")).alias("why"))
    read = F.max_by("text", F.when(F.coalesce(F.col("text"), F.lit("")) != "", rank))
    out = scored.groupBy(*keys).agg(F.max_by(picked, F.when(ok, order)).alias("_p"), F.max(ok).alias("accepted"), F.array_sort(F.collect_set(why)).alias("_w"), read.alias("_raw"))
    joined = F.array_join(F.transform("_w", lambda w: w["why"]), "; ")
    return out.select(
        *keys,
        "accepted",
        F.when(F.col("accepted"), F.col("_p.engine")).alias("engine"),
        F.coalesce(F.when(F.col("accepted"), F.col("_p.text")), F.lit("")).alias("text"),
        F.coalesce(F.when(F.col("accepted"), F.col("_p.confidence")), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.when(F.col("accepted"), F.col("_p.score")), F.lit(0.0)).alias("score"),
        F.when(F.col("accepted"), F.lit("accepted")).otherwise(joined).alias("reason"),
        F.coalesce("_raw", F.lit("")).alias("raw"),
    )


def verdict(text: Column, noise_mode: str = "standard", script: Script = CYRILLIC, sanity: str = "local") -> Column:
    """struct(route, text, rejection): what becomes of a chosen text, computed once.

    Routes: ``clean`` stays; ``sanity`` is a suspicious text of more than twenty
    letters that language sanity decides on, with its repaired text or its reason;
    ``noise`` is a suspicious text that goes.  Known short texts are clean.
    """
    out = lambda route, t, why: F.struct(F.lit(route).alias("route"), t.alias("text"), why.cast("string").alias("rejection"))

    def decide(f: Column) -> Column:
        bad = F.lit(False) if noise_mode == "off" else (F.size(f["reasons"]) > 0) & ~f["short"]
        why = F.concat(F.lit("noise_filter:"), F.array_join(f["reasons"], ","))
        judged = let(T.language_sanity(f["raw"], script), lambda s: F.when(s["valid"], out("sanity", s["repaired"], F.lit(None))).otherwise(out("sanity", F.lit(""), s["reason"])))
        asked = (f["own"] > 20) & F.lit(sanity != "off")
        return F.when(~bad, out("clean", f["raw"], F.lit(None))).when(asked, judged).otherwise(out("noise", F.lit(""), why))

    def features(t: Column) -> Column:
        if noise_mode == "mild":
            return F.struct(t.alias("raw"), T.count_script(t, script).alias("own"), T.is_valid_short(t, script).alias("short"), T.mild_noise_reasons(t, script).alias("reasons"))
        return let(T.noise_features(t, script), lambda f: F.struct(t.alias("raw"), f["own"].alias("own"), f["short"].alias("short"), f["reasons"].alias("reasons")))

    return let(text, lambda t: let(features(t), decide))


def observations(chosen: DataFrame, noise_mode: str = "standard", script: Script = CYRILLIC, sanity: str = "local") -> DataFrame:
    """Adds ``emitted``, ``rejection`` and ``route``; the text is what is emitted, empty where nothing is.

    Frames that were read again (``deep`` is there and not null) have been judged
    already: they stay as the retry left them.
    """
    judged = F.col("accepted") & (F.col("text") != "")
    retried = F.col("deep").isNotNull() if "deep" in chosen.columns else F.lit(False)
    df = chosen.withColumn("_v", F.when(judged & ~retried, verdict(F.col("text"), noise_mode, script, sanity)))
    text = F.when(judged & retried, F.col("text")).otherwise(F.coalesce("_v.text", F.lit("")))
    why = F.when(text == "", F.coalesce("_v.rejection", "reason"))
    route = F.when(retried, F.lit("deep")).otherwise(F.coalesce("_v.route", F.lit("none")))
    return df.select(*[c for c in chosen.columns if c != "text"], text.alias("text"), (text != "").alias("emitted"), why.alias("rejection"), route.alias("route"))


def rejection_counts(df: DataFrame, column: str = "rejection") -> DataFrame:
    """reason, n: reasons parted at commas; blank ones count as ``empty``, null ones not at all.

    Whole ones are counted first, so that a reason is made once a row: a filter
    on it would be pushed to the scan and make it there again.
    """
    whole = df.groupBy(F.col(column).alias("_whole")).agg(F.count("*").alias("_n"))
    part = whole.select(F.explode(F.split("_whole", ",")).alias("reason"), "_n")
    return part.select(F.when(F.trim("reason") == "", F.lit("empty")).otherwise(F.trim("reason")).alias("reason"), "_n").groupBy("reason").agg(F.sum("_n").alias("n"))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: Column | int) -> DataFrame:
    """The first rows of each key; a null ``n`` keeps all (L1-L5). Spark cuts groups before the shuffle where ``n`` is a number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= limit) if isinstance(n, int) else limit.isNull() | (F.col("_r") <= limit)).drop("_r")
