"""Times as text and back, and progress of jobs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import ladder


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds cut off, never negative.

    Seconds become whole microseconds first, so that 1.234 has 234 milliseconds.
    """
    micros = F.bround(F.greatest(seconds, F.lit(0.0)) * 1_000_000, 0).cast("long")
    ms = F.floor(micros / 1000)
    part = lambda unit, size: F.floor(ms / unit) % size if size else F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of rounded seconds."""
    s = F.greatest(F.bround(seconds, 0).cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def eta(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.greatest(F.bround(seconds, 0).cast("long"), F.lit(0))
    return F.when(s >= 3600, clock(seconds)).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def parse_clock(text: Column) -> Column:
    """Seconds of HH:MM:SS; null for blanks, an error for anything else."""
    t = F.trim(text)
    n = lambda i: F.regexp_extract(t, r"^(\d{2}):(\d{2}):(\d{2})$", i).cast("int")
    good = t.rlike(r"^\d{2}:[0-5]\d:[0-5]\d$")
    return ladder((t.isNull() | (t == ""), F.lit(None).cast("double")), (good, (n(1) * 3600 + n(2) * 60 + n(3)).cast("double")), otherwise=F.raise_error(F.concat(F.lit("not HH:MM:SS: "), t)).cast("double"))


def parse_area(text: Column) -> Column:
    """Fraction of ``bottom:<percent>``, percent in (0, 80]."""
    percent = F.regexp_extract(text, r"^bottom:([0-9.]+)$", 1).try_cast("double")
    return F.when((percent > 0) & (percent <= 80), percent / 100.0).otherwise(F.raise_error(F.concat(F.lit("no subtitle area: "), text)).cast("double"))


# fixed values: what log lines say, and the progress they stand for
READING, TRANSLATING, MAKING = "Čtu ruské titulky z obrazu...", "Překládám do češtiny...", "Vytvářím hotové video..."


def progress(message: Column) -> Column:
    """struct(percent, stage) that a log line stands for; null percent for no change."""
    has = lambda *parts: _any([F.contains(message, F.lit(p)) for p in parts])
    frame, part = r"OCR frame\s+(\d+)/(\d+)", r"Překlad průběh:\s+(\d+)/(\d+)"
    step = lambda pattern, base, span: (F.lit(base) + F.bround(_ratio(message, pattern) * span, 0)).cast("int")
    steps = [
        (has("Zkouším", "yt-dlp"), F.lit(12), "Stahuji video..."),
        (has("Video uloženo"), F.lit(30), "Video staženo."),
        (has("Video:", "Spouštím OCR", "OCR crop"), F.lit(35), READING),
        (message.rlike(frame), step(frame, 30, 35), READING),
        (has("Po OCR") | (has("SRT uloženo") & has("subtitles_original_raw")), F.lit(65), TRANSLATING),
        (has("Překládám", "Google fallback", "Ollama"), F.lit(68), TRANSLATING),
        (message.rlike(part), step(part, 65, 20), TRANSLATING),
        (has("subtitles_cs.srt"), F.lit(85), MAKING),
        (has("Vypaluji"), F.lit(88), "Vkládám titulky do videa..."),
        (has("Hotové video"), F.lit(100), "Hotovo."),
    ]
    return F.struct(
        ladder(*[(c, p) for c, p, _ in steps], otherwise=F.lit(None).cast("int")).alias("percent"),
        ladder(*[(c, s) for c, _, s in steps], otherwise=F.lit(None).cast("string")).alias("stage"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _ratio(message: Column, pattern: str) -> Column:
    n = lambda i: F.regexp_extract(message, pattern, i).try_cast("double")
    return n(1) / F.greatest(F.lit(1.0), n(2))


def error_message(error: Column) -> Column:
    """What a person is told of an error."""
    head = "translation_failed:"
    return ladder(
        (error.startswith(head), F.concat(F.lit("Překlad selhal: "), F.trim(F.substring(error, F.lit(len(head) + 1), F.lit(1 << 20))))),
        (F.contains(error, F.lit("Stažení videa selhalo")), "Video se nepodařilo stáhnout. Zkontrolujte odkaz nebo zkuste jiné video."),
        (F.coalesce(error, F.lit("")) == "", "Úlohu se nepodařilo dokončit."),
        otherwise=error,
    )
