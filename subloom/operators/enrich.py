"""Rewrites and enrichment of blocks: glossary, cached translation, conformance."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timecode
from ..functions.core import ladder
from ..functions.scripts import CYRILLIC, Script
from ..shared import written

# fixed values: terms whose case a glossary restores
TERMS = (
    "Krishna", "Radha", "Vishnu", "Shiva", "Mahadev", "Narayan", "Narayana", "Lakshmi", "Laxmi", "Brahma", "Saraswati", "Parvati", "Ganesha", "Ganesh", "Arjuna", "Yashoda", "Vrindavan",
    "Mathura", "Gokul", "Dwarka", "Kurukshetra", "dharma", "karma", "bhakti", "maya", "avatar", "asura", "deva", "mantra", "puja", "yajna", "prasad", "leela", "gopi", "gopika", "guru",
    "rishi", "muni", "shakti", "atma", "moksha", "samsara", "Vedas", "Upanishads", "Bhagavad Gita",
)
GLOSSARY = {term.lower(): term for term in TERMS}

Translator = Callable[[list[str]], list[str | None]]


def rewrite_terms(blocks: DataFrame, glossary: dict[str, str] | None = None, column: str = "text") -> DataFrame:
    """Whole words of the glossary, in order, whatever their case; adds ``original`` and ``terms`` that changed something."""
    df = blocks.withColumn("original", F.col(column)).withColumn("terms", F.array().cast("array<string>"))
    text, found = F.col(column), []
    for source, target in (GLOSSARY if glossary is None else glossary).items():
        new = F.regexp_replace(text, f"(?iU)\\b{re.escape(source)}\\b", target.replace("\\", "\\\\").replace("$", "\\$"))
        # a term changes the text where it occurs in another form; earlier terms don't touch it
        found.append(F.when(F.col("original").rlike(f"(?iU)\\b{re.escape(source)}\\b") & ~_only_as(F.col("original"), source, target), F.lit(f"glossary:{target}")))
        text = new
    if not found:
        return df
    return df.withColumns({"terms": F.array_compact(F.array(*found)), column: text})


def _only_as(text, source: str, target: str):
    """Whether every occurrence of a term is written as wanted already."""
    return F.regexp_count(text, F.lit(f"(?iU)\\b{re.escape(source)}\\b")) == F.regexp_count(text, F.lit(f"(?U)\\b{re.escape(target)}\\b"))


def corrections(rewritten: DataFrame) -> DataFrame:
    """The audit of changed blocks (K9)."""
    return rewritten.where(F.col("text") != F.col("original")).select(
        "video_id",
        F.col("block_no").alias("index"),
        timecode.srt_time(F.col("start")).alias("start"),
        timecode.srt_time(F.col("end")).alias("end"),
        "original",
        F.col("text").alias("corrected"),
        F.array_join("terms", ", ").alias("reason"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def first_that_answers(*translators: Translator) -> Translator:
    """A translator that asks the next one for what the ones before gave no answer to.

    One that raises counts as having answered nothing.
    """

    def run(texts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(texts)
        for ask in translators:
            open_ = [i for i, t in enumerate(out) if t is None]
            if not open_:
                break
            try:
                answers = list(ask([texts[i] for i in open_]))
            except Exception:  # noqa: BLE001  a model that can't be reached is one that doesn't answer
                continue
            for i, answer in zip(open_, answers, strict=True):
                out[i] = answer
        return out

    return run


def asked(texts: DataFrame, model: Translator, answer: str = "fresh") -> DataFrame:
    """source_text and ``answer``: a model's answers to distinct texts, null for a failure.

    Written, so that a model is asked once for each text however many results
    use its answers.  A batch that raises is a batch of failures.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            items = part["source_text"].tolist()
            try:
                done = list(model(items))
            except Exception:  # noqa: BLE001
                done = [None] * len(items)
            yield pd.DataFrame({"source_text": items, answer: done}, dtype="object")

    return written(texts.select("source_text").mapInPandas(run, f"source_text string, {answer} string"), "answers")


def translate(blocks: DataFrame, cache: DataFrame, translator: Translator | None = None, script: Script = CYRILLIC) -> tuple[DataFrame, DataFrame]:
    """Blocks with ``translated`` and ``status``, and the new cache rows.

    Distinct cleaned texts meet the cache once; only those it lacks go to
    ``translator`` (a batch function, null for a failure), once each.  Failures
    are never cached.  Without a translator, misses keep the cleaned text.
    """
    source = blocks.withColumn("source_text", T.clean_for_translation(F.col("text"), script))
    known = cache.groupBy("source_text").agg(F.max("target_text").alias("cached"))
    misses = source.select("source_text").where("source_text <> ''").distinct().join(known, "source_text", "left_anti")
    fresh = misses.select("source_text", F.lit(None).cast("string").alias("fresh")) if translator is None else asked(misses, translator)
    out = source.join(known, "source_text", "left").join(fresh, "source_text", "left")
    status = ladder(
        (F.col("source_text") == "", "empty"),
        (F.col("cached").isNotNull(), "cached"),
        (F.col("fresh").isNotNull(), "translated"),
        otherwise="copied" if translator is None else "failed",
    )
    target = F.when(F.col("source_text") == "", F.col("text")).otherwise(F.coalesce("cached", "fresh", "source_text"))
    return out.withColumns({"translated": target, "status": status}).drop("cached", "fresh"), fresh.where("fresh is not null").select("source_text", F.col("fresh").alias("target_text"))


def cleaned_by_model(blocks: DataFrame, model: Translator, script: Script = CYRILLIC, allow_drop: bool = False) -> DataFrame:
    """Texts tidied by rule, then by a model that sees each distinct one once; without an answer the rule's text stays."""
    tidy = blocks.withColumn("source_text", T.heuristic_cleanup(F.col("text"), allow_drop, script))
    answers = asked(tidy.select("source_text").where("source_text <> ''").distinct(), model, "answer")
    answer = T.normalize(F.coalesce("answer", F.lit("")))
    return tidy.join(answers, "source_text", "left").withColumn("text", F.when(answer != "", answer).otherwise(F.col("source_text"))).select(*blocks.columns)


def translation_summary(translated: DataFrame, requested: bool = True) -> DataFrame:
    """total, translated, failed, unique_misses, status of a translation, one row."""
    failed = F.count_if(F.col("status") == "failed")
    df = translated.agg(F.count("*").alias("total_blocks"), failed.alias("failed_blocks"), F.count_distinct(F.when(F.col("status").isin("translated", "failed", "copied"), F.col("source_text"))).alias("unique_misses"))
    status = ladder(
        (F.lit(not requested), "not_requested"),
        ((F.col("failed_blocks") > 0) & (F.col("failed_blocks") >= F.col("total_blocks")), "translation_failed"),
        (F.col("failed_blocks") > 0, "completed_with_errors"),
        otherwise="completed",
    )
    return df.select("total_blocks", F.greatest(F.lit(0), F.col("total_blocks") - F.col("failed_blocks")).alias("translated_blocks"), "failed_blocks", "unique_misses", status.alias("status"))


def translation_report(translated: DataFrame, engine: str, input_file: str, output_file: str, error: str | None = None) -> DataFrame:
    """The translation's report as one row: files, counts, engine, status and, where there is one, the error (K8)."""
    df = translation_summary(translated, engine != "none")
    status = F.when(F.lit(error is not None), F.lit("translation_failed")).otherwise(F.col("status"))
    return df.select(
        F.lit(input_file).alias("input_file"), F.lit(output_file).alias("output_file"), "total_blocks", "translated_blocks", "failed_blocks", F.lit(engine).alias("engine"), status.alias("status"), F.lit(error).cast("string").alias("error")
    )


def timing_conformance(a: DataFrame, b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """video_id, blocks, mismatches, conformant: same blocks at the same times."""
    left = a.select("video_id", "block_no", F.col("start").alias("s1"), F.col("end").alias("e1"))
    right = b.select("video_id", "block_no", F.col("start").alias("s2"), F.col("end").alias("e2"))
    off = (F.abs(F.col("s1") - F.col("s2")) > tolerance) | (F.abs(F.col("e1") - F.col("e2")) > tolerance)
    wrong = F.coalesce(off, F.lit(True))
    return left.join(right, ["video_id", "block_no"], "full_outer").groupBy("video_id").agg(F.count("*").alias("blocks"), F.count_if(wrong).alias("mismatches")).withColumn("conformant", F.col("mismatches") == 0)
