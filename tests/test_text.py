"""Text rules on hand-made Cyrillic strings; expected values follow from the rules' thresholds."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from subloom.config import PRESETS
from subloom.functions import text as T
from subloom.functions import timecode
from subloom.functions.scripts import LATIN
from subloom.functions.similarity import ratio, similarity


def column(spark, texts, expression, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_normalize_and_merge_key(spark):
    odd = ["  a\t\n b ", "a  b", "a\x1cb", "", "Привет,  МИР!", "x_y²-ẞ"]
    assert column(spark, odd, T.normalize) == [" ".join(t.split()) for t in odd]
    assert column(spark, odd, T.merge_key) == [re.sub(r"[\W_]+", "", " ".join(t.split()).lower()) for t in odd]


def test_counts(spark):
    texts = ["Привет, мир! ok 12", "", "___", "ЁЖ ё"]
    assert column(spark, texts, T.count_script) == [9, 0, 0, 3]
    assert column(spark, texts, T.count_letters) == [sum(c.isalpha() for c in t) for t in texts]
    assert column(spark, texts, T.count_symbols) == [sum(not c.isalnum() and not c.isspace() for c in t) for t in texts]
    assert column(spark, texts, T.count_foreign) == [2, 0, 0, 0]
    assert column(spark, texts, lambda t: F.size(T.words(t))) == [2, 0, 0, 2]


@pytest.mark.parametrize("preset", PRESETS)
def test_valid_short_is_always_accepted(spark, preset):
    share, chars, _ = PRESETS[preset]
    got = column(spark, ["Да", "нет!", "Стой..."], lambda t: T.clean_with_reason(t, preset, share, chars))
    assert [(r.cleaned, r.reason) for r in got] == [("Да", "accepted"), ("нет", "accepted"), ("Стой", "accepted")]


def test_cleaner_ladder(spark):
    clean = lambda preset: lambda t: T.clean_with_reason(t, preset, *PRESETS.get(preset, PRESETS["recall"])[:2])
    texts = ["Перевод: X", "мы пришли домой вечером", "hello world again", "", "раз два три\nстой здесь сейчас", "ЛЛ: мы идем домой", "%%% ... !!! ###"]
    recall = [(r.cleaned, r.reason) for r in column(spark, texts, clean("recall"))]
    assert recall[0] == ("", "empty_after_cleanup")
    assert recall[1] == ("мы пришли домой вечером", "accepted")
    assert recall[2] == ("", "empty_after_cleanup")
    assert recall[3] == ("", "empty_after_cleanup")
    assert recall[4] == ("раз два три стой здесь сейчас", "accepted")
    assert recall[5] == ("мы идем домой", "accepted")
    assert recall[6] == ("", "empty_after_cleanup")
    legacy = column(spark, ["Перевод: X привет друзья мои хорошие", "да", "12"], clean("legacy_good"))
    assert [r.reason for r in legacy] == ["credit_or_technical_text", "accepted", "empty_after_cleanup"]
    long = "дорога домой была совсем короткой и очень светлой " * 4
    assert column(spark, [long], clean("strict"))[0].reason in ("too_long_strict", "empty_after_cleanup")
    assert column(spark, [long], clean("recall"))[0].reason == "accepted"


def test_gibberish(spark):
    strict = lambda t: T.looks_like_gibberish(F.split(t, " "), False)
    relaxed = lambda t: T.looks_like_gibberish(F.split(t, " "), True)
    texts = ["мы не знаем что это", "абв где", "ПРИВЕТ ДРУЗЬЯ МОИ", "бвгд жзкл мнпр"]
    assert column(spark, texts, strict) == [False, True, True, True]
    assert column(spark, texts, relaxed) == [False, False, True, True]


def test_trim_noise_words(spark):
    texts = ["б г дом к", "я дом я", "а б в г дом", "б", "дом б г д лес"]
    assert column(spark, texts, lambda t: F.array_join(T.trim_noise_words(F.split(t, " ")), " ")) == ["дом", "я дом я", "дом", "б", "дом лес"]


def test_noise_reasons(spark):
    texts = ["Привет друзья", "Приввветик", "ab", "ПРИВЕТ ДРУЗЬЯ", "а б в г дом", "Да", "бвгджзклмн"]
    got = column(spark, texts, T.noise_reasons)
    assert got[0] == [] and got[5] == []
    assert got[1] == ["repeated_letters"]
    assert got[2] == ["low_cyrillic_ratio", "too_few_meaningful_chars"]
    assert got[3] == ["random_uppercase_sequence"]
    assert got[4] == ["too_many_one_char_words", "too_many_short_fragments"]
    assert got[6] == ["too_few_vowels"]
    assert column(spark, ["", "ab", "Да", "мы"], T.mild_noise_reasons)[:1] == [["empty", "very_short_noise", "extremely_low_cyrillic_ratio"]]


def test_repair_and_sanity(spark):
    texts = ["янесомневаюсьвтвоейпреданности", "кришнагосподь", "мы уже дома все", ""]
    assert column(spark, texts, T.repair_spacing) == ["Я не сомневаюсь в твоей преданности", "кришна господь", "мы уже дома все", ""]
    sane = column(spark, ["мы идем", "бвгд"], T.language_sanity)
    assert [(r.valid, r.reason) for r in sane] == [(True, "local_language_sanity"), (False, "language_sanity_noise")]


def test_score(spark):
    got = column(spark, ["", "Привет", "а" * 5], lambda t: F.round(T.candidate_score(t, 0.5), 6))
    assert got == [0.0, 17.5 + 6 * 1.8 + 6 * 0.2 + 25.0, 17.5 + 5 * 1.8 + 5 * 0.2 + 25.0 - 8.0]


def test_cleanup_and_translation_forms(spark):
    assert column(spark, [" - приветМир ! ", "...", "перевод фильма"], T.heuristic_cleanup) == ["привет Мир", "", ""]
    assert column(spark, ["аб вг де", "раз два три", "ааааааа"], lambda t: T.heuristic_cleanup(t, True)) == ["", "раз два три", ""]
    assert column(spark, ["«домЛес»", "  дом. "], T.clean_for_translation) == ["«дом Лес»", "дом"]


def test_block_predicates(spark):
    texts = ["ой ай", "скажите нам", "аб abc", "нет", "дорога домой была", "аб вг де жз ик лм но пр ст уф"]
    assert column(spark, texts, T.is_short_noise) == [True, False, True, False, False, False]
    assert column(spark, texts, T.is_fragment_noise) == [False] * 5 + [True]


def test_timecodes(spark):
    assert column(spark, [0.0, 1.234, 3661.9999, -2.0, 359999.5], timecode.srt_time, "double") == ["00:00:00,000", "00:00:01,234", "01:01:01,999", "00:00:00,000", "99:59:59,500"]
    assert column(spark, [59.4, 3599.6, 3601.0], timecode.eta, "double") == ["00:59", "01:00:00", "01:00:01"]
    assert column(spark, ["00:05:00", "", None], timecode.parse_clock) == [300.0, None, None]
    assert column(spark, ["bottom:25"], timecode.parse_area) == [0.25]
    for bad in ("0:5:0", "00:60:00", "x"):
        with pytest.raises(Exception, match="HH:MM:SS"):
            column(spark, [bad], timecode.parse_clock)
    with pytest.raises(Exception, match="subtitle area"):
        column(spark, ["bottom:90"], timecode.parse_area)


def test_progress_ladder(spark):
    lines = ["Zkouším cookies", "OCR frame 25/50", "OCR frame 1/0", "Překlad průběh: 1/4 titulků", "SRT uloženo: subtitles_original_raw.srt", "SRT uloženo: subtitles_cs.srt", "Hotové video", "x"]
    assert [r.percent for r in column(spark, lines, timecode.progress)] == [12, 48, 65, 70, 65, 85, 100, None]
    errors = ["translation_failed: no net", "Stažení videa selhalo (1)", "", "other"]
    assert column(spark, errors, timecode.error_message)[0] == "Překlad selhal: no net"
    assert column(spark, errors, timecode.error_message)[3] == "other"


def test_similarity_is_that_of_difflib(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("Привет!", "привет"), ("!!", "!!"), ("", "a"), (None, "a")], "a string, b string")
    rows = df.select(ratio(F.col("a"), F.col("b")).alias("r"), similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.r for r in rows][:2] == [0.25, 0.5]
    assert rows[2].s == 1.0 and rows[3].s == 1.0 and rows[4].s == 0.0 and rows[5].r is None


def test_rules_count_without_lists():
    """Counts are lengths of what is left of a text, and ranges within Latin-1 are spelt out; no list of single characters is made."""
    assert T.members("a-cÀ-Â") == "abcÀÁÂ" and T.members("Ѐ-ӿ") == "Ѐ-ӿ" and T.members(r"\p{L}") == r"\p{L}"
    assert set(T.capitals(LATIN)) >= set("AZÀÞ") and not set(T.capitals(LATIN)) & set("azßÿ")


def test_counts_and_repeats_of_odd_texts(spark):
    texts = ["aÖ×b 1!k", "aabb", "aaBb c", "aaa", "aab", "ÉÉÉÉAB x", "éééé"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.count_script(F.col("t"), LATIN)).collect()] == [4, 4, 5, 3, 3, 7, 4]
    got = [r[0] for r in df.select(T.noise_reasons(F.col("t"), LATIN)).collect()]
    assert ["repeated_letters" in x for x in got] == [False, True, True, True, False, True, True]
    assert ["random_uppercase_sequence" in x for x in got] == [False] * 5 + [True, False]


def test_rejections_are_made_once_a_row(spark):
    """No filter on a reason is pushed to the scan, where it would clean each text again."""
    from subloom.plans import queries

    plan = queries.rejection_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("x85") == 1 and "Filter" not in plan.split("Relation")[0].split("Repartition")[-1]


def test_reason_counts_judge_nothing(spark):
    """The cleaner's reasons are counted without the noise filter's verdict on each text."""
    from subloom.plans import queries

    plan = queries.clean_reason_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "noise_filter" not in plan


def test_lines_of_a_long_text_are_looked_at_until_it_is_too_long(spark):
    long = "\n".join(["The river was cold and the stone was old"] * 8)
    texts = [long, long + "\nlicensed\nunder the stone", "licensed\nunder", long + "\nwww", "the river", ""]
    for rule, most in T.LONGEST.items():
        got = column(spark, texts, lambda t, rule=rule: T.clean_with_reason(t, rule, 0.3, 3, LATIN)["reason"])
        assert got[:2] == [f"too_long_{rule}", "credit_or_technical_text"] and got[3] == f"too_long_{rule}"
        assert len(long) > most
    plan = spark.createDataFrame([("",)], "t string").select(T.clean_with_reason(F.col("t"), "balanced", 0.3, 3, LATIN))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan  # a fold, which stops looking


def test_words_in_one_string_are_trimmed_like_a_list(spark):
    texts = ["x the x", "x y z", "a", "", "I", "the b c d stone", "the b c d", "x I am y x", "b c d", "é the", "Y x"]
    as_list = column(spark, texts, lambda t: F.array_join(T.trim_noise_words(T.words(t, LATIN), LATIN), " "))
    assert column(spark, texts, lambda t: T.trim_spaced(T.spaced(t, LATIN), LATIN)) == as_list
    assert column(spark, ["12 the, a\tb", "the  of", "..", "the.of"], lambda t: T.spaced(t, LATIN)) == ["the a b", "the of", "", "the of"]


def test_rules_that_stop_at_the_first_word(spark):
    texts = ["the", "The stone", "other", "x the", "été le", "Über UND", "", "b.of.c", "aTHE", "que?"]
    assert column(spark, texts, lambda t: T.has_common(t, LATIN)) == [n > 0 for n in column(spark, texts, lambda t: T.common_count(t, LATIN))]
    assert T.small_letters(LATIN) and not T.small_letters(replace(LATIN, lower="à-яa-z"))
    few = ["e", "a b c", "ab " * 9 + "x", "ab " * 9 + "xy", "12", "stone " * 4]
    assert column(spark, few, lambda t: T.is_short_noise(t, LATIN)) == [True, True, True, False, False, False]


def test_a_known_good_language_is_not_judged_again(spark):
    df = spark.createDataFrame([("brst",)], "t string")
    assert df.select(T.is_acceptable_recovery(F.col("t"), LATIN, F.lit(True)), T.is_acceptable_recovery(F.col("t"), LATIN)).first()[:] == (True, False)
