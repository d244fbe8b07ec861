"""Text rules as column expressions; the script is a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import count_in, ladder, let, reasons
from .scripts import CYRILLIC, Script

PUNCTUATION = " .,-_|\\/`^*%$#;:!?\"'"
SYMBOLS = ".-_|\\/`^*%$#=+~:;,.!?()[]{}<>\"'"
LINE_ENDS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"


def normalize(text: Column) -> Column:
    """Trimmed, with every run of white space as one blank (F1)."""
    return F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def merge_key(text: Column) -> Column:
    """Lower-case letters and figures only (F2)."""
    return F.regexp_replace(F.lower(normalize(text)), r"[^\p{L}\p{N}]+", "")


def members(characters: str) -> str:
    """A character class with its ranges within Latin-1 spelt out: Java looks those characters up in a bit set, ranges it asks one by one."""
    if "\\" in characters or any(ord(c) > 0xFF for c in characters):
        return characters
    return re.sub("([^-])-([^-])", lambda m: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in map(chr, range(ord(m[1]), ord(m[2]) + 1))), characters)


def capitals(script: Script) -> str:
    """The script's letters but for its small ones."""
    own, small = members(script.letters), members(script.lower)
    return "".join(c for c in own if c not in small) if (own + small).isalpha() else f"{own}&&[^{small}]"


def small_letters(script: Script) -> str:
    """The script's small letters as a class, where all of them are its own; else none."""
    each = re.sub("([^-])-([^-])", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), script.lower)
    fit = all(c.isalpha() and c.islower() and re.fullmatch(f"[{script.letters}]", c) for c in each)
    return members(script.lower) if fit else ""


def only(text: Column, characters: str) -> Column:
    """The characters of a class alone, joined: what lies between goes a run at a time."""
    return F.regexp_replace(text, f"[^{members(characters)}]+", "")


def count_class(text: Column, characters: str) -> Column:
    """How many characters of a class a text has; no list of them is made."""
    return F.char_length(only(text, characters))


def count_script(text: Column, script: Script = CYRILLIC) -> Column:
    return count_class(text, script.letters)


def count_foreign(text: Column, script: Script = CYRILLIC) -> Column:
    return count_class(text, script.foreign)


def _more_foreign(t: Column, own: Column, bound: Column, script: Script) -> Column:
    """Whether a text has more foreign letters than ``bound``; they are counted only where what is not the script's own is more."""
    return F.when(F.char_length(t) - own > bound, count_foreign(t, script) > bound).otherwise(F.lit(False))


def count_letters(text: Column) -> Column:
    return count_class(text, r"\p{L}")


def count_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]+", ""))


def count_upper(text: Column) -> Column:
    return count_class(text, r"\p{Lu}")


def meaningful(text: Column) -> Column:
    """Letters and figures of the normalised text."""
    return F.regexp_replace(normalize(text), r"[^\p{L}\p{N}]+", "")


def dense_length(text: Column) -> Column:
    """Characters that are no blanks, at least one."""
    return F.greatest(F.lit(1), F.char_length(F.replace(text, F.lit(" "), F.lit(""))))


def words(text: Column, script: Script = CYRILLIC) -> Column:
    """Runs of the script's letters."""
    return F.regexp_extract_all(text, F.lit(f"[{members(script.letters)}]+"), F.lit(0))


def spaced(text: Column, script: Script = CYRILLIC) -> Column:
    """The words of a text in one string, with a blank between them; no list is made."""
    other = f"[^{members(script.letters)}]"
    return F.btrim(F.regexp_replace(text, f"{other}(?:{other}+|(?<! ))", " "))  # a blank by itself stays as it is


def listed(words_of: Column) -> Column:
    """The list of words that ``spaced`` has in one string."""
    return F.when(words_of == "", F.array().cast("array<string>")).otherwise(F.split(words_of, " "))


def lowered(items: Column) -> Column:
    return F.transform(items, F.lower)


def count_vowels(text: Column, script: Script = CYRILLIC) -> Column:
    return count_class(text, script.vowels + script.vowels.upper())


def is_valid_short(text: Column, script: Script = CYRILLIC) -> Column:
    """A whitelisted short text (F8)."""
    joined = only(F.lower(F.btrim(normalize(text), F.lit(PUNCTUATION))), script.letters)
    return joined.isin(list(script.valid_short))


def common_count(text: Column, script: Script = CYRILLIC) -> Column:
    return count_in(words(F.lower(normalize(text)), script), script.common)


def vowel_ratio(text: Column, script: Script = CYRILLIC) -> Column:
    return let(only(text, script.letters), lambda joined: count_vowels(joined, script) / F.greatest(F.lit(1), F.char_length(joined)))


def _long(w: Column, n: int) -> Column:
    return F.size(F.filter(w, lambda x: F.char_length(x) >= n))


def _short(w: Column, n: int) -> Column:
    return F.size(F.filter(w, lambda x: F.char_length(x) <= n))


def trim_noise_words(items: Column, script: Script = CYRILLIC) -> Column:
    """Single letters cut from both ends, and from within where they abound."""
    letters = list(script.kept_letters)

    def ends(w: Column) -> Column:
        stays = F.transform(w, lambda x, i: F.when((F.char_length(x) > 1) | F.lower(x).isin(letters), i))
        first = F.coalesce(F.array_min(stays), F.size(w) - 1)
        last = F.greatest(F.coalesce(F.array_max(stays), first), first)
        return F.slice(w, first + 1, last - first + 1)

    return F.when(F.size(items) == 0, items).otherwise(let(let(items, ends), lambda w: _without_strays(w, script)))


def _without_strays(w: Column, script: Script) -> Column:
    short = list(script.short_words)
    stray = lambda x: (F.char_length(x) == 1) & ~F.lower(x).isin(short)
    many = (F.size(w) >= 3) & (F.size(F.filter(w, stray)) > F.size(w) * 0.35)
    return F.when(many, F.filter(w, lambda x: ~stray(x))).otherwise(w)


def _letter_but(script: Script, listed_ones: tuple[str, ...]) -> str:
    """One letter of the script as a pattern, but for those listed, small or capital."""
    stays = "".join(c for x in listed_ones if len(x) == 1 for c in {x, x.upper()} if len(c) == 1)
    return (f"(?![{stays}])" if stays else "") + f"[{members(script.letters)}]"


def trim_spaced(words_of: Column, script: Script = CYRILLIC) -> Column:
    """``trim_noise_words`` of words in one string; they are listed only where a stray letter stands among them."""
    end, stray = _letter_but(script, script.kept_letters), _letter_but(script, script.short_words)
    front = lambda t: F.when(F.substring(t, 2, 1) == " ", F.regexp_replace(t, f"^(?:{end} )+", "")).otherwise(t)
    back = lambda t: F.when(F.substring(t, -2, 1) == " ", F.regexp_replace(t, f"(?: {end})+$", "")).otherwise(t)

    def within(t: Column) -> Column:
        found = F.concat(F.lit(" "), t, F.lit(" ")).rlike(f" {stray} ")
        return F.when(found, F.array_join(let(F.split(t, " "), lambda w: _without_strays(w, script)), " ")).otherwise(t)

    return let(let(let(words_of, front), back), within)


def word_features(w: Column, script: Script = CYRILLIC, strict: bool = True) -> Column:
    """What the gibberish rules ask of a word list, as a struct; only the strict rules ask for common words and the longest."""
    known, vowel = list(script.short_words), f"[{members(script.vowels + script.vowels.upper())}]"

    def of(joined: Column) -> Column:
        long = F.filter(w, lambda x: F.char_length(x) >= 3)
        fields = [
            F.size(w).alias("n"),
            F.char_length(joined).alias("chars"),
            F.size(F.filter(w, lambda x: (F.char_length(x) > 1) | F.lower(x).isin(known))).alias("telling"),
            F.size(F.filter(w, lambda x: (F.char_length(x) <= 2) & ~F.lower(x).isin(known))).alias("odd"),
            count_vowels(joined, script).alias("vowels"),
            count_upper(joined).alias("upper"),
            F.size(long).alias("long"),
            F.size(F.filter(long, lambda x: ~x.rlike(vowel))).alias("mute"),
        ]
        if strict:
            fields += [count_in(lowered(w), script.common).alias("common"), F.array_max(F.transform(w, F.char_length)).alias("longest")]
        return F.struct(*fields)

    return let(F.array_join(w, ""), of)


def is_gibberish(f: Column, relaxed: bool) -> Column:
    """The rules on a word list's features (P5)."""
    pick = lambda strict, loose: loose if relaxed else strict
    n, chars = f["n"], F.greatest(F.lit(1), f["chars"])
    found = [
        n == 0,
        f["telling"] < F.greatest(F.lit(1.0), n * pick(0.6, 0.45)),
        f["odd"] / F.greatest(F.lit(1), n) > pick(0.45, 0.65),
        (f["chars"] >= 8) & (f["vowels"] / chars < pick(0.22, 0.14)),
        (f["chars"] >= 5) & (f["upper"] / chars > pick(0.45, 0.75)),
        (f["long"] > 0) & (f["mute"] / F.greatest(F.lit(1), f["long"]) > pick(0.35, 0.55)),
    ]
    if not relaxed:
        found += [(n <= 2) & (f["longest"] < 5), (f["chars"] < 8) & (f["common"] == 0), (n >= 4) & (f["common"] == 0) & (f["chars"] < 42)]
    out = F.lit(False)
    for rule in found:
        out = out | F.coalesce(rule, F.lit(False))
    return out


def looks_like_gibberish(items: Column, relaxed: bool, script: Script = CYRILLIC) -> Column:
    """Whether a word list is noise (P5)."""
    return let(items, lambda w: let(word_features(w, script), lambda f: is_gibberish(f, relaxed)))


def _short_enough(t: Column, own: Column, script: Script) -> Column:
    """``is_valid_short`` of a normalised text, looked at only where its letters are few enough for a listed one."""
    most = 2 * max(map(len, script.valid_short), default=0)
    return F.when(own <= most, is_valid_short(t, script)).otherwise(F.lit(False))


def _few_vowels(joined: Column, own: Column, share: float, script: Script) -> Column:
    """Whether vowels are less than a share of a text's letters: the first third often has enough of them."""
    of = lambda part: count_vowels(part, script) / F.greatest(F.lit(1), own)
    return F.when(of(F.substring(joined, F.lit(1), (own / 3).cast("int"))) >= share, F.lit(False)).otherwise(of(joined) < share)


def has_common(text: Column, script: Script = CYRILLIC) -> Column:
    """Whether ``common_count`` finds a word; the first one is enough."""
    return _common_in(normalize(text), script)


def _common_in(t: Column, script: Script) -> Column:
    """The same of a normal text."""
    one = f"[{members(script.letters)}]"
    return F.lower(t).rlike(f"(?<!{one})(?:{'|'.join(map(re.escape, script.common))})(?!{one})") if script.common else F.lit(False)


def _noise_rules(f: Column, short: Column, script: Script) -> list[tuple[str, Column]]:
    t, joined, own, w = f["t"], f["joined"], f["own"], f["w"]
    n, unless = F.size(w), ~short
    capital = F.aggregate(F.filter(w, lambda x: (F.char_length(x) >= 4) & (F.upper(x) == x) & x.rlike(r"\p{Lu}")), F.lit(0), lambda a, x: a + F.char_length(x))
    loud = t.rlike(f"[{capitals(script)}]{{4}}")  # no capital word where no four letters in a row are without small ones
    pair, again = f"(?iu)([{script.letters}])\\1", f"([{script.letters}])\\2"  # two pairs in one run are a run of three too
    return [
        ("low_cyrillic_ratio", (own / dense_length(t) < 0.40) & unless),
        ("too_many_one_char_words", (n >= 3) & (_short(w, 1) / F.greatest(F.lit(1), n) > 0.50)),
        ("too_many_short_fragments", (n >= 4) & unless & (_short(w, 2) / F.greatest(F.lit(1), n) > 0.75) & (count_in(lowered(w), script.common) < F.greatest(F.lit(2.0), n * 0.35))),
        ("too_few_meaningful_chars", unless & ~t.rlike(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*+){4}")),
        ("random_uppercase_sequence", unless & loud & (capital >= 6)),
        ("repeated_letters", t.rlike(pair + r"[\s\S]*?" + again) | t.rlike(pair + "\\1")),
        ("too_few_vowels", (n > 0) & unless & (own >= 8) & _few_vowels(joined, own, 0.12, script)),
    ]


def _noise_parts(t: Column, body: Callable[[Column], Column], script: Script) -> Column:
    """``body`` of struct(t, joined, own, short, w) of a normal text, each computed once."""
    counted = lambda f: let(F.struct(f["t"].alias("t"), f["spaced"].alias("spaced"), f["joined"].alias("joined"), F.char_length(f["joined"]).alias("own")), parts)
    parts = lambda f: let(F.struct(f["t"].alias("t"), f["joined"].alias("joined"), f["own"].alias("own"), _short_enough(f["t"], f["own"], script).alias("short"), listed(f["spaced"]).alias("w")), body)
    return let(let(F.struct(t.alias("t"), spaced(t, script).alias("spaced")), lambda f: F.struct(f["t"].alias("t"), f["spaced"].alias("spaced"), F.replace(f["spaced"], F.lit(" "), F.lit("")).alias("joined"))), counted)


def noise_features(text: Column, script: Script = CYRILLIC) -> Column:
    """struct(t, own, short, reasons): a text's normal form, its letters, whether it is a known short one, and the reasons to suspect noise (P6); each is computed once."""
    out = lambda f: F.struct(f["t"].alias("t"), f["own"].alias("own"), f["short"].alias("short"), reasons(*_noise_rules(f, f["short"], script)).alias("reasons"))
    return let(normalize(text), lambda t: _noise_parts(t, out, script))


def noise_reasons(text: Column, script: Script = CYRILLIC) -> Column:
    """Reasons to suspect noise (P6); empty for a clean text."""
    return noise_features(text, script)["reasons"]


def mild_noise_reasons(text: Column, script: Script = CYRILLIC) -> Column:
    """Reasons of the mild filter."""

    def rules(f: Column) -> Column:
        t, own, ratio = f["t"], f["own"], f["own"] / f["dense"]
        unless = ~is_valid_short(t, script)
        found = reasons(
            ("empty", t == ""),
            ("very_short_noise", (F.char_length(meaningful(t)) <= 3) & unless & (own <= 15)),
            ("extremely_low_cyrillic_ratio", (ratio < 0.12) & unless),
        )
        return F.when((own > 15) & (ratio >= 0.12), F.array().cast("array<string>")).otherwise(found)

    return let(normalize(text), lambda t: let(F.struct(t.alias("t"), count_script(t, script).alias("own"), dense_length(t).alias("dense")), rules))


def needs_deep_retry(text: Column, mode: str | Column, script: Script = CYRILLIC) -> Column:
    """Whether a reading is read again with more effort (P9); the mode may be a column."""
    if isinstance(mode, str) and mode == "none":
        return F.lit(False)

    def of(f: Column) -> Column:
        needs = (F.size(f["reasons"]) > 0) | (F.size(words(f["t"], script)) < 2) | (F.char_length(meaningful(f["t"])) < 4)
        if isinstance(mode, Column):
            return needs & ((mode == "aggressive") | ((mode == "short") & f["short"]))
        return needs if mode == "aggressive" else needs & f["short"]

    return let(noise_features(text, script), of)


def has_good_language(text: Column, script: Script = CYRILLIC) -> Column:
    """A plausible sentence."""

    def of(f: Column) -> Column:
        t, chars = f["t"], f["own"]
        enough = (chars >= 12) | _common_in(t, script) | (_long(f["w"], 3) >= 2)
        rules = dict(_noise_rules(f, f["short"], script))
        noisy = reduce(or_, [rules.pop("repeated_letters"), *rules.values()])  # the first that holds settles it
        return (chars > 0) & (f["short"] | ((chars >= 5) & enough & ~noisy & ~_few_vowels(f["joined"], chars, 0.22, script)))

    return let(normalize(text), lambda t: _noise_parts(t, of, script))


def is_acceptable_recovery(text: Column, script: Script = CYRILLIC, good: Column | None = None) -> Column:
    """``good`` is ``has_good_language`` of the text, where that is known."""
    return let(text, lambda t: has_common(t, script) | _short_enough(t, count_script(t, script), script) | (has_good_language(t, script) if good is None else good))


def repair_spacing(text: Column, script: Script = CYRILLIC) -> Column:
    """Blanks put around known words that were run together."""

    own, other = f"[{members(script.letters)}]++", f"[^{members(script.letters)}]++"
    three = other.join([own] * 3)  # three words

    def rules(t: Column) -> Column:
        out = t
        for hint in sorted((h for h in script.hints if len(h) >= 4), key=lambda h: (-len(h), h)):
            out = F.regexp_replace(out, f"(?iu)(?<!^)(?={hint})|(?<={hint})(?!$)", " ")
        fixed = let(normalize(out), lambda r: F.when(count_script(r, script) >= count_script(t, script), r).otherwise(t))
        key = merge_key(t)
        for phrase, whole in script.phrases.items():
            fixed = F.when(key == phrase, F.lit(whole)).otherwise(fixed)
        return F.when(F.contains(t, F.lit(" ")) & t.rlike(three), t).otherwise(fixed)

    return let(normalize(text), rules)


def looks_like_damaged_sentence(text: Column, script: Script = CYRILLIC) -> Column:
    """A text of more than twenty letters that has the make of a sentence (P10)."""

    def rules(t: Column) -> Column:
        return let(F.struct(t.alias("t"), spaced(t, script).alias("spaced")), again)

    def again(f: Column) -> Column:
        t, own = f["t"], f["spaced"]
        repaired = let(F.size(listed(own)) < 3, lambda few: F.when(few, spaced(repair_spacing(t, script), script)).otherwise(own))
        return (F.char_length(F.replace(own, F.lit(" "), F.lit(""))) > 20) & let(let(repaired, lambda w: F.struct(F.replace(w, F.lit(" "), F.lit("")).alias("joined"), listed(w).alias("w"))), whole)

    def whole(f: Column) -> Column:
        w, joined, n = f["w"], f["joined"], F.size(f["w"])
        chars = F.char_length(joined)
        return (n >= 3) & (_short(w, 2) / F.greatest(F.lit(1), n) <= 0.55) & ~_few_vowels(joined, chars, 0.18, script) & (count_upper(joined) / F.greatest(F.lit(1), chars) <= 0.65)

    return let(normalize(text), rules)


def language_sanity(text: Column, script: Script = CYRILLIC) -> Column:
    """struct(valid, repaired, reason) by the local rules (P10)."""

    def rules(r: Column) -> Column:
        valid = _common_in(r, script) | looks_like_damaged_sentence(r, script)
        reason = F.when(valid, F.lit("local_language_sanity")).otherwise(F.lit("language_sanity_noise"))
        return F.struct(valid.alias("valid"), r.alias("repaired"), reason.alias("reason"))

    return let(repair_spacing(text, script), rules)


def candidate_score(text: Column, confidence: Column | float = 0.0, script: Script = CYRILLIC) -> Column:
    """Score of a reading."""
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    off = lambda condition, amount: F.when(condition, F.lit(float(amount))).otherwise(F.lit(0.0))

    def score(f: Column) -> Column:
        t, rest, plain, n = f["t"], f["rest"], f["plain"], F.char_length(f["t"])
        letters, own = plain + count_letters(rest), plain + count_script(rest, script)
        return (
            f["confidence"] * 35.0
            + own * 1.8
            + letters * 0.2
            + own / dense_length(t) * 25.0
            - count_symbols(rest) * 1.2
            - off(t.rlike(r"([^\n])\1{4}"), 8)
            - off((n > 28) & ~F.contains(t, F.lit(" ")), 10)
            - off((own >= 6) & (count_upper(rest) / F.greatest(F.lit(1), own) > 0.55), 8)
            - F.greatest(F.lit(0), n - 150) * 0.04
        )

    def parted(f: Column) -> Column:
        blanks = F.char_length(f["t"]) - F.char_length(F.replace(f["t"], F.lit(" "), F.lit("")))
        return F.struct(f["t"].alias("t"), f["confidence"].alias("confidence"), f["rest"].alias("rest"), (F.char_length(f["t"]) - F.char_length(f["rest"]) - blanks).alias("plain"))

    rest = F.regexp_replace(text, f"[{small_letters(script)} ]+", "")  # most of a text is the script's small letters, which need no further look
    features = F.struct(text.alias("t"), confidence.alias("confidence"), rest.alias("rest"))
    return F.when(text == "", F.lit(0.0)).otherwise(let(let(features, parted), score))


def clean_for_translation(text: Column, script: Script = CYRILLIC) -> Column:
    """Punctuation off both ends, words run together by case parted (F16)."""
    stripped = F.btrim(normalize(text), F.lit(PUNCTUATION))
    return normalize(F.regexp_replace(stripped, f"([{script.lower}])([{script.upper}])", "$1 $2"))


def heuristic_cleanup(text: Column, allow_drop: bool = False, script: Script = CYRILLIC) -> Column:
    """A tidied text, empty where it is to be dropped."""
    parted = F.regexp_replace(normalize(text), f"([{script.lower}])([{script.upper}])", "$1 $2")
    tidy = F.btrim(F.regexp_replace(parted, r"(?U)\s+([,.!?;:])", "$1"), F.lit(PUNCTUATION))

    def rules(t: Column) -> Column:
        low = F.lower(t)
        drop = t == ""
        for pattern in script.cleanup_noise:
            drop = drop | F.contains(low, F.lit(pattern))
        if allow_drop:
            tokens = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
            odd = F.size(F.filter(tokens, lambda x: (F.char_length(x) <= 2) & ~F.lower(x).isin(list(script.cleanup_short) or [""])))
            drop = drop | ((F.size(tokens) >= 3) & (odd / F.greatest(F.lit(1), F.size(tokens)) > 0.70)) | t.rlike(r"([^\n])\1{5,}")
        return F.when(drop, F.lit("")).otherwise(normalize(t))

    return let(tidy, rules)


def has_safe_anchor(text: Column, script: Script = CYRILLIC) -> Column:
    """A known phrase or word protects a block."""
    tokens = words(F.lower(text), script)
    known = F.exists(tokens, lambda x: (F.char_length(x) >= 3) & x.isin(list(script.safe_words)))
    return F.array_join(tokens, " ").isin(list(script.safe_phrases)) | known


def is_short_noise(text: Column, script: Script = CYRILLIC) -> Column:
    """Up to 19 letters without an anchor, and one of four signs."""

    def rules(t: Column) -> Column:
        few = t.rlike(one) & ~t.rlike(f"(?:{one}[^{members(script.letters)}]*+){{20}}")
        return F.when(few, let(count_script(t, script), lambda own: let(words(F.lower(t), script), lambda tokens: signs_of(t, own, tokens)))).otherwise(F.when(t.isNotNull(), F.lit(False)))

    one = f"[{members(script.letters)}]"

    def signs_of(t: Column, own: Column, tokens: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(tokens))
        scripts = sum((t.rlike(f"[{c}]").cast("int") for c in (script.letters, script.foreign, "\u0370-\u03ff")), F.lit(0))
        vowels = count_class(F.array_join(tokens, ""), script.vowels)
        signs = (_short(tokens, 2) / n > 0.50) | (_short(tokens, 3) == F.size(tokens)) | (scripts >= 2) | ((own >= 4) & (vowels / F.greatest(F.lit(1), own) < 0.20))
        return signs & ~has_safe_anchor(t, script)

    return let(text, rules)


def is_fragment_noise(text: Column, script: Script = CYRILLIC) -> Column:
    """Longer texts of scattered short fragments."""

    one = f"[{members(script.letters)}]"

    def rules(t: Column) -> Column:
        longer = F.lower(t).rlike(f"{one}{{4}}{one}*+[\\s\\S]*?{one}{{4}}")  # two words of four letters
        return F.when(longer, F.lit(False)).otherwise(let(words(F.lower(t), script), of_words(t)))

    def of_words(t: Column) -> Callable[[Column], Column]:
        def of(tokens: Column) -> Column:
            n = F.size(tokens)
            return (n >= 4) & (_short(tokens, 2) / F.greatest(F.lit(1), n) >= 0.55) & (_long(tokens, 4) < 2) & (count_script(t, script) >= 20) & ~has_safe_anchor(t, script)

        return of

    return let(text, rules)


def script_code(lang: Column) -> Column:
    """Recogniser code of a language."""
    return ladder((lang == "ru", "rus"), otherwise=lang)


def _rule(preset: str) -> str:
    """Presets that treat lines alike share a rule."""
    return "loose" if preset not in ("strict", "balanced", "legacy_good") else preset


def _credit(t: Column, script: Script) -> Column:
    return let(F.lower(t), lambda low: sum((F.contains(low, F.lit(c)).cast("int") for c in script.credits), F.lit(0)) > 0) if script.credits else F.lit(False)


def _possible_credit(text: Column, script: Script) -> Column:
    """Whether a credit can stand in what is left of a text: the longest word of one is in it, as no rule makes new words."""
    longest = [max(c.split(" "), key=len) for c in script.credits]
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(c)) for c in longest])) if longest else F.lit(False)


def _line_features(raw: Column, rules: set[str], script: Script, credit: Column) -> Column:
    """A line's text and what the rules ask of it, computed once; ``credit`` tells whether there can be one."""
    start = normalize(raw)
    if script.leading_noise:
        start = F.btrim(F.regexp_replace(start, f"(?iu)^(?:{script.leading_noise})\\s*[:\\-–—.]?\\s*", ""))

    def of(t: Column) -> Column:
        return let(F.struct(t.alias("t"), spaced(t, script).alias("spaced")), counted)

    def counted(f: Column) -> Column:
        return let(F.struct(f["t"].alias("t"), f["spaced"].alias("spaced"), F.char_length(F.replace(f["spaced"], F.lit(" "), F.lit(""))).alias("own")), features)

    def features(f: Column) -> Column:
        t = f["t"]
        fields = [t.alias("t"), _short_enough(t, f["own"], script).alias("short"), f["own"].alias("own")]
        if "legacy_good" in rules:
            few = f["own"] <= 15  # what has more stays
            fields += [F.when(few, F.char_length(meaningful(t))).alias("meaningful"), F.when(few, dense_length(t)).alias("dense")]
        if rules == {"legacy_good"}:
            return F.struct(*fields)
        fields += [F.when(credit, _credit(t, script)).otherwise(F.lit(False)).alias("credit"), _more_foreign(t, f["own"], F.greatest(F.lit(3), f["own"]), script).alias("foreign")]
        left = lambda w: F.when(w == f["spaced"], f["own"]).otherwise(F.char_length(F.replace(w, F.lit(" "), F.lit(""))))
        return let(trim_spaced(f["spaced"], script), lambda w: F.struct(*fields, w.alias("joined"), left(w).alias("left")))

    return let(start, of)


def _line_text(f: Column, rule: str, script: Script) -> Column:
    """A line's text under a rule, or null where it is dropped."""
    t, short = f["t"], f["short"]
    if rule == "legacy_good":
        return F.when((f["own"] > 15) | ((t != "") & (short | ((f["meaningful"] > 3) & (f["own"] / f["dense"] >= 0.12)))), t)
    gone = ((F.char_length(t) < 3) & ~short) | f["credit"] | f["foreign"] | ((F.char_length(f["joined"]) < 3) & ~short)
    if rule != "loose":
        noise = let(let(listed(f["joined"]), lambda w: word_features(w, script, rule == "strict")), lambda x: is_gibberish(x, rule == "balanced"))
        gone = gone | (count_symbols(t) > F.greatest(F.lit(3), count_letters(t))) | (~short & noise)
    return F.when(~gone, F.when(f["joined"] == "", t).otherwise(f["joined"]))


#: The most characters of a cleaned text under the rules that have such a bound.
LONGEST = {"strict": 160, "balanced": 240}


def _text_features(t: Column, rule: str, script: Script, credit: Column, own: Column | None) -> Column:
    """What the rules ask of a whole text; nothing is counted in texts that are too long anyhow. ``own`` are its letters, where they are known."""
    own = count_script(t, script) if own is None else own
    fields = [t.alias("t"), F.char_length(t).alias("length"), F.when(credit, _credit(t, script)).otherwise(F.lit(False)).alias("credit")]
    if rule == "legacy_good":
        return F.struct(*fields, F.when((own > 15) & (own / dense_length(t) >= 0.12), F.array().cast("array<string>")).otherwise(mild_noise_reasons(t, script)).alias("mild"))

    def counts(f: Column) -> Column:
        own = f["own"]
        more = [own.alias("own"), _short_enough(t, own, script).alias("short"), _more_foreign(t, own, F.greatest(F.lit(2.0), own * 0.45), script).alias("foreign"), dense_length(t).alias("dense")]
        if rule != "loose":
            blank = "(?U)[\\s" + "".join("\\" + c for c in sorted(set(SYMBOLS))) + "]+"
            more += [count_symbols(t).alias("symbols"), count_letters(t).alias("letters"), (F.char_length(t) - F.char_length(F.regexp_replace(t, blank, ""))).alias("blank")]
        return F.struct(*more)

    counted = let(F.struct(own.alias("own")), counts)
    return F.struct(*fields, (F.when(F.char_length(t) <= LONGEST[rule], counted) if rule in LONGEST else counted).alias("counts"))


def _verdict(f: Column, preset: str, min_ratio: float, min_chars: int) -> Column:
    """struct(cleaned, reason) of a whole text: the first rule that it breaks."""
    rule = _rule(preset)
    steps = [(f["t"] == "", "empty_after_cleanup"), (f["credit"], "credit_or_technical_text")]
    if rule in LONGEST:
        steps.append((f["length"] > LONGEST[rule], f"too_long_{rule}"))
    if rule == "legacy_good":
        steps.append((F.size(f["mild"]) > 0, F.array_join(f["mild"], ",")))
    else:
        n = f["counts"]
        own = n["own"]
        steps += [
            ((own < min_chars) & ~n["short"], "too_few_cyrillic_chars"),
            (n["foreign"], "too_many_latin_letters"),
            ((own / n["dense"] < min_ratio) & ~n["short"], "low_cyrillic_ratio"),
        ]
    if rule in LONGEST:
        steps.append((n["symbols"] > n["letters"], "more_symbols_than_letters"))
        steps.append((n["blank"] / F.greatest(F.lit(1), f["length"]) > (0.55 if rule == "strict" else 0.70), "mostly_symbols"))
    return let(ladder(*steps, otherwise="accepted"), lambda r: F.struct(F.when(r == "accepted", f["t"]).otherwise(F.lit("")).alias("cleaned"), r.alias("reason")))


def clean_under(text: Column, presets: list[tuple[str, float, int]], script: Script = CYRILLIC) -> Column:
    """array<struct(preset, r: struct(cleaned, reason))>: the cleaner's ladder (P4) under several presets (name, least share, least letters).

    Lines are split and looked at once for all presets, and each rule's text once
    for the presets that share it.  Under rules with a most length, lines are
    looked at until their text is longer, which settles it whatever follows,
    unless the text may hold a credit, which comes first.
    """
    by_rule: dict[str, list[tuple[str, float, int]]] = {}
    for preset in presets:
        by_rule.setdefault(_rule(preset[0]), []).append(preset)
    rules = set(by_rule)
    bounded = rules <= set(LONGEST)

    def under(rule: str, lines: Column, credit: Column) -> Column:
        def line(x: Column) -> Column:
            return let(_line_features(x, rules, script, credit), lambda f: _line_text(f, rule, script)) if bounded else _line_text(x, rule, script)

        def longer(a: Column, x: Column) -> Column:
            more = let(line(x), lambda s: F.when(s.isNull(), a).otherwise(F.concat(a, F.lit(" "), s)))
            return F.when(F.char_length(a) > LONGEST[rule] + 1, a).otherwise(more)  # it begins with a blank

        each = lambda f: F.array(*[F.struct(F.lit(n).alias("preset"), _verdict(f, n, share, chars).alias("r")) for n, share, chars in by_rule[rule]])
        judged = lambda t, own: let(_text_features(t, rule, script, credit, own), each)
        if rule in LONGEST:
            all_of_them = F.array_join(F.filter(F.transform(lines, line), lambda x: x.isNotNull()), " ")
            return let(normalize(F.when(credit, all_of_them).otherwise(F.aggregate(lines, F.lit(""), longer))), lambda t: judged(t, None))
        kept = F.filter(F.transform(lines, lambda f: F.struct(_line_text(f, rule, script).alias("t"), f["own" if rule == "legacy_good" else "left"].alias("own"))), lambda x: x["t"].isNotNull())
        whole_text = lambda k: F.struct(F.array_join(k["t"], " ").alias("t"), F.aggregate(k["own"], F.lit(0), lambda a, x: a + x).alias("own"))
        return let(let(kept, whole_text), lambda f: judged(f["t"], f["own"]))  # lines are normal, and so is what they make

    def whole(f: Column) -> Column:
        parts = [under(rule, f["lines"], f["credit"]) for rule in by_rule]
        return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))

    def lines_of(f: Column) -> Column:
        lines = F.split(f["text"], LINE_ENDS)
        lines = lines if bounded else F.transform(lines, lambda raw: _line_features(raw, rules, script, f["credit"]))
        return let(F.struct(lines.alias("lines"), f["credit"].alias("credit")), whole)

    return let(let(text, lambda t: F.struct(t.alias("text"), _possible_credit(t, script).alias("credit"))), lines_of)


def clean_with_reason(text: Column, preset: str, min_ratio: float, min_chars: int, script: Script = CYRILLIC) -> Column:
    """struct(cleaned, reason) under one preset."""
    return F.element_at(clean_under(text, [(preset, min_ratio, min_chars)], script), 1)["r"]
