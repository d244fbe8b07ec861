"""DuckDB SQL of the registered queries. Fragments mirror the column functions for the Latin script."""

from __future__ import annotations

from ..config import BUDGETS, PRESETS, SEARCH_ORDER
from ..functions.scripts import LATIN as S
from ..functions.text import PUNCTUATION, SYMBOLS
from ..operators.reports import EQUAL_BINS, QUALITY_BINS

_WS = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '[{_WS}]+', ' ', 'g'))"


def count(t: str, chars: str) -> str:
    return f"len(regexp_extract_all({t}, '[{chars}]'))"


def listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '[{S.letters}]+')"


def size_of(lst: str, condition: str) -> str:
    return f"len(list_filter({lst}, lambda x: {condition}))"


def key(t: str) -> str:
    return f"regexp_replace(lower({norm(t)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def vowels(t: str) -> str:
    return count(t, S.vowels + S.vowels.upper())


def symbols(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[^\\p{{L}}\\p{{N}}{_WS}]'))"


def dense(t: str) -> str:
    return f"greatest(1, length(replace({t}, ' ', '')))"


def meaningful(t: str) -> str:
    return f"length(regexp_replace({norm(t)}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def short(t: str) -> str:
    return f"(list_aggregate({words(f'lower(trim({norm(t)}, {q(PUNCTUATION)}))')}, 'string_agg', '') IN ({', '.join(map(q, S.valid_short))}))"


def valid_short(t: str) -> str:
    return f"coalesce({short(t)}, false)"


def joined(lst: str, sep: str = "") -> str:
    return f"coalesce(list_aggregate({lst}, 'string_agg', {q(sep)}), '')"


def repeats(t: str, n: int) -> str:
    """Whether a character other than a line end stands n times in a row."""
    same = " AND ".join(f"c[i] = c[i + {k}]" for k in range(1, n))
    return f"(SELECT count(*) > 0 FROM (SELECT unnest(range(1, len(c) - {n - 2})) AS i, c FROM (SELECT string_split({t}, '') AS c)) WHERE c[i] <> chr(10) AND {same})"


def score(t: str, conf: str, rep: str) -> str:
    own = count(t, S.letters)
    return (
        f"CASE WHEN {t} = '' THEN 0.0 ELSE {conf} * 35.0 + {own} * 1.8 + {count(t, chr(92) + 'p{L}')} * 0.2 + {own} / {dense(t)} * 25.0 - {symbols(t)} * 1.2"
        f" - CASE WHEN {rep} THEN 8.0 ELSE 0.0 END - CASE WHEN length({t}) > 28 AND NOT contains({t}, ' ') THEN 10.0 ELSE 0.0 END"
        f" - CASE WHEN {own} >= 6 AND {count(t, chr(92) + 'p{Lu}')} / greatest(1, {own}) > 0.55 THEN 8.0 ELSE 0.0 END - greatest(0, length({t}) - 150) * 0.04 END"
    )


EVENTS = "ev AS (SELECT user_id::VARCHAR AS video_id, event_id, ts, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 + 600.0 AS e, event_type AS text, value / 500.0 AS confidence FROM events)"
BLOCKS = f"""
    WITH {EVENTS},
    a AS (SELECT *, CASE WHEN lag(text) OVER w IS DISTINCT FROM text OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk FROM ev WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)),
    b AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
    c AS (SELECT *, CASE WHEN coalesce(t - max(e) OVER (PARTITION BY video_id, run ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 43200, true) THEN 1 ELSE 0 END AS nb FROM b),
    d AS (SELECT *, sum(nb) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS block_no FROM c),
    bl AS (SELECT video_id, block_no::INTEGER AS block_no, min(t) AS start, greatest(max(e), min(t) + 0.7) AS "end", any_value(text) AS text, max(confidence) AS confidence, count(*) AS readings FROM d GROUP BY video_id, block_no)
"""


def hist(bins: tuple, value: str) -> str:
    steps = " ".join(f"WHEN {value} < {edge} THEN '{name}'" for name, edge in bins[:-1])
    return f"CASE {steps} ELSE '{bins[-1][0]}' END"


def histogram(bins: tuple) -> str:
    names = ", ".join(f"('{n}')" for n, _ in bins)
    return f"WITH {EVENTS}, b AS (SELECT {hist(bins, 'confidence')} AS bin, count(*) AS n FROM ev GROUP BY 1) SELECT v.bin, coalesce(n, 0)::BIGINT AS n FROM (VALUES {names}) v(bin) LEFT JOIN b USING (bin)"


LINES = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def _credit(t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), {q(c)})" for c in S.credits) + ")"


def _trim(w: str) -> str:
    """The word list without stray letters; ``w`` is a column."""
    stays = f"(length({w}[i]) > 1 OR lower({w}[i]) IN ({', '.join(map(q, S.kept_letters))}))"
    first = f"coalesce(list_min(list_filter(range(1, len({w}) + 1), lambda i: {stays})), len({w}))"
    last = f"greatest(coalesce(list_max(list_filter(range(1, len({w}) + 1), lambda i: {stays})), {first}), {first})"
    return f"CASE WHEN len({w}) = 0 THEN {w} ELSE list_slice({w}, {first}, {last}) END"


def _within(w: str) -> str:
    stray = f"(length(x) = 1 AND NOT list_contains({listed(S.short_words)}, lower(x)))"
    return f"CASE WHEN len({w}) >= 3 AND {size_of(w, stray)} > len({w}) * 0.35 THEN list_filter({w}, lambda x: NOT {stray}) ELSE {w} END"


def _word_features(w: str) -> str:
    """Columns that the gibberish rules ask of a word list."""
    j, known = joined(w), listed(S.short_words)
    parts = {
        "n": f"len({w})",
        "chars": f"length({j})",
        "telling": size_of(w, f"length(x) > 1 OR list_contains({known}, lower(x))"),
        "odd": size_of(w, f"length(x) <= 2 AND NOT list_contains({known}, lower(x))"),
        "vow": vowels(j),
        "up": count(j, chr(92) + "p{Lu}"),
        "long": size_of(w, "length(x) >= 3"),
        "mute": size_of(w, "length(x) >= 3 AND " + vowels("x") + " = 0"),
        "common": size_of(w, f"list_contains({listed(S.common)}, lower(x))"),
        "longest": f"list_max(list_transform({w}, lambda x: length(x)))",
        "j": joined(w, " "),
    }
    return ", ".join(f"{e} AS {n}" for n, e in parts.items())


def _gibberish(relaxed: bool) -> str:
    pick = lambda strict, loose: loose if relaxed else strict
    rules = [
        "n = 0",
        f"telling < greatest(1.0, n * {pick(0.6, 0.45)})",
        f"odd / greatest(1, n) > {pick(0.45, 0.65)}",
        f"(chars >= 8 AND vow / greatest(1, chars) < {pick(0.22, 0.14)})",
        f"(chars >= 5 AND up / greatest(1, chars) > {pick(0.45, 0.75)})",
        f"(long > 0 AND mute / greatest(1, long) > {pick(0.35, 0.55)})",
    ]
    if not relaxed:
        rules += ["(n <= 2 AND longest < 5)", "(chars < 8 AND common = 0)", "(n >= 4 AND common = 0 AND chars < 42)"]
    return "coalesce(" + " OR ".join(rules) + ", false)"


def _line(rule: str) -> str:
    """A line's text under a rule, or null."""
    more = "" if rule == "loose" else f" OR symbols > greatest(3, letters) OR (NOT sh AND {_gibberish(rule == 'balanced')})"
    return f"CASE WHEN gone OR (length(j) < 3 AND NOT sh){more} THEN NULL WHEN j = '' THEN t ELSE j END"


def _ladder(preset: str) -> str:
    share, chars, _ = PRESETS[preset]
    strictness = preset if preset in ("strict", "balanced") else ""
    steps = [("t = ''", "empty_after_cleanup"), ("credit", "credit_or_technical_text")]
    if strictness:
        steps.append((f"length(t) > {160 if preset == 'strict' else 240}", f"too_long_{preset}"))
    steps += [
        (f"own < {chars} AND NOT sh", "too_few_cyrillic_chars"),
        ("latin > greatest(2.0, own * 0.45)", "too_many_latin_letters"),
        (f"own / dense < {share} AND NOT sh", "low_cyrillic_ratio"),
    ]
    if strictness:
        steps.append(("symbols > letters", "more_symbols_than_letters"))
        steps.append((f"blank / greatest(1, length(t)) > {0.55 if preset == 'strict' else 0.70}", "mostly_symbols"))
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in steps) + " ELSE 'accepted' END"


def evaluated(presets: tuple[str, ...] = tuple(PRESETS)) -> str:
    """Query: doc_id, video_id, confidence, preset, cleaned, reason of every document under the presets.

    Features of lines, and of the texts that they make under each rule, are
    columns, computed once.
    """
    rule_of = {p: p if p in ("strict", "balanced") else "loose" for p in presets}
    letters, blank = count("t", chr(92) + "p{L}"), count("t", _WS + "".join("\\" + c for c in sorted(set(SYMBOLS)) if c != "'") + "''")
    texts = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, i, {_line(r)} AS line FROM l4" for r in sorted(set(rule_of.values())))
    ladders = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS preset, t, {_ladder(p)} AS reason FROM tf WHERE rule = '{r}'" for p, r in rule_of.items())
    return f"""
        WITH l0 AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{LINES}') AS l FROM documents),
        l1 AS (SELECT doc_id, i, {norm("l[i]")} AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l0)),
        l2 AS MATERIALIZED (SELECT doc_id, i, t, {words("t")} AS w, {valid_short("t")} AS sh, {_credit("t")} AS credit, {count("t", S.foreign)} AS latin, {count("t", S.letters)} AS own, {symbols("t")} AS symbols, {letters} AS letters FROM l1),
        l3 AS MATERIALIZED (SELECT * REPLACE ({_trim("w")} AS w) FROM l2),
        l3b AS MATERIALIZED (SELECT * REPLACE ({_within("w")} AS w) FROM l3),
        l4 AS MATERIALIZED (SELECT doc_id, i, t, sh, symbols, letters, (length(t) < 3 AND NOT sh) OR credit OR latin > greatest(3, own) AS gone, {_word_features("w")} FROM l3b),
        tx AS MATERIALIZED (SELECT doc_id, rule, {norm("coalesce(string_agg(line, ' ' ORDER BY i), '')")} AS t FROM ({texts}) GROUP BY doc_id, rule),
        tf AS MATERIALIZED (SELECT doc_id, rule, t, {_credit("t")} AS credit, {valid_short("t")} AS sh, {count("t", S.letters)} AS own, {count("t", S.foreign)} AS latin, {dense("t")} AS dense, {symbols("t")} AS symbols, {letters} AS letters, {blank} AS blank FROM tx)
        SELECT d.doc_id, d.source AS video_id, (d.doc_id % 101) / 100.0 AS confidence, preset, CASE WHEN reason = 'accepted' THEN t ELSE '' END AS cleaned, reason FROM ({ladders}) x JOIN documents d USING (doc_id)
    """


def cleaned(preset: str) -> str:
    """The same of one preset."""
    return evaluated((preset,))


def noise_flags(t: str) -> list[tuple[str, str]]:
    """Reason and condition of the standard noise rules; ``t`` is a normalised column."""
    w = words(t)
    j, n = joined(w), f"len({w})"
    unless = f"NOT {valid_short(t)}"
    capital = f"list_filter({w}, lambda x: length(x) >= 4 AND {count('x', chr(92) + 'p{Lu}')} > 0 AND upper(x) = x)"
    chars = f"string_split(lower({t}), '')"
    letter = f"regexp_matches(c[i], '[{S.letters}]')"
    runs = f"(SELECT count(*) FROM (SELECT c, unnest(range(2, len(c) + 1)) AS i FROM (SELECT {chars} AS c)) WHERE {letter} AND c[i] = c[i - 1] AND (i < 3 OR c[i - 1] <> c[i - 2]))"
    triple = f"(SELECT count(*) FROM (SELECT c, unnest(range(3, len(c) + 1)) AS i FROM (SELECT {chars} AS c)) WHERE {letter} AND c[i] = c[i - 1] AND c[i - 1] = c[i - 2])"
    return [
        ("low_cyrillic_ratio", f"{count(t, S.letters)} / {dense(t)} < 0.40 AND {unless}"),
        ("too_many_one_char_words", f"{n} >= 3 AND {size_of(w, 'length(x) <= 1')} / greatest(1, {n}) > 0.50"),
        (
            "too_many_short_fragments",
            f"{n} >= 4 AND {unless} AND {size_of(w, 'length(x) <= 2')} / greatest(1, {n}) > 0.75 AND {size_of(w, f'list_contains({listed(S.common)}, lower(x))')} < greatest(2.0, {n} * 0.35)",
        ),
        ("too_few_meaningful_chars", f"{meaningful(t)} < 4 AND {unless}"),
        ("random_uppercase_sequence", f"length({joined(capital)}) >= 6 AND {unless}"),
        ("repeated_letters", f"{runs} >= 2 OR {triple} > 0"),
        ("too_few_vowels", f"{n} > 0 AND {unless} AND length({j}) >= 8 AND {vowels(j)} / greatest(1, length({j})) < 0.12"),
    ]


def srt_time(s: str) -> str:
    ms = f"(round_even(greatest({s}, 0.0) * 1000000, 0)::BIGINT // 1000)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


RANKS = "(VALUES " + ", ".join(f"('{p}', {i})" for i, p in enumerate(SEARCH_ORDER)) + ") r(preset, rank)"
FAST = BUDGETS["fast"]
BINS = {"equal": EQUAL_BINS, "quality": QUALITY_BINS}
