"""Operators against brute force, on every awkward row there is."""

from __future__ import annotations

import array
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subloom.llm import bpe, components, exact_dedup, langid, licenses, packing, quality, simhash, suffix_dedup, toxicity, winnowing
from subloom.llm.queries import tokenizer_path

from . import data

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    return data.table(spark)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda d, labels: exact_dedup.exact_groups(d),
    "simhash": lambda d, labels: simhash.near_duplicates(d),
    "bpe": lambda d, labels: bpe.round_trip(d, tokenizer_path()),
    "packing": lambda d, labels: packing.pack(d, tokenizer_path()).drop("sequence_id", "offset"),
    "licences": lambda d, labels: licenses.licences(d),
    "winnowing": lambda d, labels: winnowing.edited_likeness(d),
    "suffix": lambda d, labels: suffix_dedup.removed(d),
    "langid": lambda d, labels: langid.identify(d),
    "toxicity": toxicity.toxicity,
    "quality": quality.resample,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_empty_table(spark, docs, labels, name):
    run = OPERATORS[name]
    own = run(docs, labels)
    assert plain(run(data.clashing(docs), labels).collect()) == plain(own.collect())
    empty = run(data.table(spark, []), labels)
    assert empty.columns == own.columns
    assert empty.count() == 0


def test_exact_groups(docs):
    rows = data.rows()
    norm = [(r[0], (r[1] or "").translate(UPPER)) for r in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    want = Counter()
    for d, t in norm:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want[(d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert plain(exact_dedup.exact_groups(docs).collect()) == want


def test_fingerprints_compose():
    draw = random.Random(1)
    text = bytes(draw.randrange(256) for _ in range(200_000))
    whole = exact_dedup.Fingerprint.of(text)
    for cut in (0, 1, 65535, 65536, 123_456, len(text)):
        joined = exact_dedup.Fingerprint.of(text[:cut]) + exact_dedup.Fingerprint.of(text[cut:])
        assert (joined.length, joined.residues) == (whole.length, whole.residues)
    assert exact_dedup.Fingerprint.of(b"ab").value != exact_dedup.Fingerprint.of(b"ba").value


@pytest.mark.parametrize("modulus", [1, 3])
def test_colliding_fingerprints_are_told_apart(docs, modulus):
    assert plain(exact_dedup.exact_groups(docs, modulus).collect()) == plain(exact_dedup.exact_groups(docs).collect())


def test_huge_texts_and_prefixes(spark, monkeypatch):
    """Chunks of huge texts are hashed apart and combined; a text is told from one that goes on after a whole chunk."""
    monkeypatch.setattr(exact_dedup, "CHUNK", 8)
    monkeypatch.setattr(exact_dedup, "HUGE", 20)
    texts = ["abcdefgh" * 9, "ABCDEFGH" * 9, "abcdefgh" * 8, "abcdefgh" * 8 + "abcdefgx", "abcdefgh", "", None, "é" * 40, "abcdefgh" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string").repartition(3)
    norm = [(t or "").translate(UPPER) for t in texts]
    for modulus in (None, 1):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df, modulus).collect()}
        for i, t in enumerate(norm):
            assert got[i] == (max(k for k, u in enumerate(norm) if u == t), norm.count(t) + (t == norm[0]))
    whole = {r.doc_id: (r.fp_len, r.fp) for r in exact_dedup.fingerprints(df).collect()}
    for i, t in enumerate(norm):
        fp = exact_dedup.Fingerprint.of(t.encode())
        assert whole[i] == (fp.length, fp.value)


def brute_simhash(text, k=3):
    words = (text or "").translate(UPPER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_and_components(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    rows = [(r[0], brute_simhash(r[1])) for r in data.rows()]
    assert set(got) == {(d, format(f, "016x")) for d, f in rows}
    group = {f: {f} for _, f in rows}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    for d, f in rows:
        ids = [x for x, g in rows if g in group[f] and x is not None]
        assert got[d, format(f, "016x")] == min(ids, default=None)


@pytest.mark.parametrize(("radius", "blocks"), [(2, 4), (4, 7)])
def test_links_find_every_pair(spark, radius, blocks, monkeypatch):
    draw = random.Random(5)
    fps = [draw.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = draw.choice(fps)
        for _ in range(draw.randrange(1, 7)):
            x ^= 1 << draw.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    for limit in (simhash.GROUP, 2):  # the second has groups keyed again
        monkeypatch.setattr(simhash, "GROUP", limit)
        got = dict(components.components(simhash.links(nodes, radius, blocks), "a", "b").collect())
        assert [got.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_wide_fingerprints():
    text = data.prose(4, 300)
    hashes = simhash._shingle_hashes(text, 3)
    own = simhash.wide(hashes)
    assert len(own) == 4 and int(own[0]) == brute_simhash(text) == simhash.simhash(text)
    assert len(set(own.tolist())) == 4
    assert simhash.wide(np.empty(0, np.uint64)).tolist() == [0] * 4


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = dict(components.components(links, "a", "b").collect())
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


ODD = ["", "  ", "a\x1cb\x1d c", "<|endoftext|>x<|startoftext|> <|endoftext|", "İSTANBUL ΣΑΣ ΣΑΣ.", "日本語 ² Ⅷ 12a_b it's I'M", "é É a​b　c\x85d", "ﬁ ǅ 's 't'rex", "a" * 3000]


def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    own, memoised = bpe.Encoder(tokenizer_path()), packing.Ids(tokenizer_path())
    for text in ODD + [r[1] or "" for r in data.rows()]:
        ids = library.encode(text, add_special_tokens=False).ids
        for data_ in (own.encode(text), own.encode(text), next(iter(memoised.of([text])))):
            assert memoryview(data_).cast("I").tolist() == ids, text[:50]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = plain(bpe.round_trip(docs, tokenizer_path()).collect())
    want = Counter()
    for r in data.rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in data.rows():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[(r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(array.array("I", ids[at : at + 2048]).tobytes()))] += 1
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert plain(r[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    size = (16, 100, 2048, 2048)[seed]
    counts = np.zeros(size + 1, np.int64)
    counts[1:] = draw.integers(0, (3, 2, 4, 500)[seed], size)
    plan = packing.plan(counts, size)
    used = np.zeros(size + 1, np.int64)
    for pattern, n in zip(plan.patterns, plan.repeats, strict=True):
        assert sum(pattern) <= size
        for x in pattern:
            used[x] += n
    assert (used == counts).all()
    assert sum(plan.repeats) <= 1.02 * -(-int(counts @ np.arange(size + 1)) // size) + 1


def brute_winnow(text):
    k, w = winnowing.K, winnowing.W
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or ([text] if text else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) & (1 << winnowing._HASH) - 1 for g in grams]
    windows = [range(i, i + w) for i in range(len(hashes) - w + 1)] or ([range(len(hashes))] if hashes else [])
    return sorted({(-place, least) for least, place in (min((hashes[i], -i) for i in r) for r in windows)})


def test_winnowing(spark):
    draw = random.Random(2)
    sizes = [0, 1, 2, 5, 8, 9, 22, 23, 24, 26, 27, 28, 40, 60, 150, 1000, winnowing.SEGMENT, winnowing.SEGMENT + winnowing.GUARANTEE, 40_000, 3]
    texts = ["".join(draw.choice("abé😀 \n" if k % 3 else "aa") for _ in range(n)) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in winnowing.fingerprints(df).collect():
        assert [(p.position, p.hash) for p in r.places] == brute_winnow(texts[r.doc_id])
    digest = lambda t: hashlib.sha256(",".join(format((h << winnowing._PLACE) + (1 << winnowing._PLACE) - 1 - p, "X") for p, h in brute_winnow(t)).encode()).hexdigest()
    like = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for r in winnowing.edited_likeness(df).collect():
        text, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        a, b, c = ({h for _, h in brute_winnow(t)} for t in (text, edited, after))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(text), digest(edited))
        assert (r.near_edited, r.near_next) == pytest.approx((like(a, b), like(a, c)))


def test_shared_passages_share_a_hash():
    draw = random.Random(3)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(winnowing.GUARANTEE))
    a, b = ("".join(draw.choice("ijklm") for _ in range(n)) for n in (70, 91))
    assert {h for _, h in brute_winnow(a + passage + a)} & {h for _, h in brute_winnow(b + passage)}


def test_next_documents_of_hot_ids(spark):
    """A third of the rows without id, a third with one id, identical rows: every row once, each after the one before it."""
    rows = [(None, f"null {i % 40}") for i in range(60)] + [(7, f"seven {i} " * 4) for i in range(60)] + [(i, f"text of {i} " * 9) for i in range(60)] + [(9, "again and again, the very same row")] * 30
    base = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hash_of = {r.text: r.h for r in base.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of[r[1]]))
    want = Counter((d, t, ordered[(i + 1) % len(ordered)][1]) for i, (d, t) in enumerate(ordered))
    got = winnowing._with_next(base)
    assert Counter((r.doc_id, r.text, r.next_text) for r in got.select("doc_id", "text", "next_text").collect()) == want
    sizes = base.withColumn("h", F.xxhash64("text")).groupBy(winnowing._parts(base.withColumn("h", F.xxhash64("text")), 12).alias("part")).count().collect()
    assert max(r["count"] for r in sizes) <= 60


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_cuts_below_a_value(spark, n):
    cuts = [3 * i for i in range(n)]
    values = [-1, 0, 1, 2, 3, 4, 3 * n // 2, 3 * n, 3 * n + 9]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", winnowing._below(cuts, F.col("v")).alias("k")).collect()
    assert {r.v: r.k for r in got} == {v: sum(c < v for c in cuts) for v in values}


def test_next_document_of_repeated_and_null_ids(docs):
    rows = winnowing.edited_likeness(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in data.rows())
    by_text = defaultdict(set)
    ids = {r[0]: r[1] or "" for r in data.rows() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            by_text[ids[r.doc_id]].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_licences(spark):
    notice = licenses.TEMPLATES
    filler = data.prose(7, 400)
    texts = {
        1: filler + " " + notice["MIT"].upper() + " " + filler,
        2: notice["MIT-grant"] + "\n" + notice["GPL-3.0"] + " " + notice["CC-BY-NC-4.0"],
        3: filler,
        4: None,
        5: "Licensed under the Apache Licence",
        6: " ".join(notice["ISC"].split()[:-1]),
        7: filler + "\n" + notice["BSD-3-Clause-text"].replace("\n", "\n# ") + filler,
    }
    got = {r.doc_id: (r.licences, r.n_licences) for r in licenses.licences(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got.pop(7)[0].split(",")[:3] == ["BSD-2-Clause-text", "BSD-3-Clause", "BSD-3-Clause-text"]
    assert got == {1: ("MIT", 1), 2: ("CC-BY-NC-4.0,GPL-3.0,MIT-grant", 3), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("ISC", 1)}


def test_bands_keep_what_they_promise():
    for n_words, shingles in ((5, 1), (7, 3), (31, 27), (170, 160), (1500, 1490)):
        bands = licenses.bands_of([(n_words, shingles)])
        (window, n), = bands.items()
        assert 2 * n_words <= window < 4 * n_words
        held = -(-8 * shingles // 10)
        j = held / (window - licenses.SHINGLE + 1 + shingles - held)
        assert licenses.similarity_bound(shingles, window) == pytest.approx(j)
        assert licenses.collision(j, n) >= 1 - licenses.MISSED > licenses.collision(j, n - 1)


def brute_licences(text, templates=None):
    """Every window of every template's scale, exactly."""
    k, out = licenses.SHINGLE, set()
    w = re.findall(r"[^\W_]+", text.lower())
    for name, t in (licenses.TEMPLATES if templates is None else templates).items():
        own = re.findall(r"[^\W_]+", t.lower())
        want = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        size = 2
        while size < 2 * len(own):
            size *= 2
        for at in range(0, len(w), size // 2):
            part = w[at : at + size]
            if want and len(want & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) >= licenses.CONTAINMENT * len(want):
                out.add(name)
    return ",".join(sorted(out))


def test_licences_beside_each_other(spark):
    notice = licenses.TEMPLATES
    texts = [" ".join(notice[n] for n in names) for k in (2, 3) for names in permutations(["MIT", "CC-BY-NC-4.0", "ISC", "MIT-grant", "Apache-2.0-header", "GPL-3.0"], k)]
    texts += [f"{a} {b}" for a, b in combinations(notice.values(), 2)]
    draw = random.Random(3)
    for _ in range(30):
        names = list(notice)
        draw.shuffle(names)
        texts.append("\n".join(notice[n] for n in names))
    texts += ["\n".join(notice.values()), "\n".join(reversed(notice.values()))]
    got = {r.doc_id: r.licences for r in licenses.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_licences(t) for i, t in enumerate(texts)}
    assert all(got[i] == ",".join(sorted(notice)) for i in range(len(texts) - 32, len(texts)))


def test_long_templates_and_rows_that_share_an_id(spark, tmp_path):
    draw = random.Random(5)
    say = lambda n: " ".join(f"{draw.choice(data.WORDS)}{draw.randrange(400)}" for _ in range(n))
    templates = {"long": say(1500), "longer": say(6000), "short": "four words are few", "empty": ""}
    cut = templates["long"].split()
    rows = [(1, say(900) + " " + templates["long"] + " " + say(300)), (1, say(50)), (None, "hello"), (None, templates["longer"]), (2, " ".join(cut[:1290])), (3, " ".join(cut[:1100]))]
    got = licenses.licences(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert Counter((r.doc_id, r.licences) for r in got) == Counter([(1, "long"), (1, ""), (None, ""), (None, "longer"), (2, "long"), (3, "")])
    assert [brute_licences(t, templates) for _, t in rows] == ["long", "", "", "longer", "long", ""]
    for name in ("long", "short"):
        (tmp_path / f"{name}.txt").write_text(templates[name])
    assert licenses.read_templates(spark, str(tmp_path)) == {n: templates[n] for n in ("long", "short")}
    assert {r.licences for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string"), {}).collect()} == {""}


def brute_removed(rows):
    texts = [((1 << 63) - 1 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    out = Counter()
    for (d, t), r in zip(texts, rows, strict=True):
        mark = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                mark[i : i + 50] = 1
        kept = bytes(b for b, m in zip(t, mark, strict=False) if not m)
        out[(r[0], len(t), int(mark.sum()), int((np.diff(mark, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_dedup(docs):
    assert plain(suffix_dedup.removed(docs).collect()) == brute_removed(data.rows())


def patchwork(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    pieces = ["".join(draw.choice("ab") for _ in range(n)) for n in (20, 49, 50, 51, 70, 120)] + ["a" * 130, "ab" * 60]
    return [(i, "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 6))), None, None, None) for i in range(60)]


@pytest.mark.parametrize(("hot", "buckets", "touch"), [(suffix_dedup.HOT, 100_000, 4096), (0, 100_000, 4096), (3, 2, 4096), (3, 2, 4), (0, 1, 7)])
def test_suffix_dedup_of_patchworks(spark, hot, buckets, touch, monkeypatch):
    rows = patchwork(hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)  # the block maker takes it along
    monkeypatch.setattr(suffix_dedup, "BUCKETS", buckets)  # fewer than partitions: some share a bucket
    monkeypatch.setattr(suffix_dedup, "TOUCH", touch)  # hashes meet in two levels
    monkeypatch.setattr(suffix_dedup, "RANGE", 20)
    assert plain(suffix_dedup.removed(data.table(spark, rows), hot).collect()) == brute_removed(rows)
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(data.table(spark, rows), hot).collect()}
    sizes = {k[0]: k[1] - k[2] for k in brute_removed(rows)}
    assert {d: len(t) for d, t in kept.items()} == sizes


def test_class_repeats_in_small_parts(monkeypatch):
    texts = [r[1].encode() for r in patchwork(1)]
    data_, starts = b"".join(texts), np.concatenate(([0], np.cumsum(list(map(len, texts)))))
    _, place, first, last = suffix_dedup.anchors(data_, starts)
    classes = sorted({(data_[a : b + suffix_dedup.LEAST], p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)})
    low = [i * 7 % 40 for i in range(len(classes))]
    times = [1 + i % 2 for i in range(len(classes))]
    leaf, inner = suffix_dedup.class_repeats(classes, low, times)
    assert len(inner) and leaf.tolist() == [t > 1 for t in times]
    for together in (1, 40):
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        again = suffix_dedup.class_repeats(classes, low, times)
        assert (again[0] == leaf).all() and (again[1] == inner).all()


def test_classes_that_share_a_gram_by_chance_are_not_sorted(monkeypatch):
    draw, seen, scan = random.Random(6), [], suffix_dedup.maximal_repeats
    monkeypatch.setattr(suffix_dedup, "maximal_repeats", lambda suffixes, *rest: seen.append(len(suffixes)) or scan(suffixes, *rest))
    gram, around = b"the same of both", lambda n: bytes(draw.randrange(256) for _ in range(n))
    classes = [(around(34) + gram + around(34), 34) for _ in range(50)]
    leaf, inner = suffix_dedup.class_repeats(classes, list(range(50)), [1] * 50)
    assert not leaf.any() and not len(inner) and sum(seen) == 0


@pytest.mark.parametrize("before", range(35))
@pytest.mark.parametrize("more", [0, 1, 5])
def test_a_window_with_its_gram_at_any_place_repeats(before, more):
    draw = random.Random(before)
    gram, around = b"the same of both", lambda n: bytes(draw.randrange(256) for _ in range(n))
    shared = around(before) + gram + around(34 - before + more)
    begin = [34 - before, max(0, 20 - before)]  # their strings begin at different places
    classes = [(around(n) + shared + around(max(0, before - more)), n + before) for n in begin] + [(around(34) + gram + around(34), 34)]
    leaf, inner = suffix_dedup.class_repeats(classes, [7, 3, 1], [1, 2, 1])
    assert leaf.tolist() == [False, True, False]
    assert inner.tolist() == [[0, begin[0], begin[0] + len(shared)]]


def test_maximal_repeats_by_brute_force():
    draw = random.Random(4)
    text = bytes(draw.choice(b"ab") for _ in range(120))
    suffixes = [text[i:] for i in range(len(text))]
    left = [text[i - 1] if i else -1 for i in range(len(text))]
    got = {(n, tuple(sorted(at))) for n, at in suffix_dedup.maximal_repeats(suffixes, left, 4)}
    want = set()
    for n in range(4, len(text)):
        places = defaultdict(list)
        for i in range(len(text) - n + 1):
            places[text[i : i + n]].append(i)
        for at in places.values():
            ends = {text[i + n] if i + n < len(text) else -1 - i for i in at}
            begins = {left[i] for i in at}
            if len(at) > 1 and len(ends) > 1 and len(begins) > 1:
                want.add((n, tuple(at)))
    assert got == want


def test_langid_and_null_rules(spark):
    vocab = {"en": "the and of water house".split(), "xx": "zorg blem quax irnt dulb".split()}
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice(vocab[lang]) for _ in range(50)), lang) for i in range(200) for lang in [("en", "xx")[i % 2]]]
    extra = [(1000, None, "en"), (1001, "123 !!", "xx"), (1002, "", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [r for r in rows if got[r[0]].held_out]
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in held)


def brute_features(text):
    """Buckets of a text's character n-grams, one by one."""
    padded, out = f" {(text or '').lower()} ", set()
    for n in toxicity.SIZES:
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = h * 1_114_123 + ord(c)
            out.add(((h + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - toxicity.BITS)
    return out


def test_toxicity_scores_by_brute_force(spark):
    """Features, naive Bayes ratios and scores from plain n-grams; the regression's weights are the model's own."""
    rows = data.rows()[:20]
    labelled = [(i % 3 == 0, r[1]) for i, r in enumerate(rows)]
    feats = toxicity.Features()
    assert all(set(feats.of(t).tolist()) == brute_features(t) and len(feats.of(t)) == len(brute_features(t)) for _, t in labelled)
    pairs = [(int(y), feats.of(t)) for y, t in labelled]
    counts = [Counter(b for y, t in labelled if y == kind for b in brute_features(t)) for kind in (False, True)]
    toxic = sum(y for y, _ in labelled)
    ratio = toxicity.log_count_ratios(pairs)
    for b in set(counts[0]) | set(counts[1]):
        want = np.log((counts[1][b] + 1) / (toxic + 2)) - np.log((counts[0][b] + 1) / (len(labelled) - toxic + 2)) if counts[0][b] + counts[1][b] > 2 else 0.0
        assert ratio[b] == pytest.approx(want)
    model = toxicity.fit(pairs, 0.3)
    got = sorted((r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), model).collect())
    for (d, x), r in zip(got, rows, strict=True):
        z = sum(float(model.weights[b]) for b in brute_features(r[1])) + model.bias
        assert d == r[0] and x == pytest.approx(1 / (1 + np.exp(-max(-50, min(50, z)))), rel=1e-3, abs=1e-9)


def test_long_texts_lose_no_ngram():
    text = data.prose(9, 60_000)  # over a stretch
    assert len(text) > 1 << 18
    feats = toxicity.Features()
    assert set(feats.of(text).tolist()) == brute_features(text)


def test_langid_by_one_compressor_call_a_block(spark):
    import zstandard

    rows = [(r[0], r[1], r[2]) for r in data.rows()] + [(200 + i, data.prose(200 + i, 40), f"l{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.dictionaries(docs, ~langid.held_out(F.col("doc_id")))
    letters = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).encode()
    learn = defaultdict(list)
    hash_of = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for d, t, lang in rows:
        if d is not None and lang is not None and t and re.search(r"[^\W\d_]", t) and zlib.crc32(str(d).encode()) % 3 != 1:
            learn[lang].append((hash_of[d], d, t))
    assert set(content) == set(learn)
    for lang, texts in learn.items():
        joined = b"".join(letters(t) + b"\n" for _, _, t in sorted(set(texts)))
        assert content[lang] == joined[: langid.DICTIONARY]
    for r in langid.classify(docs, content).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id and (d is not None or t))
        if r.doc_id is None or not text or not re.search(r"[^\W\d_]", text):
            continue
        data_, size = letters(text), {}
        for lang in sorted(content):
            made = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
            size[lang] = sum(len(made.compress(data_[i : i + langid.BLOCK])) for i in range(0, len(data_), langid.BLOCK))
        best = min(sorted(size), key=size.__getitem__)
        runner_up = min(v for k, v in size.items() if k != best)
        assert (r.lang_pred, r.score) == (best, pytest.approx((runner_up - size[best]) / runner_up))


def test_many_languages(spark):
    word = lambda k: "".join(chr(97 + k // 26**p % 26) * 3 for p in range(3))
    rows = [(i, f"{word(i % 600)} " * 5, f"lang{i % 600}") for i in range(1200)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.count() == 1200 and got.select("lang_pred").distinct().count() > 300


def test_toxicity_generalises(spark):
    draw = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        words = [draw.choice(data.WORDS) for _ in range(60)]
        if toxic := i % 5 == 0:
            words[draw.randrange(60)] = draw.choice(["stupidity", "rubbish"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    got = toxicity.toxicity(spark.createDataFrame([*rows, (999, None)], "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def brute_words(text):
    return re.split(rb"[ \t-\r]+", (text or "").encode().strip(b" \t\n\x0b\x0c\r")) if (text or "").strip(" \t\n\x0b\x0c\r") else []


def brute_ngrams(text):
    """N-grams of words and of word shapes as plain tuples."""
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"'\"-:;()", b"|#$%&*@=+<>/\\_~^[]{}"]
    words = brute_words(text)
    shapes = []
    for i, w in enumerate(words):
        kinds = {next((k for k, g in enumerate(groups) if c in g), "high" if c > 127 else "other") for c in w}
        shapes.append((frozenset(kinds), words[i - 1 : i] == [w], i > 1 and words[i - 2] == w))
    out = Counter(("w", w) for w in words) + Counter(("s", x) for x in shapes)
    out += Counter(("ww", *x) for x in zip(words, words[1:])) + Counter(("ss", *x) for x in zip(shapes, shapes[1:]))  # noqa: B905
    return out + Counter(("sss", *x) for x in zip(shapes, shapes[1:], shapes[2:]))  # noqa: B905


def brute_bucket(gram: tuple) -> int:
    """The cell of a plain n-gram, by a second implementation of the hash in whole numbers."""
    mask, base, odd = (1 << 64) - 1, 0x100000001B3, 0x9E3779B97F4A7C15

    def word(w: bytes) -> int:
        return sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)) & mask

    def shape(s: tuple) -> int:
        kinds, once, twice = s
        bits = sum(1 << (8 if k == "high" else 7 if k == "other" else k) for k in kinds) | once << 9 | twice << 10
        return ((bits + 1) * 0xFF51AFD7ED558CCD) & mask

    kind, *parts = gram
    one = word if kind[0] == "w" else shape
    value = one(parts[0])
    for p in parts[1:]:
        value = (value * 31 + one(p)) & mask
    x = ((value + {"w": 1, "ww": 2, "s": 3, "ss": 4, "sss": 5}[kind]) * odd) & mask
    x ^= x >> 29
    return ((x * odd) & mask) >> (64 - quality.BITS)


def test_quality_weights_by_brute_force(docs, labels):
    """Weights from plain counts of cells, each document left out of its own models."""
    good = {i for i in range(12) if i % 5}
    cell: dict = {}
    rows = []
    for r in data.rows():
        own = Counter()
        for gram, n in brute_ngrams(r[1]).items():
            own[cell.setdefault(gram, brute_bucket(gram))] += n
        rows.append((r[0], own))
    raw, target = Counter(), Counter()
    for d, grams in rows:
        raw += grams
        if d in good:
            target += grams
    n_raw, n_target, cells = sum(raw.values()), sum(target.values()), 1 << quality.BITS

    def mean(d, grams):
        own = grams if d in good else Counter()
        size, all_target = sum(grams.values()), n_target - sum(own.values())
        total = 0.0
        for g, k in grams.items():
            share = (raw[g] - k + quality.ALPHA) / (n_raw - size + quality.ALPHA * cells)
            total += k * np.log((target[g] - own[g] + n_target * share) / (all_target + n_target) / share)
        return total / size

    own = quality.model(docs, labels)
    assert own.totals == (n_raw, n_target)
    means = {}
    for d, grams in rows:
        if grams and d is not None and d < 12:
            means.setdefault(d, []).append(mean(d, grams))
    means = {d: min(v) for d, v in means.items()}
    low, high = max(means[d] for d in means if d not in good), min(means[d] for d in good)
    if low < high:
        assert own.cut == pytest.approx((low + high) / 2, rel=1e-6)
    got = sorted((r.doc_id, r.log_weight, r.likely) for r in quality.weights(docs, own).collect() if r.doc_id is not None)
    want = sorted((d, mean(d, g) * sum(g.values()) if g else 0.0, bool(g) and mean(d, g) > own.cut) for d, g in rows if d is not None)
    for (d, x, likely), (e, y, expected) in zip(got, want, strict=True):
        assert d == e and x == pytest.approx(y, rel=1e-6, abs=1e-6) and (likely == expected or abs(y) < 1e-6)


def test_quality_of_long_texts(monkeypatch):
    """Stretches and chunks change nothing, wherever they end."""
    texts = [data.prose(3, 900), "x" * 5000, "ab " * 2000, "\n\n" + data.prose(4, 50) + "   ", "é" * 333 + " . " + "!" * 40]
    whole = [quality.counted(t) for t in texts]
    for stretch, chunk in ((7, 3), (64, 10), (1000, 1)):
        monkeypatch.setattr(quality, "_STRETCH", stretch)
        monkeypatch.setattr(quality, "_CHUNK", chunk)
        for t, (bucket, n) in zip(texts, whole, strict=True):
            got = quality.counted(t)
            assert (got[0] == bucket).all() and (got[1] == n).all()
    assert int(whole[2][1].sum()) == sum(brute_ngrams(texts[2]).values())


def test_quality_keeps_languages_alike(spark):
    """Shares of unlabelled documents that stay, by language, within ten points from the smallest tables up; bad ones go."""
    shares = {}
    for sf in ("sf0.001", "sf0.01"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        drawn = quality.resample(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
        for r in drawn.groupBy("lang").agg(F.avg(F.when(F.col("quality").isNull(), F.col("selected").cast("double"))).alias("kept")).collect():
            shares[sf, r.lang] = r.kept
        kept = {r.quality: r.kept for r in drawn.groupBy("quality").agg(F.avg(F.col("selected").cast("double")).alias("kept")).collect()}
        assert kept[1] > 0.98 and kept[0] < 0.1
    assert all(0.6 < x < 0.95 for x in shares.values()), shares


def test_quality_selects_the_largest_keys(docs, labels, spark):
    ratio = quality.model(docs, labels)
    rows = quality.weights(docs, ratio).collect()
    assert len(rows) == len(data.rows())
    sizes = {r[0]: sum(brute_ngrams(r[1]).values()) for r in data.rows() if r[0] is not None and r[0] != 3}
    for r in rows:
        if r.doc_id in sizes:
            n = sizes[r.doc_id]
            assert r.key == (quality._sortable(quality.SCALE * r.log_weight / n + quality.gumbel(r.doc_id)) if n else quality.NEVER)
    keys = sorted((r.key for r in rows), reverse=True)
    scored = quality.weights(docs, ratio)
    for k in (1, 3, len(keys) - 1):
        assert quality.kth_largest(scored, k) == keys[k - 1]
    assert quality.kth_largest(scored, 0) is None
    chosen = [r for r in quality.resample(docs, labels, 5).collect() if r.selected]
    assert len(chosen) == sum(k >= keys[4] for k in keys)
    every = [r for r in quality.resample(docs, labels, 10**6).collect() if r.selected]
    assert len(every) == sum(k > quality.NEVER for k in keys)
    assert [quality._sortable(x) for x in (-2.0, -1.0, 0.0, 1.0, 2.0)] == sorted(quality._sortable(x) for x in (2.0, 1.0, 0.0, -1.0, -2.0))


def test_quality_draws_in_proportion_to_weights():
    """Over many seeds, each document is drawn as often as by drawing one after the other in proportion to its weight; seeds differ."""

    class Weighed:
        totals, cut = (1, 1), 0.0

        def weigh(self, doc, text):
            return weight[doc] / quality.SCALE, 1

    weight = dict(enumerate(np.log([1, 2, 4, 8, 1, 1, 16, 3])))
    k, seeds, times = 3, 4_000, Counter()
    sets = set()
    for seed in range(seeds):
        keys = {d: quality._scored(d, "x", Weighed(), seed)[2] for d in weight}
        drawn = sorted(keys, key=keys.get)[-k:]
        sets.add(frozenset(drawn))
        times.update(drawn)
    p = np.exp(list(weight.values()))
    want = np.zeros(len(p))
    for order in permutations(range(len(p)), k):
        chance, left = 1.0, p.sum()
        for d in order:
            chance *= p[d] / left
            left -= p[d]
        want[list(order)] += chance
    assert len(sets) > 20
    assert np.abs(np.array([times[d] / seeds for d in range(len(p))]) - want).max() < 0.03


def test_gumbel_draws_are_standard():
    draws = np.array([quality.gumbel(i) for i in range(20_000)])
    assert abs(draws.mean() - 0.5772) < 0.03
    assert abs(draws.var() - np.pi**2 / 6) < 0.07


@pytest.mark.parametrize("times", [1, 4])
def test_toxicity_of_repeated_rows(spark, times, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVE", 20)
    monkeypatch.setattr(toxicity, "NEGATIVE", 40)
    draw = random.Random(4)
    say = lambda words: " ".join(draw.choice(words) for _ in range(30))
    toxic = {i: i % 3 == 0 for i in range(300)}
    docs = [(i, say(["vile", "scum", "hateful"]) + " " + say(data.WORDS) if t else say(data.WORDS)) for i, t in toxic.items()]
    docs = docs[:1] + docs[1:] * times + [docs[1]] * (200 * (times - 1))
    labels = spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels).collect()
    assert len(got) == len(docs)
    assert sum(r.predicted == toxic[r.doc_id] for r in got) >= 0.99 * len(got)
