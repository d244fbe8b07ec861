"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from subloom.llm import search

from . import data

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def brute(rows: list[tuple], items: list[tuple], k: int = 10) -> dict:
    """Per item the (score, doc_id) of its best documents, over all rows."""
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        if scored:
            out[item] = scored[:k]
    return out


def found(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return out


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, "The river, the Stone; light"), (2, "café über 日本語😀"), (3, None), (4, "nothing_there zzzz"), (5, ""), (None, "house under walking"), (7, "morning"), (7, "bright morning"), (8, "aaaa")]


@pytest.mark.parametrize(("docs", "postings", "block", "pairs"), [(16_384, 1 << 20, 2_048, 1 << 18), (3, 40, 2, 4)])
def test_against_brute_force(spark, monkeypatch, docs, postings, block, pairs):
    for name, value in (("SHARD_DOCS", docs), ("SHARD_POSTINGS", postings), ("BLOCK", block), ("PAIRS", pairs)):
        monkeypatch.setattr(search, name, value)
    rows = data.rows()
    got = found(search.ranked(data.table(spark), items_table(spark, ITEMS)))
    assert got == brute(rows, ITEMS)
    assert 3 not in got and 4 not in got


def test_an_index_of_all_terms_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(search, "VOCABULARY", 10)
    assert found(search.ranked(data.table(spark), items_table(spark, ITEMS))) == brute(data.rows(), ITEMS)


def test_many_equal_scores_are_ordered_by_id(spark):
    rows = [(i, "river stone" if i % 3 else "river", "en", "a", 1) for i in range(400, 0, -1)] + [(None, "river stone", "en", "a", 1)] * 2 + [(5, "river stone", "en", "a", 1)]
    items = [(1, "stone"), (2, "river stone"), (3, "stone missing")]
    assert found(search.ranked(data.table(spark, rows), items_table(spark, items))) == brute(rows, items)


def test_clashing_columns_and_empty_tables(spark):
    own = found(search.ranked(data.table(spark), items_table(spark, ITEMS)))
    items = items_table(spark, ITEMS).selectExpr("*", "'clash' AS doc_id", "'clash' AS term", "'clash' AS score")
    assert found(search.ranked(data.clashing(data.table(spark)), items)) == own
    assert search.ranked(data.table(spark, []), items_table(spark, ITEMS)).collect() == []
    empty = search.ranked(data.table(spark), items_table(spark, []))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_lists_below_the_threshold_are_only_probed():
    """A frequent term's postings are not walked once the threshold is above its bound."""
    draw = random.Random(5)
    shard = search._Shard()
    for i in range(9_000):
        shard.add(i, 4, [(b"rare", 1)] * (draw.random() < 0.01) + [(b"often", 1)])
    row = shard.row().to_pylist()[0]
    lists = search._Lists(row, {b"rare": 5000, b"often": 1}, 9_000, 36_000)
    best = search.Best(10)
    search.max_score(lists, [b"rare", b"often"], best)
    plain = Counter()
    for d, s, _ in lists.lists.values():
        for x, y in zip(d.tolist(), s.tolist(), strict=True):
            plain[x] += y
    assert best.rows == sorted(((s, d) for d, s in plain.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert lists.lists[b"often"][2] < best.threshold()
