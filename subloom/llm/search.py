"""Ranked lexical search: an inverted index in shards, searched by MaxScore.

A shard is some thousand documents with the postings of their terms, as one row
of a table.  Upper bounds of a shard's terms split a query's terms into
essential ones, whose postings give the candidates, and the rest, whose postings
are probed only while a candidate can still be among the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, LOWER, drop_intermediates, intermediates, materialise, plain

#: Bounds of a shard: documents and postings (8 bytes each); a document is never split, so its own terms come on top.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 20
#: Documents that are scored at a time; the threshold rises from block to block.
BLOCK = 2_048
#: Bytes of distinct terms that a task may be sent as a filter; beyond it the index keeps every term.
VOCABULARY = 16 << 20
#: (item, term) pairs that one pass over the index answers; more items take more passes.
PAIRS = 1 << 18

# bytes of terms stay, A-Z in lower case; all else is a blank
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("total", pa.int64()), ("lengths", pa.binary()), ("terms", pa.list_(pa.struct([("term", pa.binary()), ("df", pa.int64())]))), ("docs", pa.binary()), ("tfs", pa.binary())])
INDEX = "doc_ids array<bigint>, total bigint, lengths binary, terms array<struct<term: binary, df: bigint>>, docs binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and figures of ASCII and of all that is not ASCII, only A-Z lower-cased."""
    return text.translate(_TERM).split()


class _Shard:
    """Documents and postings that are gathered for one row."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}
        self.n = 0

    def add(self, doc_id: int | None, length: int, counts: list[tuple[bytes, int]]) -> None:
        place = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        for term, tf in counts:
            held = self.postings.get(term)
            if held is None:
                held = self.postings[term] = ([], [])
            held[0].append(place)
            held[1].append(tf)
        self.n += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.n >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        each = sorted(self.postings.items())
        docs = np.concatenate([np.array(d, np.int32) for _, (d, _) in each]) if each else np.zeros(0, np.int32)
        tfs = np.concatenate([np.array(f, np.int32) for _, (_, f) in each]) if each else np.zeros(0, np.int32)
        dfs = [{"term": t, "df": len(d)} for t, (d, _) in each]
        columns = [[self.ids], [sum(self.lengths)], [np.array(self.lengths, np.int64).tobytes()], [dfs], [docs.tobytes()], [tfs.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX.types, strict=True)], schema=_INDEX)


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, name: str = "index") -> DataFrame:
    """The documents' shards, as a table in the shared folder: doc_ids, lengths (terms with repeats) and their total, terms with their counts of documents, docs and tfs (postings in order of terms).

    ``vocabulary`` (term, a string) leaves postings of other terms out; where it
    is larger than ``VOCABULARY`` bytes every term stays.  Lengths count all
    terms either way.

    Defined results: null texts, and texts without a term, are no documents; rows
    that repeat are documents each; null ids stay; the longest text is read whole.
    """
    known = None
    if vocabulary is not None:
        distinct = vocabulary.select(F.col("term").cast("binary").alias("term")).where("term is not null").distinct()
        size = distinct.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
        known = frozenset(bytes(r.term) for r in distinct.collect()) if size <= VOCABULARY else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = terms_of(text)
                    if not found:
                        continue
                    counts = Counter(found)
                    kept = list(counts.items()) if known is None else [(t, counts[t]) for t in known & counts.keys()]
                    shard.add(doc_id, len(found), kept)
                    if shard.full():
                        yield shard.row()
                        shard = _Shard()
        if shard.ids:
            yield shard.row()

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("binary").alias("text")).where("text is not null")
    return materialise(rows.mapInArrow(run, INDEX), name, compression="zstd")


class _Lists:
    """A shard's postings as a searcher sees them: scores of each posting, and the bound of each term."""

    def __init__(self, row: dict, weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.ids = row["doc_ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 10 + (90 * lengths * n_docs) // n_terms
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}
        at = 0
        for t in row["terms"]:
            lo, at = at, at + t["df"]
            w = weights.get(t["term"])
            if w:
                d, f = docs[lo:at], tfs[lo:at]
                score = w * ((1_000_000_000 * f) // (1000 * f + 8 * m[d]))
                self.lists[t["term"]] = (d, score, int(score.max()))

    def __len__(self) -> int:
        return len(self.ids)


class Best:
    """The best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def threshold(self) -> int:
        """What a document must reach: scores are above 0, and equal ones may win by their id."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, rows: list[tuple[int, int | None]]) -> None:
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def max_score(shard: _Lists, terms: list[bytes], best: Best) -> None:
    """Offers ``best`` the documents of a shard that can be among an item's best."""
    lists = sorted((shard.lists[t] for t in terms if t in shard.lists), key=lambda x: x[2])
    if not lists:
        return
    upto = np.cumsum([x[2] for x in lists])  # what a document can have from a list and all before it
    edges = [np.searchsorted(d, np.arange(0, len(shard) + BLOCK, BLOCK)) for d, _, _ in lists]
    for block in range(-(-len(shard) // BLOCK)):
        least = best.threshold()
        first = int(np.searchsorted(upto, least))  # lists before it can't lift a document to the threshold by themselves
        if first == len(lists):
            return
        scores = np.zeros(BLOCK, np.int64)
        for (d, s, _), e in zip(lists[first:], edges[first:], strict=True):
            lo, hi = e[block], e[block + 1]
            scores[d[lo:hi] - block * BLOCK] += s[lo:hi]
        found = np.flatnonzero(scores)
        for i in range(first - 1, -1, -1):
            found = found[scores[found] + upto[i] >= least]
            if not len(found):
                break
            (d, s, _), e = lists[i], edges[i]
            lo, hi = e[block], e[block + 1]
            if lo < hi:
                at = np.minimum(np.searchsorted(d[lo:hi], found + block * BLOCK), hi - lo - 1)
                hit = d[lo:hi][at] == found + block * BLOCK
                scores[found[hit]] += s[lo:hi][at[hit]]
        found = found[scores[found] >= least]
        if len(found) > best.k:  # ties with the last stay: ids decide
            found = found[scores[found] >= np.partition(scores[found], -best.k)[-best.k]]
        if len(found):
            best.offer([(int(scores[x]), shard.ids[block * BLOCK + x]) for x in found])


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    each = items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM_PATTERN})"), F.lit(1))).alias("term"))
    return each.distinct()


def search(index: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item.

    ``wanted`` has item_id and term (``query_terms``), ``index`` is from
    ``build_index``.  Items are answered in blocks of at most ``PAIRS`` pairs of
    item and term, each in one pass over the index: a task keeps the best
    documents of each item over all its shards, and the tasks' best meet in a
    window that Spark cuts before the shuffle.

    Defined results: rows of one item_id are one item, a null id too; items
    without terms, or whose terms no document has, give no rows; of equal scores
    the smaller doc_id is first, a null one last; rows that repeat rank each.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    known = materialise(index.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("t.df").alias("df")), "term-counts")
    pairs = wanted.select("item_id", F.col("term").cast("binary").alias("term")).join(known, "term")
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("item_id").rowsBetween(Window.unboundedPreceding, 0))
    parts = max(1, -(-(wanted.count()) // PAIRS))
    blocks = sizes.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))).withColumn("block", F.floor((upto - 1) / PAIRS))
    blocks = materialise(blocks.select("item_id", "part", "block"), "item-blocks")
    placed = materialise(pairs.join(blocks.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item"), "item-terms")
    out = None
    for part, block in sorted(tuple(r) for r in blocks.select("part", "block").distinct().collect()):
        terms: dict = {}
        weights: dict[bytes, int] = {}
        for r in placed.where((F.col("part") == part) & (F.col("block") == block)).toLocalIterator():
            term = bytes(r.term)
            terms.setdefault(r.item_id, []).append(term)
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        found = _searched(index, terms, weights, n_docs, n_terms, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, terms: dict, weights: dict[bytes, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in terms}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Lists(batch.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms)
                for item, own in terms.items():
                    max_score(shard, own, best[item])
        rows = [(item, doc, score) for item, b in best.items() for score, doc in b.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return index.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of all documents for each item: index and search in one; only the result's table stays."""
    spark = docs.sparkSession
    mark = intermediates(spark)
    wanted = materialise(query_terms(plain(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))), "query-terms")
    found = search(build_index(docs, wanted), wanted, k)
    out = materialise(found, "ranked", keep=True)
    drop_intermediates(spark, mark)
    return out


def oracle_sql(k: int = 10) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower.format("text")}, '{pattern}') AS w FROM documents WHERE text IS NOT NULL),
        dt AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
        s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM dt),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower.format("text")}, '{pattern}')) AS t FROM benchmark),
        p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM dt) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
        f AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t),
        sc AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY item_id, r),
        k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {k}
    """
