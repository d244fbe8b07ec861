"""Quality by importance resampling.

Two generative models, bags of hashed n-grams, are counted: one on the target
texts (labelled of quality 1), one on the raw corpus (all rows).  A document's
log importance weight is the sum of its n-grams' log ratios.  So that documents
of all lengths are drawn alike, it is brought to the scale of ``SCALE`` n-grams;
Gumbel noise, a function of seed and ``doc_id``, is added, and the ``k`` largest
keys are selected: a sample without replacement in proportion to the scaled
weights.

N-grams are of words (one and two) and of word shapes (one to three): which
kinds of characters a word holds and whether it repeats a word just before.
Words are never cut, however long a text is.

All rows are counted in the raw model and scored.  The target model alone is
fitted on a bounded sample, at most ``TARGET`` labelled rows.

A small target must not make what it happens to lack look bad.  So a document's
own n-grams are taken out of both models when it is scored, and the target model
is smoothed towards the raw one (a Dirichlet prior as heavy as the target
itself): an n-gram without evidence in either has ratio 0.

How many are drawn is told by the labels: ``k`` defaults to the number of
documents whose mean ratio is over ``cut``, the middle of the gap between the
mean ratios of labelled texts of quality 1 and 0 (at most ``TARGET`` of each;
without texts of quality 0 it lies below the least of quality 1).  No label but
quality 1 enters a weight, and which documents make up the k is a draw: those
near the cut change places from seed to seed.

Defined results.  Null and wordless texts have weight 0 exactly, count nothing
towards ``k`` and are never selected.  Ties with the k-th key are all selected;
repeated rows have equal keys and share their fate.  Null ids share one draw of
noise and are never labelled.  A ``doc_id`` labelled twice has its larger label.
Without target rows every weight is 0 and nothing is selected; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, plain, release_worker_state, rows_of

#: Cells of the hashed n-grams, as a power of two; both models' counts, 16 MB, are sent to the tasks.
BITS = 20
#: N-grams that every document counts as when it is drawn: at 12 the noise (deviation 1.28) is worth a tenth of a mean ratio.
SCALE = 12.0
ALPHA = 0.5
#: Labelled rows of each class that the target model and the drift are fitted on at most, those of the least hash of their id.
TARGET = 20_000
SEED = 11
_BASE = np.uint64(0x100000001B3)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes and words that are looked at together.
_STRETCH, _CHUNK = 1 << 20, 1 << 18

#: Kind of each byte, as a bit.
_KIND = np.full(256, 1 << 7, np.uint16)
for _bit, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", "!?", "'\"-:;()", "|#$%&*@=+<>/\\_~^[]{}")):
    _KIND[[ord(c) for c in _chars]] = 1 << _bit
_KIND[128:] = 1 << 8


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _ODD
    x ^= x >> np.uint64(29)
    return ((x * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and kinds of characters of every word, in order."""
    hashes, kinds, open_ = [], [], 0  # open_: bytes of the last word, where a stretch ends within it
    for lo in range(0, len(data), _STRETCH):
        part = np.frombuffer(data, np.uint8, min(_STRETCH, len(data) - lo), lo)
        blank = (part == 32) | ((part >= 9) & (part <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            open_ = 0
            continue
        with np.errstate(over="ignore"):
            # sum of byte * base**position, shifted to the word: equal words have equal sums
            powers = np.cumprod(np.full(len(part), _BASE))
            prefix = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers)))
            inverse = np.cumprod(np.full(len(part), np.uint64(pow(int(_BASE), -1, 1 << 64))))
            word = (prefix[ends] - prefix[starts]) * inverse[starts]
            own = _KIND[part]
            own[blank] = 0
            kind = np.bitwise_or.reduceat(own, starts)
            length = int(ends[0])
            if open_ and starts[0] == 0:  # the rest of the word that the stretch before began
                shift = np.uint64(pow(int(_BASE), open_, 1 << 64))
                hashes[-1][-1] += shift * word[0]
                kinds[-1][-1] |= kind[0]
                length += open_
                word, kind = word[1:], kind[1:]
        if len(word):
            hashes.append(word)
            kinds.append(kind)
        if ends[-1] == len(part):
            open_ = length if len(starts) == 1 and starts[0] == 0 else int(ends[-1] - starts[-1])
        else:
            open_ = 0
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    return np.concatenate(hashes), np.concatenate(kinds)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, with repeats, some words at a time."""
    word, kind = _words((text or "").encode("utf-8", "replace"))
    with np.errstate(over="ignore"):
        shape = kind.astype(np.uint64)
        for back in (1, 2):
            shape[back:] |= np.where(word[back:] == word[:-back], np.uint64(1 << (8 + back)), np.uint64(0))
        shape = (shape + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        join = lambda a, b: a * np.uint64(31) + b
        for lo in range(0, len(word), _CHUNK):
            hi = lo + _CHUNK
            w, s = word[lo : hi + 1], shape[lo : hi + 2]
            pairs = join(s[:-1], s[1:])
            yield np.concatenate([_mix(w[:_CHUNK], 1), _mix(s[:_CHUNK], 3), _mix(join(w[:-1], w[1:]), 2), _mix(pairs[:_CHUNK], 4), _mix(join(pairs[:-1], s[2:]), 5)])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    parts = [np.unique(x, return_counts=True) for x in features(text)]
    if len(parts) == 1:
        return parts[0]
    held = np.zeros(1 << BITS, np.int64)
    for bucket, n in parts:
        held[bucket] += n
    there = np.flatnonzero(held)
    return there, held[there]


@dataclass
class Model:
    """Counts of every bucket in the raw corpus and the target, which documents are the target, and the mean ratio that parts good from bad."""

    raw: np.ndarray
    target: np.ndarray
    ids: frozenset[int]
    cut: float = 0.0

    def __post_init__(self):
        self.totals = self.raw.sum(), self.target.sum()

    def weigh(self, doc: int | None, text: str | None) -> tuple[float, int]:
        """Log weight of a text under both models without it, and the number of its n-grams."""
        bucket, n = counted(text)
        size = int(n.sum())
        if not size or not self.totals[1]:
            return 0.0, size
        own = n if doc in self.ids else 0
        raw, target = self.raw[bucket] - n, self.target[bucket] - own
        all_raw, all_target = self.totals[0] - size, self.totals[1] - (size if doc in self.ids else 0)
        share = (raw + ALPHA) / (all_raw + ALPHA * len(self.raw))
        prior = self.totals[1]
        ratio = np.log((target + prior * share) / (all_target + prior) / share)
        return float(n @ ratio), size


def _labelled(labels: DataFrame, quality: int) -> list[int]:
    """At most ``TARGET`` ids of that label."""
    known = plain(labels, "doc_id", "quality").where("quality is not null and doc_id is not null")
    own = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).where(F.col("quality") == quality)
    return [r[0] for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET).select("doc_id").collect()]


def _middle(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap that parts the classes, given by their mean ratios, with least error; each class weighs as much."""
    if not len(good):
        return 0.0
    if not len(bad):
        return float(good.min() - max(1e-3, good.max() - good.min()))
    x, y = np.concatenate((good, bad)), np.repeat((1 / len(good), -1 / len(bad)), (len(good), len(bad)))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    wrong = np.concatenate(([0.0], np.cumsum(y)))  # good texts below the cut less bad ones
    k = int(np.argmin(wrong))
    low, high = x[k - 1] if k else x[0] - 1, x[k] if k < len(x) else x[-1] + 1
    return float(low + high) / 2


def model(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models, counted in one pass over all texts, and the cut, from one over the labelled ones."""
    good = frozenset(_labelled(labels, 1))
    size = 1 << BITS
    sent = docs.sparkSession.sparkContext.broadcast(good)  # at most TARGET ids
    cells = min(size, 4_096)
    part = pa.schema([("target", pa.bool_()), ("block", pa.int32()), ("counts", pa.binary())])

    def blocks(held: dict[tuple[bool, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (target, block), counts in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], schema=part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        held = np.zeros((2, size), np.int64)
        for doc, text in rows_of(batches, "doc_id", "text"):
            bucket, n = counted(text)
            held[0, bucket] += n
            if doc in sent.value:
                held[1, bucket] += n
        each = held.reshape(2, -1, cells)
        yield from blocks({(bool(kind), int(i)): each[kind, i] for kind in (0, 1) for i in np.flatnonzero(each[kind].any(axis=1))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            for target, block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(counts, np.int64)
                held[target, block] = held[target, block] + own if (target, block) in held else own
        yield from blocks(held)

    base, kinds = plain(docs, "doc_id", "text"), "target boolean, block int, counts binary"
    counts = np.zeros((2, size // cells, cells))
    for target, block, own in base.mapInArrow(count, kinds).repartition("target", "block").mapInArrow(add, kinds).collect():  # at most 2 * 2**BITS counts
        counts[int(target), block] = np.frombuffer(own, np.int64)
    counts = counts.reshape(2, size)
    out = Model(counts[0], counts[1], good)
    if out.totals[1]:
        out.cut = _cut(base, out, frozenset(_labelled(labels, 0)))
    return out


def _cut(base: DataFrame, own: Model, bad: frozenset[int]) -> float:
    sent = base.sparkSession.sparkContext.broadcast((own, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, bad_ids = sent.value

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                weight, n = both.weigh(doc, text)
                if n:
                    yield doc, doc in bad_ids, weight / n

        return batched(rows(), pa.schema([("doc_id", pa.int64()), ("bad", pa.bool_()), ("mean", pa.float64())]))

    ids = base.sparkSession.createDataFrame([(i,) for i in own.ids | bad], "doc_id long")
    means = base.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, bad boolean, mean double")
    found = means.groupBy("doc_id", "bad").agg(F.min("mean").alias("mean")).collect()  # a row for each labelled id
    return _middle(*(np.array([r["mean"] for r in found if r["bad"] == kind]) for kind in (False, True)))


def gumbel(doc_id: int | None, seed: int = SEED) -> float:
    """A standard Gumbel draw that depends on the id and the seed only."""
    x = ((doc_id or 0) * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * odd) & (1 << 64) - 1
    x ^= x >> 31
    return float(-np.log(-np.log((x + 0.5) / (1 << 64))))


def _sortable(x: float) -> int:
    """A long that orders as the double does."""
    bits = int(np.float64(x + 0.0).view(np.int64))
    return bits if bits >= 0 else bits ^ ((1 << 63) - 1)


#: The key of what is never selected.
NEVER = -(1 << 63)


def _scored(doc: int | None, text: str | None, own: Model, seed: int) -> tuple[float, bool, int]:
    """Log weight, whether it counts towards k, and the key of a draw."""
    weight, size = own.weigh(doc, text)
    if not size or not own.totals[1]:
        return weight, False, NEVER
    return weight, weight / size > own.cut, _sortable(SCALE * weight / size + gumbel(doc, seed))


def weights(docs: DataFrame, own: Model, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, likely, key (orders as scaled weight plus noise) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(own)  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("likely", pa.bool_()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((doc, *_scored(doc, text, sent.value, seed)) for doc, text in rows_of(batches, "doc_id", "text")), schema)

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, likely boolean, key long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest ``key``, found 16 bits at a time: each step gathers at most 65,536 counts."""
    if k <= 0:
        return None
    if keys.count() <= k:
        return NEVER
    fixed, shift = None, 48
    while shift >= 0:
        digit = F.shiftright("key", shift)
        within = keys if fixed is None else keys.where(F.shiftright("key", shift + 16) == fixed)
        for prefix, n in sorted(((r[0], r[1]) for r in within.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if k <= n:
                fixed = prefix
                break
            k -= n
        shift -= 16
    return fixed


def threshold(scored: DataFrame, k: int | None = None) -> int | None:
    """The least selected key; None if nothing is."""
    least = kth_largest(scored, scored.where("likely").count() if k is None else k)
    return None if least is None else max(least, NEVER + 1)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, selected: one row per row of ``docs``."""
    scored = materialise(weights(docs, model(docs, labels), seed), "quality-weights")
    least = threshold(scored, k)
    return scored.select("doc_id", "log_weight", (F.lit(False) if least is None else F.col("key") >= least).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected rows of ``docs`` with all their columns; no row is moved between tasks."""
    own = model(docs, labels)
    least = threshold(materialise(weights(docs, own, seed), "quality-weights"), k)
    if least is None:
        return docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_scored(doc, text, sent.value, seed)[2] >= least for doc, text in rows_of(iter([batch]), "doc_id", "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
