"""Best-fit packing: documents into as few sequences of fixed size as possible.

1. Every whole text becomes ids and an end id; only documents longer than a
   sequence are cut, into full pieces and a rest.
2. The histogram of piece lengths (at most ``size`` bins) goes to the driver.
   Patterns of two and three lengths that fill a sequence exactly are
   enumerated, their repeat counts fitted to the histogram by non-negative
   least squares and rounded down; what is left is packed by best fit,
   decreasing, on counts.  The plan's size depends on ``size`` and ``PATTERNS``
   alone, not on the number of documents.
3. Pieces of a length are interchangeable, so a piece finds its place by its
   rank among those of its length: ranks are counted within salted parts of a
   length, so that a common length is no single task.

Defined results.  A null or empty text is the end id alone.  Rows that repeat a
``doc_id`` are packed each; null ids too.  Equal lengths are ranked by hash,
``doc_id``, piece.  An empty table gives an empty result.
"""

from __future__ import annotations

import array
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import gaps, pieces
from .common import batched, materialise, plain, worker_state

#: At most so many patterns are enumerated.
PATTERNS = 40_000
#: Shares of the fit that are also tried, leaving more to best fit; 0 leaves it all.
SHARES = (0.75, 0.5, 0.25, 0.0)
#: Entries of the memo of each Python worker.
MEMO = 700_000
#: Characters of the longest piece that it holds.
SHORT = 48
#: Pieces that one part of a length holds, on average.
PART = 50_000
_RANK = 40
_STOPS = ".,;:!?"


class Ids:
    """Ids of whole texts by the tokenizers library, with a bounded memo of the pieces between white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        memo = self.memo
        out, open_ = [], []
        for text in texts:
            out.append(found := list(map(memo.get, parts := pieces(_folded(text)))))
            open_ += [(found, at, parts[at]) for at in gaps(found)]
        if open_:
            fresh = self._fresh({piece for _, _, piece in open_})
            for found, at, piece in open_:
                found[at] = fresh[piece]
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
            memo |= fresh
            for piece in [p for p in fresh if len(p) > SHORT]:
                del memo[piece]
        return map(b"".join, out)

    def _fresh(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the memo lacks."""
        memo, out, stopped, wanted = self.memo, {}, [], set()
        for piece in missing:
            word = piece.rstrip(_STOPS)
            if len(word) < len(piece) and word.isalpha() and (word.isascii() or _latin(word)):
                stop = piece[len(word) :]
                stopped.append((piece, word, stop))  # the ids of the word, then those of the stop
                for part in (word, stop):
                    if (known := memo.get(part)) is None:
                        wanted.add(part)
                    else:
                        out[part] = known
            else:
                wanted.add(piece)
        words, rest = [], []
        for p in wanted:
            (words if p.isalpha() else rest).append(p)
        for at in range(0, len(words), 4096):  # words are told apart by the ids that end a word
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends_at = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends_at) != len(some):
                rest += some
                continue
            data = ids.tobytes()
            out |= zip(some, map(data.__getitem__, map(slice, [0, *ends_at[:-1]], ends_at)), strict=True)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[piece] = array.array("I", found.ids).tobytes()
        for piece, word, stop in stopped:
            out[piece] = out[word] + out[stop]
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _folded(text: str) -> str:
    """In lower case where that can't change the ids: the file lower-cases too, and Latin-1 characters one by one."""
    return text.lower() if _latin(text) else text


def cut(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_state(("packing", path), lambda: Ids(path))

        def rows():
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    docs, texts = (batch.column(c).slice(lo, 128).to_pylist() for c in ("doc_id", "text"))
                    for doc, data in zip(docs, ids.of([t or "" for t in texts]), strict=True):
                        data += end.to_bytes(4, "little")
                        for piece, at in enumerate(range(0, len(data), 4 * size)):
                            part = data[at : at + 4 * size]
                            yield doc, piece, at // 4, len(part) // 4, zlib.crc32(part)

        return batched(rows(), schema)

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Patterns (lengths of a sequence, in order) and how often each is used."""

    patterns: list[tuple[int, ...]]
    repeats: list[int]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length and first rank), first sequence and offset of each run of ranks."""
        used: dict[int, int] = {}
        rows, first = [], 0
        for pattern, n in zip(self.patterns, self.repeats, strict=True):
            offset = 0
            for length in pattern:
                rank = used.get(length, 0)
                rows.append((length << _RANK | rank, first, offset))
                used[length] = rank + n
                offset += length
            first += n
        rows.sort()
        return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3


def enumerate_patterns(counts: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that sum to ``size``, those of the commonest lengths first."""
    there = [int(x) for x in np.nonzero(counts)[0] if 0 < x < size]
    out = [(size - a, a) for a in there if 2 * a <= size and counts[size - a] and (2 * a < size or counts[a] > 1)]
    common = sorted(there, key=lambda x: -counts[x])[: max(1, int((3 * PATTERNS) ** 0.5))]
    triples = []
    for k, a in enumerate(common):
        for b in common[k:]:
            c = size - a - b
            if c > 0 and counts[c]:
                triples.append(tuple(sorted((a, b, c), reverse=True)))
    triples = sorted(set(triples), key=lambda t: (-min(counts[x] for x in t), t))
    return out + triples[: max(0, PATTERNS - len(out))]


def fit_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeats x with A x near the histogram."""
    n, bins = len(patterns), len(counts)
    if not n:
        return np.zeros(0)
    rows = np.fromiter((x for p in patterns for x in p), np.int64)
    cols = np.repeat(np.arange(n), [len(p) for p in patterns])
    times = lambda x: np.bincount(rows, x[cols], bins)
    weigh = (np.arange(bins) / bins) ** 2  # long pieces are hard to place, so they are fitted first
    back = lambda r: np.bincount(cols, (r * weigh)[rows], n)
    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 0.95 / max(1e-9, float(v @ back(times(v))))
    h = counts.astype(np.float64)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - h))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: bins with equal content are handled together."""
    spaces: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    for length in range(size, 0, -1):
        left = int(counts[length])
        if not left:
            continue
        for space in range(length, size):
            if not left:
                break
            for pattern in list(spaces[space]):
                if not left:
                    break
                there = spaces[space].pop(pattern)
                many = space // length  # the same bin stays the best fit while the length fits
                full = min(there, left // many)
                rest = there - full
                if full:
                    _add(spaces[space - many * length], pattern + (length,) * many, full)
                    left -= full * many
                if rest and 0 < left < many:
                    _add(spaces[space - left * length], pattern + (length,) * left, 1)
                    rest, left = rest - 1, 0
                if rest:
                    _add(spaces[space], pattern, rest)
        if left:
            many = size // length
            if full := left // many:
                _add(spaces[size - many * length], (length,) * many, full)
            if some := left % many:
                _add(spaces[size - some * length], (length,) * some, 1)
    return [(p, n) for bins in spaces for p, n in bins.items()]


def _add(bins: dict, pattern: tuple[int, ...], n: int) -> None:
    bins[pattern] = bins.get(pattern, 0) + n


def plan(counts: np.ndarray, size: int = 2048) -> Plan:
    """A plan that uses every piece of the histogram exactly once: of several roundings of the fit the one with fewest sequences."""
    patterns = enumerate_patterns(counts, size)
    inner = counts.astype(np.int64).copy()
    inner[size] = 0
    fitted = fit_counts(patterns, inner)
    tries = [(1, 0), (1, 1), (1, 2), *((share, 0) for share in SHARES)]
    return min((_rounded(counts, size, patterns, share * fitted, effort) for share, effort in tries), key=lambda p: sum(p.repeats))


def _rounded(counts: np.ndarray, size: int, patterns: list[tuple[int, ...]], fitted: np.ndarray, effort: int) -> Plan:
    """Repeats rounded down; with effort 1 also up where pieces are left, with 2 as often as they are left; the rest by best fit."""
    left = counts.astype(np.int64).tolist()
    out = Plan([], [])

    def take(pattern: tuple[int, ...], n: int) -> None:
        for x in pattern:
            n = min(n, left[x] // pattern.count(x))
        if n > 0:
            for x in pattern:
                left[x] -= n
            out.patterns.append(pattern)
            out.repeats.append(n)

    take((size,), left[size])
    for i in np.argsort(-fitted, kind="stable").tolist():
        if (n := int(fitted[i])) < 1:
            break
        take(patterns[i], n)
    if effort:
        for i in np.argsort(-(fitted % 1), kind="stable").tolist():
            take(patterns[i], 1)
    if effort > 1:
        for pattern in patterns:
            take(pattern, 1 << 62)
    for pattern, n in best_fit(np.array(left, np.int64), size):
        out.patterns.append(pattern)
        out.repeats.append(n)
    return out


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cuts = materialise(cut(docs, path, size, end), "packing-pieces")
    histogram = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    sent = spark.sparkContext.broadcast(plan(counts, size).places())
    # a length is dealt to as many parts as its own count asks for
    parts = F.element_at(F.array(*[F.lit(int(-(-n // PART)) or 1) for n in counts]), F.col("length").cast("int") + 1)
    salted = cuts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts).cast("int"))
    below = (
        salted.groupBy("length", "part").count()
        .withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
        .select("length", "part", "base")
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(below, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offsets = sent.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            wanted = length << _RANK | rank
            at = np.searchsorted(keys, wanted, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(first[at] + wanted - keys[at]), pa.array(offsets[at])], names=[*cols, "sequence_id", "offset"])

    return ranked.select(*cols, "rank").mapInArrow(place, schema)
