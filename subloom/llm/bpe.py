"""Byte-pair encoding of whole texts, and its inverse.

A word is a doubly linked list of symbols.  A priority queue holds the ranks of
adjacent pairs; a popped entry whose symbols have changed since it was pushed is
stale and skipped.  Decoding concatenates vocabulary strings.

The tokenizer file fixes vocabulary, merges and the pre-tokenizer's pattern; it
is read by the executors from ``path`` and never copied.  Of normalisers only
that of the kind "BPE with word ends" is known: NFC, then lower case, one
character at a time; white space parts words.  White space always parts
words, so texts are encoded piece by piece between white space and a bounded
memo holds the pieces met before; it only saves time.

Defined results.  A null text is empty: no ids, empty decoded text.  Texts of
any length are encoded whole.  Rows are independent, so ties, repeated rows and
null ids need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batched, plain, rows_of, worker_state

MEMO = 500_000
#: Characters of the longest piece that the memo holds.
SHORT = 48
#: What \s matches in the file's white space rule; str.split() also parts at U+001C to U+001F, which it does not match.
_ODD = tuple(map(chr, range(0x1C, 0x20)))
_SPACE = re.compile("[" + "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")


def pieces(text: str) -> list[str]:
    """The runs between white space."""
    return [p for p in _SPACE.split(text) if p] if any(c in text for c in _ODD) else text.split()


def gaps(found: list) -> Iterator[int]:
    """Where a list holds None."""
    at = -1
    try:
        while True:
            yield (at := found.index(None, at + 1))
    except ValueError:
        return


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else one from U+0100 on, in order."""
    plain_bytes = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain_bytes else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encoder and decoder of one tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.strings = {i: s for s, i in self.ids.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.suffix] for s in symbols]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        data = word.encode("utf-8")
        sym = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(sym)
        if n == 1:
            return sym
        ranks = self.ranks
        right = [*range(1, n), -1]
        left = [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if (found := ranks.get((sym[i], sym[i + 1]))) is not None:
                queue.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, a, b, merged = pop(queue)
            if sym[i] != a or (j := right[i]) < 0 or sym[j] != b:
                continue  # stale: a symbol has merged since
            sym[i], sym[j] = merged, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (found := ranks.get((merged, sym[k]))) is not None:
                    push(queue, (found[0], i, merged, sym[k], found[1]))
            if (h := left[i]) >= 0 and (found := ranks.get((sym[h], merged))) is not None:
                push(queue, (found[0], h, sym[h], merged, found[1]))
        return [s for s in sym if s >= 0]

    def piece(self, piece: str) -> list[int]:
        """Ids of a run without white space."""
        out: list[int] = []
        for part in self.split_added.split(piece) if self.split_added and "<" in piece else [piece]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = part.lower() if part.isascii() else "".join(map(str.lower, part))
                for word in self.words(part):
                    out += self.word(word)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo = self.memo
        found = list(map(memo.get, parts := pieces(text)))
        for at in gaps(found):
            piece = parts[at]
            if (known := memo.get(piece)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                known = array.array("I", self.piece(piece)).tobytes()
                if len(piece) <= SHORT:
                    memo[piece] = known
            found[at] = known
        return b"".join(found)

    def decode(self, ids) -> str:
        """Vocabulary strings, joined by a space: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept in the Python worker."""
    return worker_state(("bpe", path), lambda: Encoder(path))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every whole text, then decodes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                data = enc.encode(text or "")
                decoded = enc.decode(memoryview(data).cast("I")).encode("utf-8")
                yield doc, len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return batched(rows(), _OUT)

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int): the encoding itself."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        return batched(((doc, memoryview(enc.encode(text or "")).cast("I").tolist()) for doc, text in rows_of(batches, "doc_id", "text")), schema, 256)

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
