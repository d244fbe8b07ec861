"""Exact deduplication by composable polynomial fingerprints.

A text is hashed in chunks; hashes of neighbouring chunks combine by
length-shifted arithmetic (``hash(ab) = hash(a) * base**len(b) + hash(b)``), in
any grouping.  Texts of over ``HUGE`` bytes are cut, their chunks dealt to all
tasks and hashed there; an aggregation by row combines them.

Rows that share a fingerprint are compared chunk by chunk: an aggregation over
(fingerprint, place) keeps the least and the greatest chunk, so equal chunks
collapse where they are read and a group of copies of any size is no task's
alone.  Where the two differ the fingerprint stands for several texts, and its
group is split by SHA-256.  Texts whose fingerprint no other row has are mostly
left out of the comparison by a bitmap of at most ``BITS`` bits; those that it
lets through are compared with themselves, so it decides nothing.

Defined results.  Null text counts as empty; empty texts are equal to each
other.  A null ``doc_id`` takes part, and is kept only where no row of its group
has an id.  Rows that repeat a ``doc_id`` and text all count in ``group_size``
and, where they carry the kept id, all say ``kept``.  An empty table gives an
empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, plain, release_worker_state, rows_of

CHUNK, HUGE = 1 << 16, 1 << 22
BITS = 1 << 23
#: Two primes below 2**31 and a base for each.
PRIMES = ((1 << 31) - 1, 2147483629)
BASES = (1_000_003, 16_777_619)


@lru_cache(maxsize=4)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1) .. base**0 modulo prime; products of a power and a byte sum up to n = 2**16 without overflow."""
    out = np.ones(1, np.uint64)
    step = base % prime
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return np.ascontiguousarray(out[:n][::-1])


class Fingerprint:
    """Length and two residues of a byte string; ``a + b`` is the fingerprint of the joined strings."""

    __slots__ = ("length", "residues")

    def __init__(self, length: int = 0, residues: tuple[int, int] = (0, 0)):
        self.length, self.residues = length, residues

    @classmethod
    def of_chunk(cls, chunk: bytes) -> Fingerprint:
        data = np.frombuffer(chunk, np.uint8).astype(np.uint64)
        n = len(data)
        return cls(n, tuple(int(data @ _powers(b, p, CHUNK)[CHUNK - n :]) % p for b, p in zip(BASES, PRIMES, strict=True)))

    @classmethod
    def of(cls, data: bytes) -> Fingerprint:
        return reduce(add, map(cls.of_chunk, chunks(data)), cls())

    def __add__(self, other: Fingerprint) -> Fingerprint:
        moved = (h * pow(b, other.length, p) for h, b, p in zip(self.residues, BASES, PRIMES, strict=True))
        return Fingerprint(self.length + other.length, tuple((m + h) % p for m, h, p in zip(moved, other.residues, PRIMES, strict=True)))

    @property
    def value(self) -> int:
        return (self.residues[0] << 31) | self.residues[1]


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def chunks(data: bytes) -> Iterator[bytes]:
    return (data[at : at + CHUNK] for at in range(0, len(data), CHUNK))


_FP_DDL = "doc_id long, fp_len long, fp long, text_sha256 string"
_FP = pa.schema([("doc_id", pa.int64()), ("fp_len", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])
_PIECE_DDL = "row long, doc_id long, text_sha256 string, at long, chunk binary"
_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("at", pa.int64()), ("chunk", pa.binary())])
_HASHED_DDL = "row long, doc_id long, text_sha256 string, at long, length long, r1 long, r2 long"
_HASHED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), *((n, pa.int64()) for n in ("at", "length", "r1", "r2"))])
_HELD = pa.schema([("fp_len", pa.int64()), ("fp", pa.int64()), ("at", pa.int64()), ("chunk", pa.binary())])


def _key(fp: Fingerprint, modulus: int | None) -> tuple[int, int]:
    """Length and residues; with a modulus less, so that texts collide."""
    return (fp.length, fp.value) if modulus is None else (0, fp.value % modulus)


def _whole(modulus: int | None):
    """Fingerprints of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                data = normalised(text)
                yield doc, *_key(Fingerprint.of(data), modulus), hashlib.sha256(data).hexdigest()

        return batched(rows(), _FP)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of huge texts."""

    def rows():
        for row, doc, text in rows_of(batches, "row", "doc_id", "text"):
            data = normalised(text)
            digest = hashlib.sha256(data).hexdigest()
            yield from ((row, doc, digest, at, chunk) for at, chunk in enumerate(chunks(data)))

    return batched(rows(), _PIECE, 32)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for row, doc, digest, at, chunk in rows_of(batches, *_PIECE.names):
            fp = Fingerprint.of_chunk(chunk)
            yield row, doc, digest, at, fp.length, *fp.residues

    return batched(rows(), _HASHED)


def _combined(modulus: int | None):
    """The fingerprint of a row from those of its chunks."""

    def run(table: pa.Table) -> pa.Table:
        x = table.sort_by("at").to_pydict()
        parts = (Fingerprint(n, (a, b)) for n, a, b in zip(x["length"], x["r1"], x["r2"], strict=True))
        row = (x["doc_id"][0], *_key(reduce(add, parts, Fingerprint()), modulus), x["text_sha256"][0])
        return pa.Table.from_pylist([dict(zip(_FP.names, row, strict=True))], schema=_FP)

    return run


def fingerprints(docs: DataFrame, modulus: int | None = None) -> DataFrame:
    """doc_id, fp_len, fp, text_sha256 of every row's whole text."""
    base = plain(docs, "doc_id", "text")
    huge = F.coalesce(F.octet_length("text") > HUGE, F.lit(False))
    cut = base.where(huge).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_pieces, _PIECE_DDL)
    spread = cut.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()), "row", "at")
    combined = spread.mapInArrow(_hashed, _HASHED_DDL).groupBy("row").applyInArrow(_combined(modulus), _FP_DDL)
    return base.where(~huge).mapInArrow(_whole(modulus), _FP_DDL).unionByName(combined)


def _slot(n: int, fp: int) -> int:
    return (n * 0x9E3779B1 + fp % 4294967291) % 4294967291 % BITS


def _bitmap(groups: DataFrame) -> np.ndarray:
    """Which slots the groups' fingerprints (fp_len, fp) fall in, as bits: at most ``BITS`` of them."""
    slot = F.pmod(F.pmod(F.col("fp_len") * F.lit(0x9E3779B1) + F.pmod("fp", F.lit(4294967291)), F.lit(4294967291)), F.lit(BITS))
    words = groups.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(32)).cast("int"))).alias("bits"))
    out = np.zeros(BITS // 32, np.uint32)
    for word, bits in words.collect():
        out[word] = bits
    return out


def _in_groups(modulus: int | None, sent):
    """Chunks of the texts that may be in a group, the first with the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value

        def rows():
            for (text,) in rows_of(batches, "text"):
                data = normalised(text)
                key = _key(Fingerprint.of(data), modulus)
                slot = _slot(*key)
                if bitmap[slot >> 5] >> np.uint32(slot & 31) & 1:
                    yield *key, -1, len(data).to_bytes(8, "little")
                    yield from ((*key, at, chunk) for at, chunk in enumerate(chunks(data)))

        return batched(rows(), _HELD, 128)

    return run


def exact_groups(docs: DataFrame, modulus: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    ``modulus`` makes fingerprints collide, to test what follows then.
    """
    prints = materialise(fingerprints(docs, modulus), "exact-prints")
    key = ["fp_len", "fp"]
    # written, so that joins with it read both sides anew and can split a common key
    many = materialise(prints.groupBy(*key).agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).where("n > 1"), "exact-many")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(many))  # BITS bits
    held = plain(docs, "text").mapInArrow(_in_groups(modulus, sent), "fp_len long, fp long, at long, chunk binary")
    least_and_most = held.groupBy(*key, "at").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    split = materialise(least_and_most.where("least <> most").select(*key).distinct().withColumn("parted", F.lit(True)), "exact-split")
    if split.isEmpty():
        groups, parted = many, prints
    else:  # fingerprints that stand for several texts go apart by SHA-256
        key.append("sub")
        parted = prints.join(split, key[:2], "left").withColumn("sub", F.when(F.col("parted"), F.col("text_sha256")).otherwise(F.lit("")))
        groups = parted.groupBy(*key).agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    # the groups have a row a key, so a common key's rows can be dealt to several tasks
    out = parted.join(groups, key, "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
