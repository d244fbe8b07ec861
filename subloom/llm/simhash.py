"""SimHash fingerprints, and near duplicates by pivot distance tables.

A fingerprint bit is 1 where over half of a text's word shingles have it set in
their XXH64 (seed 42).  Two fingerprints are linked at ``radius`` or fewer
differing bits.

The search is exact.  The 64 bits are cut into ``blocks``; fingerprints within
``radius`` agree in at least ``blocks - radius`` of them, so each pair meets
under a key of ``blocks - radius`` whole blocks.  Within a key's group every
fingerprint has a row of a pivot table, its Hamming distances to reference
fingerprints.  By the triangle inequality a pair whose rows differ by more than
``radius`` in some coordinate is no link and is discarded unseen; survivors are
verified.  A group gives a spanning forest of its links, not its pairs.  Groups
of over ``GROUP`` are keyed again, by bits that their key left free, until none
is larger (fingerprints are distinct, so few are left under nearly all bits);
that loses no pair.

Equal fingerprints are one node, so groups of copies cost nothing.

Defined results.  Null and wordless texts have fingerprint zero and are linked
like any other.  Rows that repeat a ``doc_id`` each give a row.  A null
``doc_id`` has a fingerprint and the component of its fingerprint, but names
none.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, plain, release_worker_state, rows_of
from .components import components

SEED = 42
PIVOTS = 16
#: Above so many fingerprints a key's group is keyed again.
GROUP = 4096
_SIDE = 1024


def _shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, k = xxhash.xxh64_intdigest, min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - k + 1)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits, highest first, that are set in over half of the hashes."""
    hashes = hashes.astype(">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return counts * 2 > len(hashes)


def simhash(text: str | None, words_per_shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    return int.from_bytes(np.packbits(_majority(_shingle_hashes(text, words_per_shingle))).tobytes(), "big")


def wide(hashes: np.ndarray, width: int = 4) -> np.ndarray:
    """``width`` fingerprints as 64-bit words, by hash functions that are told apart by an odd factor; the first is the simhash."""
    out = []
    for word in range(width):
        own = hashes
        if word:
            own = (hashes ^ np.uint64(word)) * np.uint64(0x9E3779B97F4A7C15 + 2 * word)
            own = (own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            own ^= own >> np.uint64(32)
        out.append(np.packbits(_majority(own)).view(">u8"))
    return np.concatenate(out).astype(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        return batched(((doc, _signed(simhash(text, words_per_shingle))) for doc, text in rows_of(batches, "doc_id", "text")), schema)

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` of ``blocks`` even cuts of ``bits``."""
    cuts = [sum(1 << b for b in part.tolist()) for part in np.array_split(bits, blocks)]
    return [sum(choice) for choice in combinations(cuts, agree)]


def _keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """t, k, fp, node: each node under each mask (t), with its bits there (k)."""
    key = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks)]
    return nodes.select("fp", "node", F.explode(F.array(*key)).alias("x")).select("x.*", "fp", "node")


def pivots(n: int = PIVOTS, width: int = 1) -> np.ndarray:
    """Reference fingerprints: fixed, spread over the space; a row each."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (n, width), np.uint64, endpoint=False)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which are the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each fingerprint."""
    return np.stack([distance(fps, ref) for ref in refs], axis=1)


def forest(fps: np.ndarray, radius: int, refs: np.ndarray) -> np.ndarray:
    """For each of distinct fingerprints (rows) the index of a fingerprint that it is joined to by links, itself a fixed point."""
    order = np.argsort(distance(fps, refs[0]), kind="stable")
    fps = fps[order]
    table = pivot_table(fps, refs)
    first, root = table[:, 0], np.arange(len(fps))
    for lo in range(0, len(fps), _SIDE):
        hi = min(lo + _SIDE, len(fps))
        end = int(np.searchsorted(first, first[hi - 1] + radius, "right"))
        for other in range(lo, end, _SIDE):
            to = min(other + _SIDE, end)
            i, j = np.nonzero(np.abs(first[lo:hi, None] - first[None, other:to]) <= radius)
            i, j = i + lo, j + other
            ahead = i < j
            i, j = i[ahead], j[ahead]
            for p in range(1, table.shape[1]):
                if not len(i):
                    break
                near = np.abs(table[i, p] - table[j, p]) <= radius
                i, j = i[near], j[near]
            near = distance(fps[i], fps[j]) <= radius
            i, j = i[near], j[near]
            while len(i):
                low = np.minimum(root[i], root[j])
                if (root[i] == low).all() and (root[j] == low).all():
                    break
                for end_of in (i, j):
                    np.minimum.at(root, root[end_of], low)
                    np.minimum.at(root, end_of, low)
                while (jumped := root[root]).tolist() != root.tolist():
                    root = jumped
    out = np.empty(len(fps), np.int64)
    out[order] = order[root]
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _group_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()

        def rows():
            for _, group in groupby(rows_of(batches, "t", "k", "fp", "node"), key=lambda r: r[:2]):
                fps, nodes = zip(*(r[2:] for r in group), strict=True)
                if len(fps) > 1:
                    to = forest(np.array(fps, np.int64).view(np.uint64)[:, None], radius, refs)
                    yield from ((nodes[i], nodes[j]) for i, j in enumerate(to.tolist()) if i != j)

        return batched(rows(), _LINK)

    return run


def links(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """a, b: links that join exactly the nodes (fp, node; fp distinct) within ``radius`` of each other.

    Groups of over ``GROUP`` are keyed again by ``radius + 2`` cuts of the bits
    that their key left free, two of which a pair within the radius must share;
    then once more, as long as enough bits are free to cut.
    """
    masks = _masks(list(range(64)), blocks, blocks - radius)
    members, large = _keyed(nodes, masks), F.col("count") > GROUP
    key, run, out = ["t", "k"], _group_links(radius), None
    while True:
        sizes = materialise(members.groupBy(*key).count().where("count > 1"), "simhash-groups")
        shared = members.join(sizes, key)
        free = [[b for b in range(64) if not m >> b & 1] for m in masks]
        last = min(map(len, free)) < 2 * (radius + 2) or sizes.where(large).isEmpty()
        small = (shared if last else shared.where(~large)).select(*key, "fp", "node")
        found = small.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        # a mask of the next level is one of this level and two cuts of the bits that it left free
        finer = [[m | extra for extra in _masks(bits, radius + 2, 2)] for m, bits in zip(masks, free, strict=True)]
        many = len(finer[0])
        masks = [m for group in finer for m in group]
        each = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("i")
        own = shared.where(large).select("fp", "node", "t", each).select("fp", "node", (F.col("t") * many + F.col("i")).alias("t"))
        members = materialise(own.select("t", F.col("fp").bitwiseAND(F.get(F.lit([_signed(m) for m in masks]), F.col("t"))).alias("k"), "fp", "node"), "simhash-members")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints = materialise(fingerprints(docs, words_per_shingle), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(links(nodes.where("node is not null"), radius, blocks), "a", "b")
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
