"""From observations to subtitle blocks: sessions, votes and the neighbour filter."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.core import ladder
from ..functions.scripts import CYRILLIC, Script
from ..functions.similarity import ratio

VOTE_SIMILARITY, NEIGHBOUR_SIMILARITY, DEEP_SIMILARITY = 0.82, 0.55, 0.78


def blocks_of_equal(observations: DataFrame, max_gap: float = 1.2, min_duration: float = 0.7, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Blocks where only equal texts join: an offset, a running count and one aggregation (W3 with exact texts, W4).

    The gap is measured from the running latest end, within the run of equal
    texts.  The result equals the fold's wherever different texts are less alike
    than its threshold.
    """
    w = Window.partitionBy("video_id").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    texts = observations.withColumn("_t", (~F.lag("text").over(w).eqNullSafe(F.col("text"))).cast("int")).withColumn("_run", F.sum("_t").over(run))
    in_run = Window.partitionBy("video_id", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.col("time") - F.max("end").over(in_run) > max_gap, F.lit(True))
    parted = texts.withColumn("_b", broken.cast("int")).withColumn("_block", F.sum("_b").over(run))
    grouped = parted.groupBy("video_id", "_block").agg(
        F.min("time").alias("start"), F.max("end").alias("_end"), F.first("text").alias("text"), F.max("score").alias("score"), F.max("confidence").alias("confidence"), F.count("*").alias("readings")
    )
    return grouped.select(
        "video_id", F.col("_block").cast("int").alias("block_no"), "start", F.greatest("_end", F.col("start") + min_duration).alias("end"), "text", "score", "confidence", "readings"
    )


@dataclass(frozen=True)
class Group:
    """Readings that say the same, as one record; a reading is a group of one."""

    key: str
    text: str
    count: int
    confidence: float
    score: float

    def rank(self) -> tuple:
        """The rule of every vote: most readings, then confidence, score and length."""
        return self.count, self.confidence, self.score, len(self.text)


@lru_cache(maxsize=1 << 14)
def likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def joined(groups: list[Group], new: Group, alike: float, merge: Callable[[Group, Group], Group]) -> list[Group]:
    """The groups after a reading: merged into the first whose key is as like as ``alike``, or one more."""
    for i, g in enumerate(groups):
        if new.key == g.key or likeness(new.key, g.key) >= alike:
            return [*groups[:i], merge(g, new), *groups[i + 1 :]]
    return [*groups, new]


def winner(groups: list[Group]) -> Group:
    """The highest rank; of equal ones the group that came first."""
    return max(groups, key=Group.rank)


def block_reading(text: str, key: str, score: float, confidence: float, suspicious: bool) -> Group:
    """A reading as it votes for a block's text: doubt costs points."""
    return Group(key, text, 1, max(0.0, confidence), max(0.0, score + (-12.0 if suspicious else 8.0)))


def keep_first_key(suspicious: bool) -> Callable[[Group, Group], Group]:
    """Merging for blocks: the first key leads; a longer text that is beyond doubt and nearly as confident takes over."""

    def merge(g: Group, r: Group) -> Group:
        confidence = max(g.confidence, r.confidence)
        better = not suspicious and len(r.text) > len(g.text) and r.confidence >= 0.80 * confidence
        return Group(g.key, r.text if better else g.text, g.count + r.count, confidence, max(g.score, r.score))

    return merge


def keep_best_score(g: Group, r: Group) -> Group:
    """Merging for repeated readings of a frame: the best-scored reading leads."""
    lead = r if r.score > g.score else g
    return Group(lead.key, lead.text, g.count + r.count, max(g.confidence, r.confidence), lead.score)


class Session:
    """The block that is being built; ``add`` gives a finished one when the next reading doesn't join it.

    It holds groups, not readings: ``state`` and ``restored`` carry it between
    the batches of a stream.
    """

    def __init__(self, max_gap: float, similarity: float, min_duration: float):
        self.max_gap, self.similarity, self.min_duration = max_gap, similarity, min_duration
        self.groups: list[Group] = []
        self.keys: dict[str, str] = {}
        self.start, self.end, self.readings = 0.0, 0.0, 0

    @staticmethod
    def alike(a: str, key_a: str, b: str, key_b: str) -> float:
        return likeness(key_a, key_b) if key_a and key_b else likeness(a, b)

    def joins(self, time: float, text: str, key: str) -> bool:
        w = winner(self.groups)
        return time - self.end <= self.max_gap and self.alike(w.text, self.keys[w.text], text, key) >= self.similarity

    def add(self, time: float, end: float, text: str, key: str, score: float, confidence: float, suspicious: bool) -> dict | None:
        done = self.finish() if self.groups and not self.joins(time, text, key) else None
        if not self.groups:
            self.start, self.end, self.keys, self.readings = time, end, {}, 0
        self.end = max(self.end, end)
        self.readings += 1
        self.keys[text] = key
        self.groups = joined(self.groups, block_reading(text, key or text, score, confidence, suspicious), VOTE_SIMILARITY, keep_first_key(suspicious))
        self.keys = {g.text: self.keys[g.text] for g in self.groups}
        return done

    def finish(self) -> dict | None:
        if not self.groups:
            return None
        w, self.groups = winner(self.groups), []
        return {"start": self.start, "end": max(self.end, self.start + self.min_duration), "text": w.text, "score": w.score, "confidence": w.confidence, "readings": self.readings}

    def state(self) -> dict | None:
        return {"start": self.start, "end": self.end, "readings": self.readings, "keys": self.keys, "groups": [astuple(g) for g in self.groups]} if self.groups else None

    def restored(self, state: dict | None) -> Session:
        if state:
            self.start, self.end, self.readings, self.keys = state["start"], state["end"], state["readings"], state["keys"]
            self.groups = [Group(*g) for g in state["groups"]]
        return self


def fold_blocks(rows: Iterable, max_gap: float, similarity: float, min_duration: float) -> Iterator[dict]:
    """Blocks of readings (time, end, text, key, score, confidence, suspicious) in order."""
    session = Session(max_gap, similarity, min_duration)
    for r in rows:
        if (done := session.add(*r)) is not None:
            yield done
    if (last := session.finish()) is not None:
        yield last


def prepared(observations: DataFrame, script: Script = CYRILLIC) -> DataFrame:
    """Adds what the fold needs of a text: its merge key, and whether it is suspicious. Both stay in the JVM."""
    return observations.withColumns({"key": T.merge_key(F.col("text")), "suspicious": F.size(T.noise_reasons(F.col("text"), script)) > 0})


def gap_islands(rows: DataFrame, max_gap: float) -> DataFrame:
    """Adds ``island``: readings of a video with different ones never share a block.

    A reading that comes more than ``max_gap`` after the latest end of all before
    it begins a block whatever the votes say, so the fold may be cut there.  The
    latest end is carried over cells of time: each cell's own is one partial
    aggregate, a window over a video's cells carries them on, and the rows are
    looked at cell by cell, so that one long video is spread over all tasks.  An
    island's name is the time at which it began.
    """
    width = max(60.0, 64 * max_gap)
    df = rows.withColumn("_cell", F.floor(F.col("time") / width))
    before = Window.partitionBy("video_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy("video_id", "_cell").agg(F.max("end").alias("_end"), F.min("time").alias("_first"))
    carried = cells.select("video_id", "_cell", F.max("_end").over(before).alias("_until"))
    own = Window.partitionBy("video_id", "_cell").orderBy("time", "frame_id")
    df = df.join(carried, ["video_id", "_cell"])
    until = F.greatest("_until", F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_start", F.when(F.coalesce(F.col("time") - until > max_gap, F.lit(True)), F.col("time"))).drop("_until")
    starts = df.groupBy("video_id", "_cell").agg(F.max("_start").alias("_last"))
    latest = starts.select("video_id", "_cell", F.max("_last").over(before).alias("_before"))
    island = F.greatest("_before", F.max("_start").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(latest, ["video_id", "_cell"]).withColumn("island", island).drop("_cell", "_start", "_before")


_FOLDED = pa.schema([("video_id", pa.string()), ("island", pa.float64()), ("k", pa.int32()), ("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("score", pa.float64()), ("confidence", pa.float64()), ("readings", pa.int32())])


def build_blocks(observations: DataFrame, max_gap: float = 1.2, similarity: float = 0.86, min_duration: float = 0.7, script: Script = CYRILLIC) -> DataFrame:
    """Blocks of similar consecutive readings, with voted texts.

    The text that the next reading is held against depends on all votes so far,
    so readings are folded in order, each island by itself; a task holds one open
    block's votes and nothing else.  Readings without a time make no block.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, session, k, out = None, Session(max_gap, similarity, min_duration), 0, []

        def give(done: dict | None) -> None:
            nonlocal k
            if done is not None:
                k += 1
                out.append((*at, k, done["start"], done["end"], done["text"], done["score"], done["confidence"], done["readings"]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOLDED.types, strict=True)], schema=_FOLDED)

        for batch in batches:
            for video, island, *r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (video, island) != at:
                    give(session.finish())
                    at, session, k = (video, island), Session(max_gap, similarity, min_duration), 0
                give(session.add(*r))
            if len(out) >= 1_000:
                yield batch_of(out)
                out.clear()
        give(session.finish())
        if out:
            yield batch_of(out)

    ready = gap_islands(prepared(observations, script).select("video_id", "frame_id", "time", "end", "text", "key", "score", "confidence", "suspicious").where("time is not null"), max_gap)
    ready = ready.repartition("video_id", "island").sortWithinPartitions("video_id", "island", "time", "frame_id").select("video_id", "island", "time", "end", "text", "key", "score", "confidence", "suspicious")
    made = ready.mapInArrow(fold, "video_id string, island double, k int, start double, `end` double, text string, score double, confidence double, readings int")
    w = Window.partitionBy("video_id").orderBy("island", "k")
    return made.select("video_id", F.row_number().over(w).alias("block_no"), "start", "end", "text", "score", "confidence", "readings")


def neighbour_filter(blocks: DataFrame, script: Script = CYRILLIC) -> DataFrame:
    """Drops suspicious blocks without a similar neighbour that is not short noise.

    Neighbours come from the unfiltered order.  Similarity is computed for
    suspicious blocks only.
    """
    w = Window.partitionBy("video_id").orderBy("block_no")
    df = blocks.withColumns({"_short": T.is_short_noise(F.col("text"), script), "_key": T.merge_key(F.col("text"))})
    df = df.withColumn("_sus", F.col("_short") | T.is_fragment_noise(F.col("text"), script))
    for side, move in (("p", F.lag), ("n", F.lead)):
        usable = ~move("_short").over(w) & (move("_key").over(w) != "") & (F.col("_key") != "")
        df = df.withColumn(f"_{side}", F.when(F.col("_sus") & F.coalesce(usable, F.lit(False)), move("_key").over(w)))
    sus = df.where("_sus").withColumn("_r", F.greatest(F.coalesce(ratio(F.col("_key"), F.col("_p")), F.lit(0.0)), F.coalesce(ratio(F.col("_key"), F.col("_n")), F.lit(0.0))))
    kept = df.where("not _sus").unionByName(sus.where(F.col("_r") >= NEIGHBOUR_SIMILARITY).drop("_r"))
    return kept.select(*blocks.columns)


def cleanup_blocks(blocks: DataFrame, allow_drop: bool = True, script: Script = CYRILLIC) -> DataFrame:
    """Tidied texts; blocks that become empty go."""
    return blocks.withColumn("text", T.heuristic_cleanup(F.col("text"), allow_drop, script)).where("text <> ''")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], size: int = 1_000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def block_votes(observations: DataFrame, keys: list[str], script: Script = CYRILLIC) -> DataFrame:
    """The voted text of each group of readings (A15); a task holds one group's votes, not its readings."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in observations.select(*keys).schema)
    ready = prepared(observations, script).select(*keys, "time", "frame_id", "text", "key", "score", "confidence", "suspicious")
    kinds = [to_arrow_type(f.dataType) for f in observations.select(*keys).schema]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def voted() -> Iterator[tuple]:
            for key, rows in groupby(_rows(batches), lambda r: r[: len(keys)]):
                groups: list[Group] = []
                for *_, text, merged, score, confidence, suspicious in rows:
                    groups = joined(groups, block_reading(text, merged or text, score, confidence, suspicious), VOTE_SIMILARITY, keep_first_key(suspicious))
                w = winner(groups)
                yield (*key, w.text, w.count, len(groups), w.score, w.confidence)

        yield from _batches(voted(), [*kinds, pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()], [*keys, "text", "votes", "groups", "score", "confidence"])

    dealt = ready.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "time", "frame_id")
    return dealt.mapInArrow(fold, f"{schema}, text string, votes int, groups int, score double, confidence double")


def deep_vote(votes: DataFrame, script: Script = CYRILLIC, limit: int = 24) -> DataFrame:
    """video_id, frame_id, text, confidence, outcome from repeated readings of a frame and its neighbours.

    Needs video_id, frame_id, neighbour_rank, variant_rank, text, confidence.
    The first ``limit`` votes are grouped by likeness to a group's leader, its
    best-scored member so far; the largest, most confident group wins, and a
    ladder of outcomes says whether its text counts.
    """
    w = Window.partitionBy("video_id", "frame_id").orderBy("neighbour_rank", "variant_rank")
    t = F.col("text")
    ready = votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    ready = ready.select("video_id", "frame_id", "rank", "text", "confidence", T.merge_key(t).alias("key"), T.candidate_score(t, F.col("confidence"), script).alias("score"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def voted() -> Iterator[tuple]:
            for key, rows in groupby(_rows(batches), lambda r: r[:2]):
                groups: list[Group] = []
                for *_, text, confidence, merged, score in rows:
                    if text:
                        groups = joined(groups, Group(merged, text, 1, confidence, score), DEEP_SIMILARITY, keep_best_score)
                best = winner(groups) if groups else Group("", "", 0, 0.0, 0.0)
                yield (*key, best.text, best.confidence, best.count)

        yield from _batches(voted(), [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32()], ["video_id", "frame_id", "text", "confidence", "votes"])

    ready = ready.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_id").cast("string").alias("frame_id"), "rank", "text", "confidence", "key", "score")
    dealt = ready.repartition("video_id", "frame_id").sortWithinPartitions("video_id", "frame_id", "rank")
    won = dealt.mapInArrow(fold, "video_id string, frame_id string, text string, confidence double, votes int")
    won = won.withColumn("_n", T.noise_reasons(t, script))
    why = lambda default: F.when(F.size("_n") > 0, F.array_join("_n", ",")).otherwise(F.lit(default))
    outcome = ladder(
        (F.col("votes") == 0, "deep_no_text"),
        (~T.is_acceptable_recovery(t, script), F.concat(F.lit("deep_rejected_language_validity:"), why("no_common_word"))),
        (F.col("votes") >= 2, "deep_vote"),
        (T.is_valid_short(t, script), "deep_valid_short"),
        ((F.size("_n") == 0) & (F.char_length(T.meaningful(t)) >= 4), "deep_single_valid"),
        otherwise=F.concat(F.lit("deep_unconfirmed_noise:"), why("unknown")),
    )
    won = won.withColumn("outcome", outcome)
    counts = F.col("outcome").isin("deep_vote", "deep_valid_short", "deep_single_valid")
    return won.select("video_id", "frame_id", F.when(counts, t).otherwise(F.lit("")).alias("text"), F.when(counts, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"), "outcome")
