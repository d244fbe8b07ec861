"""Blocks from streams of readings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import CYRILLIC, Script
from ..operators.blocks import Session, prepared
from ..operators.candidates import Gate
from ..schema import BLOCKS
from .ordered import OrderedFold, folded


def gap_sessions(readings: DataFrame, gap: str, keys: list[str], delay: str | None = None, ts: str = "ts") -> DataFrame:
    """Sessions by time alone; readings exactly a gap apart join (X1). ``delay`` admits late rows and bounds the state."""
    if delay is not None:
        readings = readings.withWatermark(ts, delay)
    out = readings.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("readings"), F.max("confidence").alias("confidence"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "readings", "confidence")


_FIELDS = ["time", "end", "text", "key", "score", "confidence", "suspicious"]


class _Sessions(OrderedFold):
    waiting = "micros long, time double, frame_id string, end double, text string, `key` string, score double, confidence double, suspicious boolean"
    held = "seen double, no int, start double, end double, readings int, groups array<struct<`key`: string, text: string, n: int, confidence: double, score: double, own: string>>"
    out = ["video_id", "block_no", "start", "end", "text", "score", "confidence", "readings"]

    def __init__(self, max_gap: float, similarity: float, min_duration: float, slot: float, keep: float):
        super().__init__(slot, keep)
        self.max_gap, self.rule = max_gap, (max_gap, similarity, min_duration)

    def _session(self, held: tuple | None) -> tuple[Session, float, int]:
        session = Session(*self.rule)
        if held is None:
            return session, 0.0, 0
        seen, no, start, end, readings, groups = held
        if groups:
            session.restored({"start": start, "end": end, "readings": readings, "keys": {g[1]: g[5] for g in groups}, "groups": [tuple(g)[:5] for g in groups]})
        return session, seen, no

    @staticmethod
    def _held(session: Session, seen: float, no: int) -> tuple:
        groups = [(g.key, g.text, g.count, g.confidence, g.score, session.keys[g.text]) for g in session.groups]
        return seen, no, session.start, session.end, session.readings, groups

    def fold(self, held: tuple | None, rows: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
        session, seen, no = self._session(held)
        given = []
        for micros, time, _, end, *rest in rows:
            if (b := session.add(time, end, *rest)) is not None:
                seen, no = 0.0, no + 1
                given.append((no, *b.values()))
            seen = max(seen, micros / 1e6 + (end - time))  # the block's end on the clock of ``ts``
        return self._held(session, seen, no), given

    def until(self, held: tuple | None) -> float | None:
        return held[0] + self.max_gap if held is not None and held[5] else None

    def joins(self, held: tuple, row: tuple) -> bool:
        return row[1] - held[3] <= self.max_gap

    def finish(self, held: tuple) -> tuple[tuple, list[tuple]]:
        session, _, no = self._session(held)
        return (0.0, no + 1, 0.0, 0.0, 0, []), [(no + 1, *session.finish().values())]


def content_sessions(
    readings: DataFrame, delay: str = "10 seconds", max_gap: float = 1.2, similarity: float = 0.86, min_duration: float = 0.7, script: Script = CYRILLIC, keep: float = 3600.0, slot: float = 10.0, lanes: int | None = None
) -> DataFrame:
    """The batch fold's blocks from a stream (X2). Needs ``ts`` (event time) beside a reading's columns, and the RocksDB state store.

    A video's state is its open block's groups of votes and what waits behind
    the watermark in slots of ``slot`` seconds, so late rows take their place in
    order.  A block closes when a reading that is past the watermark doesn't join
    it, or when the watermark has passed its end by the gap.  A video that has
    been silent for ``keep`` seconds of event time leaves the store; should it
    come again, its blocks are counted anew.  Many videos may share ``lanes`` of
    the store (see ``folded``); blocks are the same.
    """
    ready = prepared(readings, script).select("video_id", "ts", "time", "frame_id", *[c for c in _FIELDS if c != "time"])
    return folded(ready, _Sessions(max_gap, similarity, min_duration, slot, keep), f"{BLOCKS}, readings int", delay, lanes)


class _Gated(OrderedFold):
    waiting = "micros long, time double, frame_id string, detected boolean, mask array<boolean>, small array<double>"
    held = "active boolean, read_at double, mask array<boolean>, small array<double>, has_image boolean, frame_id string, time double, end_time double, seen double"
    out = ["video_id", "frame_id", "time", "end_time"]

    def __init__(self, rate: float, options: dict, slot: float, keep: float):
        super().__init__(slot, keep)
        self.rate, self.options = rate, options

    def fold(self, held: tuple | None, rows: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
        gate, last, seen, given = Gate(**self.options), None, 0.0, []
        if held is not None:
            gate.active, gate.read_at, gate.mask, gate.small, gate.has_image, *last, seen = held
            last = None if last[0] is None else last
        for micros, time, frame, detected, mask, small in rows:
            what, _ = gate.step(time, bool(detected), mask, small)
            if what == "same" and last:
                last[2], seen = time + self.rate, micros / 1e6
            elif last and what in ("emit", "no_text"):
                given.append(tuple(last))
                last = None
            if what == "emit":
                last, seen = [frame, time, time + self.rate], micros / 1e6
        lists = [None if x is None else list(x) for x in (gate.mask, gate.small)]
        return (gate.active, gate.read_at, *lists, gate.has_image, *(last or (None, None, None)), seen), given

    def until(self, held: tuple | None) -> float | None:
        return held[8] + self.keep / 1000 if held is not None and held[5] is not None else None

    def joins(self, held: tuple, row: tuple) -> bool:
        return True  # any later frame decides the end of the one before

    def finish(self, held: tuple) -> tuple[tuple, list[tuple]]:
        return (*held[:5], None, None, None, 0.0), [tuple(held[5:8])]


def gated_frames(frames: DataFrame, delay: str = "10 seconds", rate: float = 0.75, keep: float = 3600.0, slot: float = 10.0, lanes: int | None = None, **options) -> DataFrame:
    """Frames to read, from a stream, each with its end once that is final (X3). Needs ``ts`` beside the batch gate's columns, and the RocksDB state store.

    A row is given out when the next one is emitted or text has gone, so its end
    no longer changes; the last of a stream is given out after ``keep`` seconds of
    event time without another.  A video that has then been silent for as long
    again leaves the store.  ``lanes`` is as in ``content_sessions``.
    """
    kinds = {"mask": "array<boolean>", "small": "array<double>"}
    ready = frames.select("video_id", "ts", "time", "frame_id", "detected", *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return folded(ready, _Gated(rate, options, slot, keep), "video_id string, frame_id string, time double, end_time double", delay, lanes)
