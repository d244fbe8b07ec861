"""Folds of streams in order of event time, with what waits in slots of a state store."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Rows of videos, each folded in order once the watermark has passed them.

    A key of the store is a video, or a lane: several videos that share its
    calls, whose cost a call is far above a row's.  Rows wait in slots of event
    time, an entry of a map state each, so a batch reads and writes only the
    slots that its rows fall in, however much waits.  A slot's timer gives it to
    the fold when the watermark has passed its end: then all its rows are there,
    late ones too.  What the fold holds between slots is one typed value a video.
    After ``keep`` seconds of event time without anything open a video leaves the
    store.  Values of the store are typed arrays, one a column: rows in a nested
    array would each be converted by themselves.

    A row is (micros of event time, time, id, ...); rows of a video's slot are
    taken in order of (time, id).  ``time`` may stand on another clock, as long as
    both run in the same order.
    """

    waiting: str  # columns of a row
    held: str  # columns of what the fold holds
    out: list[str]  # columns of what it gives

    def __init__(self, slot: float, keep: float):
        self.slot, self.keep = int(slot * 1e6), int(keep * 1000)

    def fold(self, held: tuple | None, rows: Iterable[tuple]) -> tuple[tuple | None, list[tuple]]:
        """What is held after the rows, and what they give."""
        raise NotImplementedError

    def until(self, held: tuple | None) -> float | None:
        """When what is held is final, in seconds of event time; None if nothing is open."""
        raise NotImplementedError

    def joins(self, held: tuple, row: tuple) -> bool:
        """Whether the next waiting row can still change what is open."""
        raise NotImplementedError

    def close(self) -> None:
        pass

    def finish(self, held: tuple) -> tuple[tuple | None, list[tuple]]:
        """What stays held when the open part is given out, and that part."""
        raise NotImplementedError

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.slots = handle.getMapState("waiting", "slot long", _arrays(self.waiting))
        self.open = handle.getValueState("held", _arrays(self.held))
        self.silent = handle.getValueState("silent", _arrays("since long"))
        self.mark, self.settled = None, set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new: dict[int, list[list]] = {}
        for part in rows:
            part = part.iloc[:, 1:-1]
            for slot, of in part.groupby(part.iloc[:, 1] // self.slot):
                columns = [_plain(of.iloc[:, i]) for i in range(of.shape[1])]
                new[int(slot)] = [a + b for a, b in zip(new[slot], columns, strict=True)] if slot in new else columns
        for slot, more in new.items():
            there = self.slots.getValue((slot,))
            if there is None:
                self.handle.registerTimer(self._end(slot))
            self.slots.updateValue((slot,), tuple(more) if there is None else tuple([*a, *b] for a, b in zip(there, more, strict=True)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        if mark != self.mark:
            self.mark, self.settled = mark, set()
        if key in self.settled:  # the first of a batch's timers has taken all that was due
            return
        self.settled.add(key)
        held, since = ({v: tuple(h) for v, *h in zip(*(state.get() or ()), strict=True)} for state in (self.open, self.silent))
        was = held.copy(), since.copy()
        slots, given, came = sorted(k for (k,) in self.slots.keys()), [], set()
        due = [k for k in slots if self._end(k) <= mark]
        for k in due:
            for video, rows in self._sorted(k).items():
                held[video], more = self.fold(held.get(video), rows)
                given += [(video, *g) for g in more]
                came.add(video)
            self.slots.removeKey((k,))
        ends = {v: self.until(h) for v, h in held.items()}
        over = {v for v, end in ends.items() if end is not None and end * 1000 < mark}
        leaving = {v for v, start in since.items() if ends[v] is None and v not in came and start[0] + self.keep <= mark}
        ahead = self._ahead(slots[len(due) :], over | leaving)
        for v in over:
            if v not in ahead or not self.joins(held[v], ahead[v]):
                held[v], more = self.finish(held[v])
                given += [(v, *g) for g in more]
                ends[v] = None
        for v, end in ends.items():
            if end is not None:
                since.pop(v, None)
            elif v in leaving and v not in ahead:
                del held[v], since[v]
            elif v in came or v in leaving or v not in since:
                since[v] = (mark,)
        for state, now, before in zip((self.open, self.silent), (held, since), was, strict=True):
            if now and now != before:
                state.update(tuple(map(list, zip(*((v, *h) for v, h in now.items()), strict=True))))
            elif before and not now:
                state.clear()
        after = [max(int(end * 1000), mark) + 1 for end in ends.values() if end is not None] + [start + self.keep for (start,) in since.values()]
        if after:
            self.handle.registerTimer(min(after))
        if given:
            yield pd.DataFrame(given, columns=self.out)

    def _end(self, slot: int) -> int:
        return -(-((slot + 1) * self.slot) // 1000)

    def _sorted(self, slot: int) -> dict[str, list[tuple]]:
        """A slot's rows, each video's in order."""
        rows: dict[str, list[tuple]] = {}
        for video, *r in sorted(zip(*self.slots.getValue((slot,)), strict=True), key=lambda r: (r[2], str(r[3]))):
            rows.setdefault(video, []).append(tuple(r))
        return rows

    def _ahead(self, slots: list[int], videos: set[str]) -> dict[str, tuple]:
        """The first row that waits in these slots, of each of the videos that has one; slots are read until all are found."""
        found: dict[str, tuple] = {}
        for k in slots:
            if len(found) == len(videos):
                break
            rows = self._sorted(k)
            found |= {v: rows[v][0] for v in videos & rows.keys() if v not in found}
        return found


def _arrays(columns: str) -> str:
    """The columns of rows of videos as arrays of their values."""
    kinds = (c.split(" ", 1) for c in re.split(r", (?![^<]*>)", columns))
    return ", ".join(["video_id array<string>", *(f"{name} array<{kind}>" for name, kind in kinds)])


def _plain(column: pd.Series) -> list:
    """A column's values as Python's own."""
    return [None if x is None or x is pd.NA else x.tolist() if hasattr(x, "tolist") else x for x in column] if column.dtype == object else column.tolist()


def session_with_store(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own with the RocksDB store, for streams with typed state; the caller's stays as it is.

    ``partitions`` is how many stores a stream has, the caller's number of shuffle
    partitions if not given: each is opened and written in every batch, so a
    stream of little data is best in few.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    if partitions is not None:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set(PROVIDER, ROCKSDB)
    return own


def folded(rows: DataFrame, processor: OrderedFold, schema: str, delay: str, lanes: int | None = None) -> DataFrame:
    """A stream's rows (video_id, ts, then the processor's) through an ordered fold, a video at a time.

    Without ``lanes`` each video is a key of the store.  With them as many keys
    hold all videos, by hash: a batch then costs calls to the store by the lane
    and not by the video.  The number may not change between a stream's runs, and
    a task holds a lane's open blocks and one slot of its rows at a time.
    """
    spark = rows.sparkSession
    if not spark.conf.get(PROVIDER).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"{PROVIDER} must be {ROCKSDB} (see session_with_store): maps and timers are in its store")
    others = [F.col(c) for c in rows.columns if c not in ("video_id", "ts")]
    late = rows.withWatermark("ts", delay)
    key = F.col("video_id") if lanes is None else F.pmod(F.xxhash64("video_id"), F.lit(lanes)).alias("lane")
    ready = late.select(key, F.col("video_id").cast("string").alias("video"), F.unix_micros("ts").alias("micros"), *others, "ts")
    return ready.groupBy(ready.columns[0]).transformWithStateInPandas(processor, schema, "Append", "EventTime")
