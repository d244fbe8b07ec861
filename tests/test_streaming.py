"""Streams give the batch operators' results once a later reading has flushed them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from subloom.operators import blocks as B
from subloom.operators import candidates as C
from subloom.streaming import late, sessions

OBS = "video_id string, frame_id string, time double, end double, text string, score double, confidence double"
ZERO = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, parts, build, name):
    """A stream over files that come one by one."""
    source = tmp_path / name
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(str(source / f"p{i}"))
        for f in (source / f"p{i}").glob("part-*.parquet"):
            f.rename(source / f"{i:03d}.parquet")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source) + "/*.parquet")
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}")


def with_ts(df):
    return df.withColumn("ts", (F.lit(ZERO).cast("timestamp").cast("double") + F.col("time")).cast("timestamp"))


def test_content_sessions_equal_the_batch(spark, tmp_path):
    texts = ["дом", "дом!", "лес", "лес", "гора", "дом", "дом", "лес"]
    rows = [(v, f"{i:03d}", i * 1.0, i * 1.0 + 0.8, t, 1.0, 0.5 + i / 100) for v in ("a", "b") for i, t in enumerate(texts)]
    late = rows.pop(3)
    flush = [(v, "999", 500.0, 500.5, "конец", 1.0, 0.1) for v in ("a", "b")]
    parts = [with_ts(spark.createDataFrame(x, OBS)) for x in (rows[:7], [late], rows[7:], flush, [(v, "9999", 900.0, 900.5, "конец", 1.0, 0.1) for v in ("a", "b")])]
    got = run(spark, tmp_path, parts, lambda s: sessions.content_sessions(s, "20 seconds"), "content")
    batch = B.build_blocks(spark.createDataFrame([*rows, late], OBS))
    key = lambda df: sorted((r.video_id, r.start, r.end, r.text, r.confidence, r.readings) for r in df.collect() if r.start < 400)
    assert key(got) == key(batch)


def test_gap_sessions_stream(spark, tmp_path):
    rows = [("a", f"{i}", t, t + 1, "x", 1.0, 0.5) for i, t in enumerate((0.0, 5.0, 10.0, 30.0, 200.0))]
    parts = [with_ts(spark.createDataFrame(x, OBS)) for x in (rows[:4], rows[4:], [("a", "9", 900.0, 901.0, "x", 1.0, 0.5)])]
    got = run(spark, tmp_path, parts, lambda s: sessions.gap_sessions(s, "10 seconds", ["video_id"], "10 seconds"), "gaps")
    batch = sessions.gap_sessions(with_ts(spark.createDataFrame(rows, OBS)), "10 seconds", ["video_id"])
    key = lambda df: sorted((r.start, r.end, r.readings) for r in df.collect())
    assert key(got)[:2] == key(batch)[:2]


def test_gated_frames_stream(spark, tmp_path):
    on, off = [True] * 4 + [False] * 4, [False] * 4 + [True] * 4
    frames = [(0.0, True, on), (0.5, True, on), (1.0, True, off), (1.5, False, None), (5.0, True, off), (5.5, True, off), (90.0, False, None)]
    kind = "video_id string, frame_id string, time double, detected boolean, mask array<boolean>, small array<double>"
    rows = [("v", f"{i}", t, d, m, [0.0] * 4) for i, (t, d, m) in enumerate(frames)]
    parts = [with_ts(spark.createDataFrame(x, kind)) for x in (rows[:3], rows[3:6], rows[6:], [("v", "8", 300.0, False, None, [0.0] * 4)], [("v", "9", 600.0, False, None, [0.0] * 4)])]
    got = run(spark, tmp_path, parts, lambda s: sessions.gated_frames(s, "5 seconds", 0.5), "gated")
    batch = C.gate_frames(spark.createDataFrame(rows, kind), rate=0.5).where("state = 'emit'")
    key = lambda df: sorted((r.frame_id, r.time, r.end_time) for r in df.collect())
    assert key(got) == key(batch)


def test_late_rows_are_kept(spark, tmp_path):
    """Late and other rows together are the input, over restarts, repeats and rows without a time; a batch that is run again finds the same."""
    arrivals = [[0.0, 50.0, None], [45.0, 40.0, 39.9, 39.9, 60.0], [], [100.0, 50.0, 50.1], [90.0, 89.9, None, -5.0]]
    schema, n, latest, want = "k int, ts timestamp", 0, None, []
    source, out, check = (str(tmp_path / x) for x in ("source", "out", "check"))
    for batch in arrivals:
        rows = [(n + i, None if t is None else ZERO + dt.timedelta(seconds=t)) for i, t in enumerate(batch)]
        n += len(batch)
        mark = None if latest is None else latest - 10.0
        want += [(k, t is not None and mark is not None and t <= mark, None if t is None or mark is None or t > mark else round(mark - t, 3)) for (k, _), t in zip(rows, batch, strict=True)]
        latest = max([t for t in batch if t is not None] + ([latest] if latest is not None else []), default=None)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        late.route_late(spark.readStream.schema(schema).parquet(source), out, check, 10.0)
    got = late.routed(spark, out, schema)
    key = lambda r: (r[0], r[1], -1.0 if r[2] is None else r[2])
    assert sorted(((r.k, r.late, None if r.behind is None else round(r.behind, 3)) for r in got.collect()), key=key) == sorted(want, key=key)
    counts = [(r.readings, r.late) for r in late.late_counts(got).orderBy("batch").collect()]
    assert sum(r for r, _ in counts) == n and sum(x for _, x in counts) == sum(x for _, x, _ in want) > 0
    last = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    late.route_late(spark.readStream.schema(schema).parquet(source), out, check, 10.0)
    assert sorted((r.k, r.late) for r in late.routed(spark, out, schema).collect()) == sorted(w[:2] for w in want)


def test_streams_go_on_after_a_stop_and_leave_no_state(spark, tmp_path):
    """Many runs, each a stream of its own over what came since: blocks as in the batch, the store holds what waits and is empty in the end."""
    source, out, check = (str(tmp_path / x) for x in ("source", "out", "check"))
    texts = ["дом", "дом", "дома", "лес", "лес!", "гора"]
    rows = [(v, f"{i:04d}", i * 0.9, i * 0.9 + 0.5, texts[(i * 7 // 3 + len(v)) % 6], 1.0, 0.5 + i % 40 / 100) for v in ("a", "bb", "ccc") for i in range(60) if (i + len(v)) % 11]
    arrivals = [[r for r in rows if int((r[2] + (int(r[1]) * 37 % 13)) // 15) == n] for n in range(5)]
    assert sum(map(len, arrivals)) == len(rows) and any(a[-1] > b[0] for a, b in zip([[r[2] for r in x] for x in arrivals], [[r[2] for r in x] for x in arrivals[1:]], strict=False))
    waiting = []
    for part in [*arrivals, [("~", "0", 500.0, 500.1, "x", 1.0, 0.5)], [("~", "1", 900.0, 900.1, "x", 1.0, 0.5)], []]:
        with_ts(spark.createDataFrame(part, OBS)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(with_ts(spark.createDataFrame([], OBS)).schema).parquet(source)
        blocks = sessions.content_sessions(stream, "20 seconds", keep=60.0, slot=4.0)
        blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(check)
        waiting.append(state.where("key.video_id <> '~'").count())
    got = spark.read.parquet(out).where("video_id <> '~'")
    batch = B.build_blocks(spark.createDataFrame(rows, OBS))
    key = lambda df: sorted((r.video_id, r.block_no, r.start, r.end, r.text, r.confidence, r.readings) for r in df.collect())
    assert key(got) == key(batch) and len(key(got)) > 10
    assert max(waiting) > 0 and waiting[-1] == 0
    for name in ("held", "silent"):
        assert spark.read.format("statestore").option("stateVarName", name).load(check).where("key.video_id <> '~'").count() == 0


def test_typed_state_needs_its_store(spark):
    import pytest

    from subloom.streaming import ordered

    plain = spark.newSession()
    plain.conf.set(ordered.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        sessions.content_sessions(with_ts(plain.createDataFrame([], OBS)))
    assert ordered.session_with_store(plain).conf.get(ordered.PROVIDER) == ordered.ROCKSDB


def test_videos_that_share_lanes_give_the_same(spark, tmp_path):
    """calls to the store are by the lane and not by the video; blocks, frames and what is left in the end are as with a key a video."""
    texts = ["дом", "дом", "дома", "лес", "лес!", "гора"]
    rows = [(f"v{v}", f"{i:04d}", i * 0.9, i * 0.9 + 0.5, texts[(i * 7 // 3 + v) % 6], 1.0, 0.5 + i % 40 / 100) for v in range(30) for i in range(40) if (i + v) % 11 and not (v == 3 and 5 < i < 35)]
    on, off = [True] * 4 + [False] * 4, [False] * 4 + [True] * 4
    shown = spark.createDataFrame([((i * 5 + v) % 7 != 0, on if (i + v) % 9 < 5 else off, v, i) for v in range(30) for i in range(40)], "detected boolean, mask array<boolean>, v int, i int")
    frames = spark.createDataFrame(rows, OBS).join(shown, (F.concat(F.lit("v"), "v") == F.col("video_id")) & (F.col("i") == F.col("frame_id").cast("int")))
    frames = frames.withColumn("small", F.array(*[F.lit(0.0)] * 4))
    all_rows = with_ts(frames).cache()
    builds = {
        "content": (lambda s: sessions.content_sessions(s, "20 seconds", keep=60.0, slot=4.0, lanes=2), lambda df: B.build_blocks(df), ["video_id", "block_no", "start", "end", "text", "confidence", "readings"]),
        "gated": (lambda s: sessions.gated_frames(s, "20 seconds", 0.9, keep=60.0, slot=4.0, lanes=2), lambda df: C.gate_frames(df, rate=0.9).where("state = 'emit'"), ["video_id", "frame_id", "time", "end_time"]),
    }
    for name, (build, whole, columns) in builds.items():
        source, out, check = (str(tmp_path / f"{name}-{x}") for x in ("source", "out", "check"))
        waiting = []
        ends = [all_rows.limit(1).withColumns({"video_id": F.lit("~"), "time": F.lit(t), "end": F.lit(t + 0.1)}).drop("ts").transform(with_ts) for t in (500.0, 900.0)]
        arrival = F.floor((F.col("time") + F.pmod(F.col("frame_id").cast("int") * 37, F.lit(13))) / 25)
        for part in [*(all_rows.where(arrival == n) for n in range(2)), *ends]:
            part.select(*all_rows.columns).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(all_rows.schema).parquet(source)
            build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
            waiting.append(spark.read.format("statestore").option("stateVarName", "waiting").load(check).count())
        key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect() if r.video_id != "~")  # noqa: E731, B023
        assert key(spark.read.parquet(out)) == key(whole(all_rows)) and len(key(whole(all_rows))) > 100
        assert 0 < max(waiting) <= 2 * 12 and waiting[-1] <= 1  # slots of two lanes, however many videos; the last row's own
        left = spark.read.format("statestore").option("stateVarName", "held").load(check).select(F.explode("value.video_id").alias("v")).where("v <> '~'")
        assert left.count() == 0
