"""Archives: what is written is read back, by this reader and by a plain one."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from subloom.llm import warc

SCHEMA = "page_id long, url string, html string"
TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (0, "http://a.example/x?y=1#z", "<p>one</p>"), (1, "http://b.example", "<p>two</p>"), (2, "http://c.example/é ü", "<p>one</p>"), (3, None, None), (4, "not a url\r\nX: y", ""), (5, "", TRAP), (6, "http://d.example/", TRAP),
    (7, "http://e.example/", "日本語😀é" * 50), (8, "http://f.example/", "x" * 3_000_000), (9, "http://g.example/", "\r\n"), (9, "http://g.example/", "\r\n"), (1, "http://b.example", "<p>two</p>"), (None, "http://n.example/", "<p>one</p>"), (None, "http://n.example/", "only null"), (None, None, "only null"),
]


def digest(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(pages: list[tuple], least: int = 0) -> Counter:
    groups: dict = {}
    for page, _, html in pages:
        groups.setdefault(html or "", []).append(page)
    out = Counter()
    for html, ids in groups.items():
        size, ids = len(html.encode()), sorted(ids, key=lambda i: (i is None, i or 0))
        for k, page in enumerate(ids):
            again = k > 0 and size >= least
            out[(page, size, digest(html), "revisit" if again else "response", ids[0] if again else None)] += 1
    return out


def table(spark, some=PAGES):
    return spark.createDataFrame(some, SCHEMA).repartition(4)


def got(df) -> Counter:
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("least", [0, 5, 1 << 40])
def test_round_trip(spark, least):
    assert got(warc.round_trip(table(spark), least)) == brute(PAGES, least)


def test_files_are_cut_and_plain_readers_read_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4_000)
    path = str(tmp_path / "archives")
    warc.write(table(spark, [p for p in PAGES if p[0] != 8]), f"file://{path}")
    files = glob.glob(f"{path}/*.gz")
    assert len(files) > 4
    kinds = Counter()
    for name in files:
        content = gzip.open(name).read()
        while content:  # by hand: a head, a block of the given length, an end
            head, _, rest = content.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            length = int(headers["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[length : length + 4] == b"\r\n\r\n"
            kinds[headers["WARC-Type"]] += 1
            content = rest[length + 4 :]
    n = len(PAGES) - 1
    assert kinds["request"] == kinds["metadata"] == n == kinds["response"] + kinds["revisit"]


def test_payloads_and_nested_rows(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    warc.write(table(spark), path)
    rows = warc.assemble(warc.read(spark, path)).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert len(r.requests) == 1 and len(r.metadata) == 1 and r.http.startswith("HTTP/1.1 200 OK")
        if r.type == "response":
            assert digest(bytes(r.payload).decode()) == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert bytes(r.payload) == b"" and r.refers_to in {x.capture for x in rows if x.type == "response" and x.payload_digest == r.payload_digest}
    assert {x.requests[0].http.split("\r\n")[0] for x in rows} >= {"GET /x?y=1 HTTP/1.1", "GET / HTTP/1.1", "GET /é%20ü HTTP/1.1"}


def record(kind: str, name: str | None, block: bytes, concurrent: tuple = (), content_type: str = "text/plain") -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *([f"WARC-Record-ID: {name}"] if name else []), *[f"WARC-Concurrent-To: {c}" for c in concurrent], f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Links that go the other way, over a chain and across files; streams of one record; what can't be read stays in its file."""
    http = "application/http; msgtype=response"
    a = [record("warcinfo", "<i>", b"software: x\r\n"), record("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", ("<q1>",), http), record("metadata", "<m1>", b"k: v1\r\n", ("<m2>",)), record("metadata", "<m2>", b"k: v2\r\n", ("<q1>",))]
    b = [record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", (), http), record("request", "<q2>", b"GET /lost HTTP/1.1\r\n\r\n", (), http), record("metadata", "<m3>", b"page-id: 7\r\n", ("<q2>",)), record("resource", None, b"plain")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, a)))
    (tmp_path / "b.warc").write_bytes(b"".join(b))
    (tmp_path / "c.warc").write_bytes(record("response", "<r2>", b"HTTP/1.1 200 OK\r\n\r\nx", (), http) + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "d.warc").write_bytes(b"nonsense")
    (tmp_path / "e.warc").write_bytes(b"")
    records = warc.read(spark, f"file://{tmp_path}")
    assert Counter(r.type for r in records.collect())["unreadable"] == 2
    rows = {r.capture: r for r in warc.assemble(records).collect()}
    r1 = rows["<r1>"]
    assert [q.record_id for q in r1.requests] == ["<q1>"] and [m.record_id for m in r1.metadata] == ["<m1>", "<m2>"] and bytes(r1.payload) == b"body"
    assert rows["<q2>"].type is None and [m.record_id for m in rows["<q2>"].metadata] == ["<m3>"]
    assert {"<r1>", "<q2>", "<r2>", "<i>"} < set(rows) and len(rows) == 5
    fields = warc.assemble(records).select("capture", warc.field(F.col("metadata"), "page-id").alias("f")).where("f is not null").collect()
    assert [tuple(f) for f in fields] == [("<q2>", "7")]


def test_clashing_columns_and_empty_tables(spark):
    clashing = table(spark)
    for name in ("uid", "bytes", "digest", "_digest", "_first", "value", "type"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    assert got(warc.round_trip(clashing)) == brute(PAGES)
    empty = warc.round_trip(table(spark, []))
    assert empty.collect() == [] and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_digests(spark):
    texts = ["", "a", "é" * 99, "abc" * 1000]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_of_sha1(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in out} == {t: digest(t) for t in texts}
