"""WARC archives: written from pages, read back record by record, and put together capture by capture.

A page gives three records that name each other: a request and a metadata record
are concurrent to a response, or to a revisit of an earlier response with the
same payload.  Reading joins what is concurrent again, whatever the order and
the file of the records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder
from .common import drop_intermediates, intermediates, made, materialise, plain

#: Bytes of records that a file is to have before compression; one record is never split.
FILE_BYTES = 32 << 20
#: Bytes of payloads in a batch that goes back to Spark.
BATCH_BYTES = 4 << 20
#: Payloads of so many bytes at least are written once; later ones revisit the first.
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
# fixed values: the format's end of a record, its profile of revisits, the digits of base32
END, PROFILE, DIGITS = "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records that make a capture of their own.
CENTRES = ("response", "revisit", "resource")


def base32_of_sha1(payload: Column) -> Column:
    """The SHA-1 of a payload as 32 digits of base32: each five hex digits are four of them."""
    digest = F.sha1(payload)
    digits = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(DIGITS), F.shiftright(bits, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*digits)


def _urn(name: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), name, F.lit(">"))


def _named(kind: str, uid: Column) -> Column:
    """Another id made from one: the same for each run over the same ids."""
    return F.regexp_replace(F.md5(F.concat(F.lit(kind), uid)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _record(kind: str | Column, uid: Column, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    """A record without its end; headers whose value is null are left out."""
    headers = [("WARC-Type", kind if isinstance(kind, Column) else F.lit(kind)), ("WARC-Record-ID", _urn(uid)), ("WARC-Date", F.lit(DATE)), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{name}: "), value) for name, value in headers]))
    return F.concat(F.lit("WARC/1.1\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``, one stream of gzip a file.

    Pages are staged with an id and a digest for each row; of rows that share a
    payload of at least ``min_bytes`` the one of the smallest page_id is the
    response, and only digests that several rows have are joined back.  Spark's
    own text writer writes the records, ends included, so a task that is lost and
    run again leaves nothing twice, on any file system that Spark knows.

    Defined results: a null html is an empty payload; a null page_id comes after
    all others and has no field in its metadata; of rows that repeat one is the
    response; control characters and blanks of a url are written as %20, a null
    url has no header.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    staged = plain(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.uuid().alias("uid"))
    staged = staged.select("*", F.octet_length("html").cast("long").alias("bytes"), base32_of_sha1(F.col("html")).alias("digest"))
    staged = materialise(staged, "warc-staged", compression="zstd")
    rows, size = staged.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("uid"))
    copies = staged.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    copies = materialise(copies.where("n > 1").select(F.col("digest").alias("_digest"), F.col("first.uid").alias("_first")), "warc-copies")
    df = staged.join(copies, F.col("digest") == F.col("_digest"), "left")

    uid, again = F.col("uid"), F.coalesce(F.col("_first") != F.col("uid"), F.lit(False))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    target = ("WARC-Target-URI", url)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, head).otherwise(F.concat(head, F.col("html")))
    refers = [("WARC-Profile", F.when(again, F.lit(PROFILE))), ("WARC-Refers-To", F.when(again, _urn(F.col("_first"))))]
    answer = _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), uid, "application/http; msgtype=response", block, target, ("WARC-Payload-Digest", digest), *refers)
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
    place = F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(F.startswith(place, F.lit("/")), place).otherwise(F.concat(F.lit("/"), place)), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")), F.lit("\r\n\r\n"))
    concurrent = ("WARC-Concurrent-To", _urn(uid))
    request = _record("request", _named("request", uid), "application/http; msgtype=request", asked, target, concurrent)
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", _named("metadata", uid), "application/warc-fields", fields, target, concurrent)
    a_file = max(1, FILE_BYTES * max(1, rows) // (size + 1_500 * max(1, rows)))  # pages of a file; a page's headers are some 1,500 bytes
    df.select(F.explode(F.array(request, answer, metadata)).alias("value")).write.option("maxRecordsPerFile", 3 * a_file).text(path, compression="gzip", lineSep=END)


_RECORD = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string())]
    + [("http", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
)
RECORD = "path string, offset bigint, type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, http string, payload_bytes bigint, payload_digest string, fields string, payload binary, error string"


def _headers(lines: bytes) -> dict[str, list[str]]:
    """Names in lower case and their values; lines that begin with a blank go on."""
    out: dict[str, list[str]] = {}
    name = ""
    for line in lines.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            out[name][-1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, []).append(value.strip())
    return out


def _parsed(content: bytes) -> Iterator[tuple[int, dict[str, list[str]], bytes]]:
    """Offset (before compression), headers and block of each record; a file of gzip may have one stream or a stream for each record."""
    raw = io.BytesIO(content)
    source = io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)
    offset = 0
    while True:
        at, line = offset, source.readline()
        offset += len(line)
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        lines = []
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
            offset += len(line)
        offset += len(line)
        headers = _headers(b"".join(lines))
        length = int(headers["content-length"][0])
        block = source.read(length)
        if len(block) < length:
            raise ValueError(f"the record at {at} ends early")
        offset += length
        yield at, headers, block


def _row(path: str, at: int, headers: dict[str, list[str]], block: bytes, payload: bool) -> tuple:
    first = lambda name: headers.get(name, [None])[0]
    kind, http, body = (first("warc-type") or "").lower(), None, block
    if (first("content-type") or "").lower().startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    if kind == "revisit":  # what isn't here is told by the headers
        told = _headers((http or "").encode()).get("content-length", [""])[0]
        size = int(told) if told.isdecimal() else None
        digest = (first("warc-payload-digest") or "").rpartition(":")[2] or None
    fields = block.decode("utf-8", "replace") if kind in ("metadata", "warcinfo") else None
    return (path, at, kind, first("warc-record-id") or f"{path}#{at}", headers.get("warc-concurrent-to", []), first("warc-refers-to"), first("warc-target-uri"), first("warc-date"), http, size, digest, fields, body if payload and kind in CENTRES else None, None)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``, in ``RECORD``'s columns; without ``payload`` none leaves the reader.

    Payloads are what follows the HTTP headers; their size and SHA-1 are taken
    from what was read, for revisits from the headers.  Files come through
    Spark's binary reader, so one is a row of at most 2 GB and is parsed as a
    stream.

    Defined results: records without an id are named by file and offset; what
    can't be read is a row of type ``unreadable`` with its error, and the rest of
    that file is left; other files are not touched by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, name = [], 0, path.as_py()
                records = _parsed(content.as_buffer())
                while True:
                    try:
                        at, headers, block = next(records)
                        rows.append(_row(name, at, headers, block, payload))
                    except StopIteration:
                        break
                    except Exception as e:  # noqa: BLE001  whatever a foreign file holds becomes a row
                        rows.append((name, -1, "unreadable", f"{name}#", [], *[None] * 8, f"{type(e).__name__}: {e}"))
                        break
                    size += len(block) if payload else 200
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, RECORD)


def _owners(records: DataFrame) -> DataFrame:
    """record_id, capture of the records that are no centre: what they are concurrent to, over as many steps as it takes.

    Links count both ways.  A step takes the records that are linked to one that
    has its capture, the least of several.  What no centre reaches gathers round
    its requests in the same way, and what is left stands by itself.
    """
    links = records.select("record_id", F.explode("concurrent_to").alias("other"))
    links = materialise(links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct(), "warc-links")
    types = materialise(records.select("record_id", "type").distinct(), "warc-types")
    others = types.where(~F.col("type").isin(*CENTRES)).select("record_id", "type")
    owned, edge = None, types.where(F.col("type").isin(*CENTRES)).select("record_id", F.col("record_id").alias("capture"))
    for centres in (CENTRES, ("request",), None):
        open_ = others if owned is None else others.join(owned, "record_id", "left_anti")
        if centres is None:
            return owned.unionByName(open_.select("record_id", F.col("record_id").alias("capture")).distinct())
        if centres is not CENTRES:
            edge = open_.where(F.col("type").isin(*centres)).select("record_id", F.col("record_id").alias("capture"))
            owned = materialise(owned.unionByName(edge), "warc-owned")
        while True:
            rest = others.join(owned, "record_id", "left_anti") if owned is not None else others
            reached = links.join(edge.withColumnRenamed("record_id", "other"), "other").join(rest.select("record_id").distinct(), "record_id", "left_semi")
            edge = materialise(reached.groupBy("record_id").agg(F.min("capture").alias("capture")), "warc-step")
            if owned is not None and edge.isEmpty():
                break
            owned = edge if owned is None else materialise(owned.unionByName(edge), "warc-owned")
    return owned


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture, type, uri, date, refers_to, http, payload_bytes, payload_digest, payload, requests and metadata (arrays of structs).

    ``records`` is a table that can be read again.  Requests and metadata find
    their response through the ids that they are concurrent to; only ids and
    small records are moved for it, and payloads once where they are asked for.

    Defined results: each response, revisit and resource is a capture, and those
    that share an id share what is concurrent to it; requests and metadata that
    reach no response are captures with a null type; unreadable rows are none.
    """
    usable_ = records.where("type <> 'unreadable'")
    owners = _owners(usable_.select("record_id", "type", "concurrent_to"))
    small = usable_.where(~F.col("type").isin(*CENTRES)).select("record_id", "type", "uri", "http", "fields").join(owners, "record_id")
    part = lambda kinds, *cols: F.array_sort(F.collect_list(F.when(kinds, F.struct("record_id", *cols))))
    request = F.col("type") == "request"
    nested = small.groupBy("capture").agg(part(request, "uri", "http").alias("requests"), part(~request, "type", "fields").alias("metadata"), F.min("uri").alias("_uri"))
    centre = usable_.where(F.col("type").isin(*CENTRES)).select(F.col("record_id").alias("_id"), "type", "uri", "date", "refers_to", "http", "payload_bytes", "payload_digest", "payload")
    out = centre.join(nested, F.col("_id") == F.col("capture"), "full_outer")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(nested.dtypes)[c])).alias(c)
    return out.select(F.coalesce("_id", "capture").alias("capture"), "type", F.coalesce("uri", "_uri").alias("uri"), "date", "refers_to", "http", "payload_bytes", "payload_digest", "payload", none("requests"), none("metadata"))


def field(capture_metadata: Column, name: str) -> Column:
    """The first value of a field in a capture's metadata records, or null."""
    text = F.array_join(F.transform(capture_metadata, lambda m: F.coalesce(m["fields"], F.lit(""))), "\n")
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages written as archives and read back; archives and tables between are dropped."""
    spark = pages.sparkSession
    mark = intermediates(spark)
    path = f"{folder(spark)}/warc-{spark.sql('SELECT uuid()').first()[0]}"
    write(pages, path, min_bytes)
    drop_intermediates(spark, mark)
    made(spark, path)
    records = materialise(read(spark, path, payload=False), "warc-records")
    seen = assemble(records).withColumn("page_id", field(F.col("metadata"), "page-id").try_cast("bigint"))
    seen = materialise(seen.select("capture", "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"), "warc-captures")
    first = seen.where("record_type = 'response'").select(F.col("capture").alias("refers_to"), F.col("page_id").alias("_first"))
    joined = seen.join(first, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("_first").alias("refers_to"))
    out = materialise(joined, "warc-pages", keep=True)
    drop_intermediates(spark, mark)
    return out


def oracle_sql(min_bytes: int = MIN_BYTES) -> str:
    digit = f"substr('{DIGITS}', (('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1, 1)"
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: {digit}), 'string_agg', '') AS payload_digest,
          CASE WHEN n >= {min_bytes} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= {min_bytes} AND k > 1 THEN first END AS refers_to FROM r
    """
