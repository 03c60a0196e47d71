"""WARC archives: writing, and reassembly of segmented records.

Pages become HTTP responses in chunked transfer framing. Long blocks are split into segments: the first record carries
WARC-Segment-Number 1, the others are `continuation` records with the first one's id as WARC-Segment-Origin-ID, and the
last of them the total length. Spark's text writer stores the records, so that commits and retries are Spark's own.
Reading parses each archive by Content-Length, groups segments by origin id, orders them by number, verifies the total
length and decodes the chunks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, scratch_path, ship, stored

CRLF = b"\r\n"
END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped; ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP message: what follows its headers, without transfer framing."""
    head, _, body = block.partition(END)
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """A record without the empty lines that end it. Line ends inside a value become spaces."""
    lines = [f"{k}: {' '.join(str(v).splitlines())}".encode("utf-8", "surrogatepass") for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return CRLF.join([VERSION, *lines, b"", block])


def records(uid: str, page_id: int | None, url: str | None, payload: bytes, first: bool, first_id: int | None, segment_bytes: int) -> list[bytes]:
    """All records of one page: a response, in segments if it is long, or a revisit of the response with its payload."""
    named = lambda x: f"<urn:uuid:{uuid.uuid5(NAMES, x)}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-Id", page_id), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if not first:
        extra = [("WARC-Type", "revisit"), ("WARC-Record-ID", named(uid)), ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", first_id)]
        return [record(extra + common, head)]
    block = head + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", named(uid)), *common], block)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", named(uid)), ("WARC-Segment-Number", 1), *common], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", named(f"{uid}/{k}")), ("WARC-Segment-Origin-ID", named(uid)), ("WARC-Segment-Number", k), ("WARC-Date", DATE)]
        out.append(record([*fields, ("WARC-Segment-Total-Length", len(block) if k == len(pieces) else None)], piece))
    return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; ValueError where it is cut short."""
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):
            at += 2
            continue
        head = data.index(END, at)
        lines = data[at:head].split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(fields["content-length"])
        if head + 4 + size > len(data):
            raise ValueError("a record is cut short")
        yield fields, data[head + 4 : head + 4 + size]
        at = head + 4 + size


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, segment_bytes: int = 16384, records_per_file: int = 4000, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes gzipped archives of bounded size to the folder path.

    Of rows with equal payloads of at least min_payload bytes the one with the smallest page_id is the response and the
    others revisit it; rows that repeat that id are responses too, and so are all of a group whose ids are all null.
    Null html is an empty payload, a null url has no target.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("n"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(html), F.lit("")).alias("html")).where(F.octet_length("html") >= min_payload)
    first = first.groupBy(F.sha1("html").alias("sha")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("sha", "first_id")
    both = rows.join(first.withColumnRenamed("sha", "first_sha"), F.col("sha") == F.col("first_sha"), "left")
    both = both.withColumn("first", F.col("first_sha").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = []
        for r in batch.to_pylist():
            out += records(f"{r['page_id']}/{r['n']}", r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["first"], r["first_id"], segment_bytes)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = arrow_map(both.select("page_id", "url", "html", "n", "first", "first_id"), run, "record binary", "html")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "key string, type string, page_id long, url string, digest string, refers_to long, segment int, total long, block binary"


def read_archives(df_or_path) -> DataFrame:
    """One row per response or revisit of the archives in a folder, segments put together: page_id, url, record_type,
    refers_to, digest (as stated), payload (null for revisits)."""
    spark, path = df_or_path
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    shape = pa.schema([("key", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    number = lambda x: None if x is None else int(x)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for f, block in parse_records(gzip.decompress(batch.column("content")[i].as_py())):
                    said = f.get("warc-payload-digest")
                    rows.append((f.get("warc-segment-origin-id") or f["warc-record-id"], f["warc-type"], number(f.get("x-page-id")), f.get("warc-target-uri"), said and said.removeprefix("sha1:"), number(f.get("x-refers-to-page-id")), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    ship(spark)
    found = files.mapInArrow(scan, RECORD)
    return reassemble(found)


def payloads(found: DataFrame) -> DataFrame:
    """Rows of whole records with their payload decoded; a record is whole if its segments 1 to n add up to the stated total."""
    out_schema = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
    out_shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            segments = sorted(r["segments"], key=lambda s: s["segment"] or 1)
            head, block = segments[0], b"".join(s["block"] for s in segments)
            if len(segments) > 1 or head["segment"] is not None:
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
                    raise ValueError(f"record of page {head['page_id']}: segments do not add up")
            payload = http_payload(block) if head["type"] == "response" else None
            if payload is not None and head["digest"] not in (None, digest(payload)):
                raise ValueError(f"record of page {head['page_id']}: digest does not match")
            out.append((head["page_id"], head["url"], head["type"], head["refers_to"], head["digest"], payload))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), out_shape.types, strict=True)], schema=out_shape) if out else pa.RecordBatch.from_pylist([], schema=out_shape)

    return arrow_map(found, run, out_schema, "segments")


def reassemble(found: DataFrame) -> DataFrame:
    """Groups the segments of a record by its origin id; records that are whole already don't move."""
    segment = F.struct("segment", "type", "page_id", "url", "digest", "refers_to", "total", "block")
    whole = found.where("segment is null").select(F.array(segment).alias("segments"))
    parts = found.where("segment is not null").groupBy("key").agg(F.collect_list(segment).alias("segments")).select("segments")
    return payloads(whole.unionByName(parts))


def page_records(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives of pages to the shared folder and reads them back: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to for every row of pages.

    A revisit has the payload length of the response that it refers to. Very long pages are written in segments, and read and put
    together again one record at a time; an empty table writes no archive and gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    got = read_archives((spark, path)).select("page_id", "url", "record_type", "refers_to", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("own_bytes"))
    got = stored(got, "warc-index")
    full = got.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("own_bytes").alias("full_bytes"))
    seen = got.join(full, F.col("payload_digest") == F.col("d"), "left")
    return seen.select("page_id", "url", F.coalesce("own_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
