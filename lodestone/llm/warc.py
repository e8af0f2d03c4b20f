"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; each bundle ends with
the seek table of the Zstandard seekable format (a skippable frame), and every
bundle row carries the map from record to frame and offset inside the frame.
Bundles are rows of a Parquet table (bundle, content, entries), so that any
file system that Spark reaches can hold them and a lost task leaves nothing
half written.  ``content`` alone is a valid ``.warc.zst`` file.

Of rows with equal payloads of at least ``min_revisit`` bytes, the one with
the largest id is stored as a response, the others as revisit records without
payload.  A null html is an empty payload; rows with a null id count as the
smallest id and keep their null.  Repeated rows with one id and one payload
are each stored: all as responses if the id is the largest of its payload,
else all as revisits.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, small_batches, stored, table

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
MIN_REVISIT = 1000
SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE_SCHEMA = "bundle string, content binary, entries array<struct<record_id:string,page_id:long,frame:int,offset:int,length:int>>"
_ENTRY = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
_BUNDLE = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("entries", pa.list_(_ENTRY))])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """One WARC/1.1 record; a revisit holds the HTTP head only, whose Content-Length is the payload's."""
    rid = record_id(page_id, digest)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return rid, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return headers, head, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: sizes of each frame, compressed and not."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_spans(content: bytes) -> list[tuple[int, int]]:
    """Where each frame of a bundle begins and how long it is, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    start = len(content) - 9 - count * width
    for i in range(count):
        (size,) = struct.unpack_from("<I", content, start + i * width)
        out.append((at, size))
        at += size
    return out


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, level: int):
        import zstandard

        self.codec = zstandard.ZstdCompressor(level=level)
        self.clear()

    def clear(self) -> None:
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.entries: list[dict] = []

    def add(self, rid: str, page_id: int | None, raw: bytes) -> None:
        self.entries.append({"record_id": rid, "page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(raw)})
        self.open.append(raw)
        self.open_bytes += len(raw)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.codec.compress(b"".join(self.open))
            self.frames.append((len(packed), self.open_bytes))
            self.parts.append(packed)
            self.bytes += self.open_bytes
            self.open, self.open_bytes = [], 0

    def finish(self, name: str) -> pa.RecordBatch:
        self.close_frame()
        content = b"".join(self.parts) + seek_table(self.frames)
        batch = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([self.entries], pa.list_(_ENTRY))], schema=_BUNDLE)
        self.clear()
        return batch


def revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of each row that repeats a payload; digests only are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("bytes")).where(F.col("bytes") >= min_revisit)
    groups = keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    same = keys.join(groups, ["digest", "bytes"]).where(F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True)))
    return same.select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Write the rows (page_id, url, html) of pages as bundles into the table at path."""
    spark = pages.sparkSession
    small_batches(spark)
    # Stored, so that the planner knows the size and broadcasts the list only below its threshold.
    again = stored(revisits(pages, min_revisit), "revisits").withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.sha1("payload") == F.col("_digest")), "left").select("page_id", "url", "payload", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, n = BundleWriter(level), TaskContext.get().partitionId(), 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rid, raw = encode_record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to, date)
                writer.add(rid, page_id, raw)
                if writer.bytes >= BUNDLE_BYTES:
                    yield writer.finish(f"{part:06d}-{n:05d}")
                    n += 1
        if writer.entries:
            yield writer.finish(f"{part:06d}-{n:05d}")

    rows.mapInArrow(pack, BUNDLE_SCHEMA).write.option("compression", "none").parquet(path)


def index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: record_id, page_id, bundle, frame, offset, length."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "e.page_id", "bundle", "e.frame", "e.offset", "e.length")


_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
])
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _row(raw: bytes, with_payload: bool) -> tuple:
    headers, head, payload = decode_record(raw)
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
    return (page and int(page), size, digest, kind, refers and int(refers), headers.get("WARC-Target-URI"), payload if with_payload and kind == "response" else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles, parsed and checked against its digest; no shuffle."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                content, entries = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                spans, rows, frame, raw = frame_spans(content), [], -1, b""
                for e in entries:
                    if e["frame"] != frame:
                        frame = e["frame"]
                        at, size = spans[frame]
                        raw = codec.decompress(content[at : at + size])
                    rows.append(_row(raw[e["offset"] : e["offset"] + e["length"]], with_payload))
                if rows:
                    yield _batch(rows)

    return bundles.select("content", "entries").mapInArrow(unpack, READ_SCHEMA)


def fetch(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Only the named records (column record_id): one frame is unpacked for each."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                content, frame, offset, length = (c[i].as_py() for c in batch.columns)
                at, size = frame_spans(content)[frame]
                rows.append(_row(codec.decompress(content[at : at + size])[offset : offset + length], True))
            if rows:
                yield _batch(rows)

    places = index(bundles).join(record_ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame", "offset", "length")
    return bundles.select("bundle", "content").join(places, "bundle").select("content", "frame", "offset", "length").mapInArrow(unpack, READ_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark.read.schema(BUNDLE_SCHEMA).parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM g
"""
