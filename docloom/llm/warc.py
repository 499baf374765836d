"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with the
format's seek table, a skippable frame with every frame's sizes, and its index maps record
identifiers to (frame, offset in the frame, length). Bundles are rows of a table in the
shared folder, so writing is committed per task and lost executors rewrite only their own.

Payloads that occur once never leave their task; repeated ones are found from digests.

Defined cases: a null page is an empty payload; of equal payloads the rows with the
largest page_id are responses, so wholly repeated rows are responses alike; null ids count
as smallest. A null url is written as an empty target. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the digest and size of the payload it omits."""
    block = b"" if refers_to is not None else payload
    kind = "response" if refers_to is None else "revisit"
    uri = "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length and content differ")
    return headers, rest[:size]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(position, compressed, decompressed) of every frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no seek table without checksums")
    at = len(bundle) - 9 - 8 * count
    out, position = [], 0
    for k in range(count):
        sizes = struct.unpack("<II", bundle[at + 8 * k : at + 8 * k + 8])
        out.append((position, *sizes))
        position += sizes[0]
    return out


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.index: list[tuple[int | None, int, int, int]] = []
        self.open, self.open_bytes, self.size = [], 0, 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.open_bytes, len(raw)))
        self.open.append(raw)
        self.open_bytes += len(raw)
        if self.open_bytes >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.frames.append((len(packed), self.open_bytes))
            self.parts.append(packed)
            self.size += len(packed)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        return b"".join(self.parts) + seek_table(self.frames)


def read_at(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry, decompressing its frame only."""
    position, packed, size = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[position : position + packed], size)[offset : offset + length]


_BUNDLE = "bundle_id string, data binary, index array<struct<page_id:{0},frame:int,offset:int,length:int>>"


def roles(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload and, for revisits, the page_id of the response."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    ident = F.col(id_col) if pages.schema[id_col].dataType.simpleString() == "string" else F.col(id_col).cast("long")
    rows = pages.select(ident.alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    light = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    repeated = scratch.save(light.filter("n > 1").select("digest", "response"), "repeated")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, name: str = "bundles", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archive and return its bundles: bundle_id, data and index."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = roles(pages, scratch, id_col, url_col, html_col, least_bytes).withColumn("part", F.spark_partition_id())
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle_id", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("page_id", pa.int64() if kind != "string" else pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])
        writer, count, part = BundleWriter(), 0, None

        def out() -> pa.RecordBatch:
            data = writer.finish()
            entries = [dict(zip(("page_id", "frame", "offset", "length"), e, strict=True)) for e in writer.index]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{count:06d}"]), pa.array([data], pa.binary()), pa.array([entries], schema.field(2).type)], schema=schema)

        for batch in batches:
            for page_id, url, payload, refers, part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                writer.add(page_id, record(page_id, url, payload, refers))
                if writer.size >= BUNDLE_BYTES:
                    yield out()
                    writer, count = BundleWriter(), count + 1
        if writer.index:
            yield out()

    return scratch.save(rows.mapInArrow(run, _BUNDLE.format(kind)), name, compression="uncompressed")


def read(bundles: DataFrame) -> DataFrame:
    """All records by their index entries, verified against their digests.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for revisits).
    """
    kind = bundles.schema["index"].dataType.elementType["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = int if kind != "string" else str
        for batch in batches:
            for bundle, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, unpack = read_seek_table(bundle), zstandard.ZstdDecompressor()
                at, frame, rows = -1, b"", []
                for entry in index:
                    if entry["frame"] != at:
                        at = entry["frame"]
                        position, packed, size = table[at]
                        frame = unpack.decompress(bundle[position : position + packed], size)
                        if rows:
                            yield _records(rows, kind)
                            rows = []
                    h, payload = parse_record(frame[entry["offset"] : entry["offset"] + entry["length"]])
                    own = h["WARC-Record-ID"][10:-1]
                    refers = h["WARC-Refers-To"][10:-1] if h["WARC-Type"] == "revisit" else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if refers is None and base32_sha1(payload) != digest:
                        raise ValueError(f"digest of record {own} does not match its payload")
                    rows.append((ident(own) if own else None, h["WARC-Target-URI"], int(h["WARC-Payload-Length"]), digest, h["WARC-Type"], refers and ident(refers), payload if refers is None else None))
                if rows:
                    yield _records(rows, kind)

    return bundles.select("data", "index").mapInArrow(run, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def _records(rows: list[tuple], kind: str) -> pa.RecordBatch:
    own = pa.string() if kind == "string" else pa.int64()
    types = [own, pa.string(), pa.int64(), pa.string(), pa.string(), own, pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
