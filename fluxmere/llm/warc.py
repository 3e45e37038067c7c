"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import local_path, new_path, settled, stored

# Magic numbers of the seekable format (skippable frames, seek table footer).
SKIPPABLE_TABLE, SKIPPABLE_MAP, SEEK_FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, record_length long"
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " url string, record_id string, bundle string, frame int, frame_offset long, digest_ok boolean"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, url: str | None, date: str, payload: bytes, size: int, sha: str, refers: str | None) -> bytes:
    """One WARC/1.1 record over an HTTP response; a revisit keeps the header, with the full length, and no payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, dict, bytes]:
    """(WARC header, HTTP header, payload) of one record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: {k.lower(): v for k, _, v in (x.partition(": ") for x in b.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


class BundleWriter:
    """Appends records; closes a frame at ``frame_bytes`` and writes map and seek table at the end.

    The file appears under its name only when it is whole, so a lost or repeated task leaves no half
    archive that an index row could name.
    """

    def __init__(self, folder: str, frame_bytes: int, level: int):
        os.makedirs(folder, exist_ok=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.frame_bytes = f"{folder}/{self.name}", frame_bytes
        self.file = open(f"{self.path}.part", "wb")  # noqa: SIM115
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.frames, self.entries, self.raw = [], 0, [], [], 0

    def add(self, record_id: str, raw: bytes) -> tuple[int, int]:
        if self.held and self.held_bytes + len(raw) > self.frame_bytes:
            self._flush()
        at = (len(self.frames), self.held_bytes)
        self.entries.append((record_id, *at, len(raw)))
        self.held.append(raw)
        self.held_bytes += len(raw)
        self.raw += len(raw)
        return at

    def _flush(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.file.write(packed)
        self.frames.append((len(packed), self.held_bytes))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        ids = "\n".join(e[0] for e in self.entries).encode()
        body = struct.pack("<II", len(self.entries), len(ids)) + ids + b"".join(struct.pack("<IQQ", *e[1:]) for e in self.entries)
        body = self.zstd.compress(body)
        self.file.write(struct.pack("<II", SKIPPABLE_MAP, len(body)) + body)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_FOOTER)
        self.file.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        os.replace(f"{self.path}.part", self.path)


class BundleReader:
    """Random access: the footer gives the frames, the map the place of each record in its frame."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        size = os.fstat(self.file.fileno()).st_size
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER:
            raise ValueError(f"{path}: no seek table")
        table = self._at(size - 9 - 8 * count, 8 * count)
        self.starts, self.sizes, at = [], [], 0
        for k in range(count):
            packed, raw = struct.unpack_from("<II", table, 8 * k)
            self.starts.append((at, packed))
            self.sizes.append(raw)
            at += packed
        magic, length = struct.unpack("<II", self._at(at, 8))
        body = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length))
        n, id_bytes = struct.unpack_from("<II", body)
        ids = body[8 : 8 + id_bytes].decode().split("\n")
        self.entries = {i: struct.unpack_from("<IQQ", body, 8 + id_bytes + 20 * k) for k, i in enumerate(ids[:n])}

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._at(*self.starts[k]), max_output_size=self.sizes[k])

    def get(self, record_id: str) -> bytes:
        k, at, n = self.entries[record_id]
        return self.frame(k)[at : at + n]

    def records(self):
        """(record id, frame, offset in it, bytes), a frame at a time."""
        held, data = -1, b""
        for i, (k, at, n) in self.entries.items():
            if k != held:
                held, data = k, self.frame(k)
            yield i, k, at, data[at : at + n]

    def close(self) -> None:
        self.file.close()


def number(record_id: str) -> int | None:
    tail = record_id.rpartition(":")[2]
    return int(tail) if tail != "null" else None


def write_archives(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write one record a row of ``pages`` (page_id, url, html) and return the index table.

    Rows of equal payloads of at least ``least`` bytes are grouped by SHA-1: the smallest page_id is
    the response, the others revisit it. Null html is the empty payload; a null page_id comes after
    all others; of repeated rows with one page_id, the first row is the response; a null url becomes
    about:blank; other columns are not read. An empty table gives no archive and an empty index.
    The group's first row is found by a partial aggregate, and joined back by digest, so a payload
    that many rows share is a skewed join that AQE splits, never one task. Input that comes out of a
    shuffle is written first: rows are told apart by their place.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = settled(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload")), "warc-pages")
    rows = pages.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    place = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    first = rows.filter(F.col("size") >= least).groupBy(F.col("sha").alias("sha_")).agg(F.min(place).alias("first"))
    known = rows.join(first, (F.col("sha") == F.col("sha_")) & (F.col("size") >= least), "left")
    own = F.col("first").isNull() | (F.col("first.row") == F.col("row"))
    out = known.select("page_id", "url", "row", F.when(own, F.col("payload")).alias("payload"), "size", "sha", "first")
    target = local_path(folder)

    def run(batches):
        writer = None
        for b in batches:
            rows = []
            for page, url, row, payload, size, sha, first in zip(*(b.column(k) for k in range(7)), strict=True):
                data, name = payload.as_py(), f"urn:fluxmere:{row}:{'null' if page.as_py() is None else page}"
                kind = "revisit" if data is None else "response"
                f = first.as_py()
                refers = None if kind == "response" else f"urn:fluxmere:{f['row']}:{'null' if f['page_id'] is None else f['page_id']}"
                raw = record(kind, name, url.as_py(), date, data, size.as_py(), base64.b32encode(bytes.fromhex(sha.as_py())).decode(), refers)
                if writer is None:
                    writer = BundleWriter(target, frame_bytes, level)
                k, at = writer.add(name, raw)
                rows.append((page.as_py(), name, writer.name, k, at, len(raw)))
                if writer.raw >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=["page_id", "record_id", "bundle", "frame", "frame_offset", "record_length"],
            )
        if writer is not None:
            writer.close()

    return stored(out.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read every bundle that ``index`` names, frame by frame, and check each response's digest."""
    target = local_path(folder)
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, min(bundles.count(), 20_000)))

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "bundle", "frame", "frame_offset", "digest_ok"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
        for b in batches:
            for bundle in b.column(0).to_pylist():
                reader, rows = BundleReader(f"{target}/{bundle}"), []
                for name, k, at, raw in reader.records():
                    warc, http, payload = parse(raw)
                    said = warc["warc-payload-digest"].removeprefix("sha1:")
                    again = warc["warc-type"] == "revisit"
                    sha, size = (said, int(http["content-length"])) if again else (digest(payload), len(payload))
                    refers = number(warc["warc-refers-to"].strip("<>")) if again else None
                    rows.append((number(name), size, sha, warc["warc-type"], refers, warc["warc-target-uri"], name, bundle, k, at, sha == said))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return bundles.mapInArrow(run, READ)


def op1(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, folder)


OP1_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
