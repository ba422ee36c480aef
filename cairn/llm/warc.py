"""Seekable Zstandard bundles of WARC records.

Records are gathered into independent frames of about FRAME_BYTES; the file ends in the seek table of the seekable format
(a skippable frame with the sizes of all frames). A manifest maps each record's identifier to its file, frame and offset
in the frame, so one record costs one frame to read. Of pages with equal payloads that with the smallest id is a response
and the others are revisits that refer to it.

Bundles go to a folder that all executors share. A task that is run again writes files of its own, and the manifest, kept
as a table, names only those of the run that counted. Bundles are read back in as many tasks as their bytes ask for.

Defined cases: a null payload is empty; empty payloads are equal; a null id is written as absent, and sorts first; repeated
rows of the smallest id are all responses, and the identifiers of rows that repeat are told apart by the bundle and the place
in it, so their revisits name the page but no record; an empty table gives no file and an empty manifest; only the columns
named are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import broadcast_if_small, fresh_path, materialise

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 30
LEVEL = 3
#: Compressed bytes that one task reads back, about.
READ_BYTES = 32 << 20
#: Pages whose payload others have too are looked up by broadcast up to so many (of about 60 bytes), by shuffle beyond.
BROADCAST_ROWS = 200_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of addresses in RFC 9562
_DATE = "1970-01-01T00:00:00Z"

MANIFEST = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORDS = "record_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, bundle string, frame int, offset long, length long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}{place}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, place: str = "", sure: bool = True) -> tuple[str, bytes]:
    """(identifier, bytes) of one record. ``place`` tells rows apart that repeat; unless ``sure``, a revisit names no record, for there are several."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = record_id(page_id, digest, place)
    head = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = b""
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *([f"WARC-Refers-To: {record_id(refers_to, digest)}"] if sure else []), f"X-Payload-Length: {len(payload)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    else:
        head.append("Content-Type: application/http; msgtype=response")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return name, ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[dict]:
    """The records of one frame, each with its offset; raises if a payload differs from its digest."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        block = frame[start : start + size]
        payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
        yield {
            "record_id": head["WARC-Record-ID"],
            "page_id": number("X-Page-ID"),
            "record_type": head["WARC-Type"],
            "url": head.get("WARC-Target-URI"),
            "payload_bytes": len(payload) if payload is not None else number("X-Payload-Length"),
            "payload_digest": digest,
            "refers_to": number("X-Refers-To-Page-ID"),
            "payload": payload,
            "offset": at,
            "length": start + size + 4 - at,
        }
        at = start + size + 4


class BundleWriter:
    """One seekable file: ``add`` records, then ``close``."""

    def __init__(self, path: str) -> None:
        fs, at = _open(path)
        self.path, self.out = path, fs.open_output_stream(at, compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.start, self.buffer, self.waiting, self.rows = 0, bytearray(), [], []

    def add(self, name: str, page_id: int | None, record: bytes) -> None:
        self.waiting.append((name, page_id, len(self.buffer), len(record)))
        self.buffer += record
        if len(self.buffer) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.buffer))
        self.out.write(packed)
        self.rows += [(name, page, self.path, len(self.sizes), self.start, len(packed), offset, length) for name, page, offset, length in self.waiting]
        self.sizes.append((len(packed), len(self.buffer)))
        self.start += len(packed)
        self.buffer, self.waiting = bytearray(), []

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads single frames by the seek table at the end of the file."""

    def __init__(self, path: str) -> None:
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * entry, size - 9 - count * entry)
        self.frames, start = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((start, packed, plain))
            start += packed

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, start), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def classify(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, is_revisit, refers_to, twice, sure): the smallest id of each payload stays, the others refer to it.

    ``twice`` marks rows whose id and payload repeat, ``sure`` revisits to an id that doesn't.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"_sha": F.unhex(F.sha2("payload", 256)), "_id": F.coalesce("page_id", F.lit(0)), "_absent": F.col("page_id").isNull()})
    # facts by id and payload: a payload that very many pages have is spread over their ids
    each = materialise(rows.groupBy("_sha", "_id", "_absent").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")), "payload-digests")
    several = each.groupBy("_sha").agg(F.min(F.struct("page_id", "n")).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).select("_sha", "first")
    facts = each.drop("page_id").join(broadcast_if_small(several, BROADCAST_ROWS), "_sha")
    facts = materialise(facts.select("_sha", "_id", "_absent", (F.col("n") > 1).alias("twice"), "first"), "copies")
    out = rows.join(broadcast_if_small(facts, BROADCAST_ROWS), ["_sha", "_id", "_absent"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select("page_id", "url", "payload", revisit.alias("is_revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.coalesce("twice", F.lit(False)).alias("twice"), F.coalesce(F.col("first.n") == 1, F.lit(True)).alias("sure"))


def write_bundles(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Writes all pages and returns the manifest. ``folder`` must be shared by all executors; by default a new one in the session's shared folder."""
    folder = (folder or fresh_path(pages.sparkSession, "warc")).rstrip("/")
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)

    def write(batches):
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        out, writer = lambda w: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*w.rows, strict=True), schema, strict=True)], schema=schema), None
        for batch in batches:
            for page, url, payload, revisit, refers, twice, sure in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                writer = writer or BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                place = f"/{writer.path}/{len(writer.rows) + len(writer.waiting)}" if twice else ""
                name, record = build_record(page, url, payload, refers, revisit, place, sure)
                writer.add(name, page, record)
                if writer.start >= BUNDLE_BYTES:
                    writer.close()
                    yield out(writer)
                    writer = None
        if writer:
            writer.close()
            yield out(writer)

    return materialise(classify(pages, **names).mapInArrow(write, MANIFEST), "warc-manifest")


def read_bundles(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that a manifest names, frame by frame, each payload held against its digest."""
    fields = ["record_id", "page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if with_payload else []), "offset", "length"]
    types = dict(x.strip().split() for x in RECORDS.split(","))

    def read(batches):
        kind = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(f, kind[types[f]]) for f in ("bundle", "frame", *fields)])
        reader, path = None, None
        for batch in batches:
            for bundle, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bundle != path:
                    if reader:
                        reader.close()
                    reader, path = BundleReader(bundle), bundle
                rows = list(parse_records(reader.frame(frame)))
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(rows), pa.string()), pa.array([frame] * len(rows), pa.int32()), *(pa.array([r[f] for r in rows], kind[types[f]]) for f in fields)], schema=schema)
        if reader:
            reader.close()

    frames = manifest.groupBy("bundle", "frame").agg(F.max("frame_bytes").alias("size"))
    n, size = frames.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, min(n, max((size or 0) // READ_BYTES + 1, manifest.sparkSession.sparkContext.defaultParallelism)))
    frames = frames.select("bundle", "frame").repartition(tasks, "bundle", F.floor(F.col("frame") / 8)).sortWithinPartitions("bundle", "frame")
    return frames.mapInArrow(read, ", ".join(f"{f} {types[f]}" for f in ("bundle", "frame", *fields)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (strpos('0123456789abcdef', substr(x, (1 + 5 * (i // 4))::INT, 1)) - 1) * 65536 + (strpos('0123456789abcdef', substr(x, (2 + 5 * (i // 4))::INT, 1)) - 1) * 4096
    + (strpos('0123456789abcdef', substr(x, (3 + 5 * (i // 4))::INT, 1)) - 1) * 256 + (strpos('0123456789abcdef', substr(x, (4 + 5 * (i // 4))::INT, 1)) - 1) * 16
    + (strpos('0123456789abcdef', substr(x, (5 + 5 * (i // 4))::INT, 1)) - 1)) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
