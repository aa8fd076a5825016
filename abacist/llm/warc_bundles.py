"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole records, and the seek table of the
public seekable format in a skippable frame at its end: compressed and decompressed size of every frame. A
reader of any frame needs the table and that frame only. The record index maps record identifiers to a frame
and the offset in the decompressed frame. Reading deals the index by bundle and runs of ``READ_FRAMES`` frames.

A payload that occurs more than once is stored once, in a ``response`` record of the row with the smallest
id; the others are ``revisit`` records that name it. Payloads are matched by their SHA-1 digest, their length and a second
hash, which also tells made-up SHA-1 collisions apart. Only these are shuffled: those that repeat are written as a table, which Spark broadcasts if it is small
and joins by a shuffle otherwise.

Null payloads count as empty. A null id comes after all others, as revisit if the payload has a row with an
id. Rows that share the smallest id of a payload are all responses. An empty table gives an empty table. Nulls in
``url`` leave the target empty. Each attempt writes files of its own name and the index names only those of
the attempt that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.workspace import as_bytes, fresh_path, slices, stored

#: Decompressed bytes after which a frame is closed, and frames after which a bundle is closed.
FRAME_BYTES, BUNDLE_FRAMES = 1 << 20, 512
#: Frames that one task reads one after another.
READ_FRAMES = 16
SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E
WARC_DATE = "1970-01-01T00:00:00Z"

KEY = ["digest", "n_bytes", "second"]
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, size long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the response's HTTP header, which tells the payload's length, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c >= " ")  # no line ends in a header
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(first, digest)}>", f"X-Refers-To-Page-ID: {first}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 4 + size + 4


class BundleWriter:
    """Writes one bundle; ``place`` of a record is known as soon as it is added."""

    def __init__(self, stream: pa.NativeFile):
        import zstandard

        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=3)
        self.buffer, self.held, self.sizes = [], 0, []

    def add(self, rec: bytes) -> tuple[int, int]:
        place = (len(self.sizes), self.held)
        self.buffer.append(rec)
        self.held += len(rec)
        if self.held >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.buffer))
            self.stream.write(packed)
            self.sizes.append((len(packed), self.held))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.stream.close()


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, uri: str):
        import zstandard

        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file, self.decompressor = store.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = struct.unpack(f"<{2 * n}I", self.file.read_at(8 * n, size - 9 - 8 * n))
        self.places, at = [], 0
        for packed, plain in zip(table[::2], table[1::2]):
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, _ = self.places[i]
        return self.decompressor.decompressobj().decompress(self.file.read_at(packed, at))


def firsts(pages: DataFrame) -> DataFrame:
    """``KEY`` and ``first`` id of the payloads that several rows have, stored. ``pages`` has the ``KEY``."""
    repeated = pages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    return stored(repeated.where("n > 1").drop("n"), "repeated-payloads")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the bundles; returns the stored record index. ``folder``: a URI for pyarrow's file systems."""
    spark = pages.sparkSession
    folder = (folder or fresh_path(spark, "warc")).rstrip("/")
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()),
                        ("offset", pa.int64()), ("size", pa.int64())])

    def write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = path = writer = name = None
        for batch in slices(batches, 1024):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "repeats", "first")]
            for page, url, sha1, repeats, first, html in zip(*columns, as_bytes(batch.column("html"))):
                if writer is None:
                    if store is None:
                        store, path = pyarrow.fs.FileSystem.from_uri(folder)
                        store.create_dir(path, recursive=True)
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None))
                payload = html or b""
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                rec = record(page, url, payload, digest, first, bool(repeats) and first is not None and page != first)
                rows.append((page, record_id(page, digest), f"{folder}/{name}", *writer.add(rec), len(rec)))
                if len(writer.sizes) >= BUNDLE_FRAMES:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if writer is not None:
            writer.close()

    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keyed = rows.withColumns({"digest": F.sha1(payload), "n_bytes": F.octet_length(payload), "second": F.xxhash64(payload)})
    joined = keyed.join(firsts(keyed).withColumn("repeats", F.lit(True)), KEY, "left")
    return stored(joined.select("page_id", "url", "html", "digest", "repeats", "first").mapInArrow(write_records, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """A row per record of the index, from the archives. Frames are read once each, in order."""
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string())])

    def row(frame: bytes, at: int) -> tuple:
        head, block, _ = parse(frame, at)
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head["WARC-Type"]
        digest = base32_sha1(payload) if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha1:")
        if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        size = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
        number = [int(x) if x else None for x in (head["X-Page-ID"], head.get("X-Refers-To-Page-ID", ""))]
        return number[0], size, digest, kind, number[1], head["WARC-Record-ID"].strip("<>"), head["WARC-Target-URI"]

    def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = reader = frame_no = frame = None
        for batch in slices(batches, 4096):
            rows = []
            for uri, number, at in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                if uri != bundle:
                    bundle, reader, frame_no = uri, BundleReader(uri), None
                if number != frame_no:
                    frame_no, frame = number, reader.frame(number)
                rows.append(row(frame, at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(spread, "bundle", F.floor(F.col("frame") / READ_FRAMES))
    return dealt.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read_records, out)
