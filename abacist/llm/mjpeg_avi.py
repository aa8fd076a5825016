"""AVI motion-JPEG columns: lossless intra frames, RIFF index parsing, and shots from histogram changes.

``wrap`` stores a payload as 24 x 24 grey frames of an AVI file, a byte a sample, in lossless JPEG (SOF3,
left predictor, 8 bits). Its Huffman table gives difference class ``c`` a code of ``16 - c`` bits, so that
code and extra bits are always two bytes; the stream is legal JPEG and can be coded with table look-ups over
whole files. ``unwrap`` walks the RIFF lists, finds the frames of the first video stream through the ``idx1`` index (or, without one, the ``movi``
list) and decodes them: its own kind for whole files at once, every other baseline or lossless JPEG frame by ``jpeg.decode``.

Shots: the grey histograms (16 bins) of neighbouring frames are compared by their L1 distance. A cut is where
that is a local maximum above the mean plus ``CUT_DEVIATIONS`` deviations of the distances in the
``WINDOW`` frames around it and above ``CUT_LEAST``; the threshold so follows the material. ``clips`` gives a timed row per shot.

Nulls count as empty texts: one frame of padding. A file that can't be decoded (null, not AVI, damaged, another codec, frames of
different sizes) gives a row of nulls but for its id, size and digest, and no clips. Equal texts give equal values, equal rows equal
rows. Tasks hold about ``HELD_BYTES`` of texts or files, or one that is longer. An empty table gives an empty table. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm import jpeg
from abacist.llm.workspace import as_bytes, slices

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
FRAMES_PER_SECOND = 25
#: Bytes of a column that are worked on together.
HELD_BYTES = 4 << 20
BINS, WINDOW, CUT_DEVIATIONS, CUT_LEAST = 16, 12, 2.0, 0.25


def _code_table() -> tuple[np.ndarray, list[int]]:
    """The two bytes of each difference from -255 to 255; the numbers of codes of 1 to 16 bits."""
    counts = [0] * 7 + [1] * 9
    first, code = {}, 0
    for bits in range(8, 17):
        first[16 - bits] = code  # class
        code = (code + 1) << 1
    table = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << c) - 1
        table[d + 255] = (first[c] << c) | extra
    return table, counts


CODES, CODE_COUNTS = _code_table()
DIFFERENCE = np.full(1 << 16, 1000, dtype=np.int16)
DIFFERENCE[CODES] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: SOI, DHT, SOF3 (8 bits, one component), SOS (predictor 1).
HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0, *CODE_COUNTS, *range(8, -1, -1)]))
    + _segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)
TAIL = b"\xff\xd9"


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of a frame."""
    return data + PAD * (FRAME - len(data) % FRAME if len(data) % FRAME or not data else 0)


def _coded(frames: np.ndarray) -> np.ndarray:
    """The two-byte codes of each sample's difference from its left neighbour (first column: from above)."""
    wide = frames.astype(np.int16)
    predicted = np.empty_like(wide)
    predicted[:, :, 1:] = wide[:, :, :-1]
    predicted[:, 1:, 0] = wide[:, :-1, 0]
    predicted[:, 0, 0] = 128
    return CODES[wide - predicted + 255]


def wrap(payload: bytes) -> bytes:
    """An AVI file whose frames' samples are the payload, a whole number of frames."""
    frames = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SIDE, SIDE)
    n = len(frames)
    codes = _coded(frames).astype(">u2").reshape(n, FRAME).view(np.uint8)
    if (codes == 255).any():  # a coded 255 is followed by 0
        images = [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + TAIL for row in codes]
        sizes = np.array([len(x) for x in images], dtype=np.int64)
        chunks = b"".join(b"00dc" + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for x in images)
    else:
        size = len(HEAD) + codes.shape[1] + len(TAIL)
        sizes = np.full(n, size, dtype=np.int64)
        lead = b"00dc" + struct.pack("<I", size) + HEAD
        tail = TAIL + b"\0" * (size & 1)
        grid = np.empty((n, len(lead) + codes.shape[1] + len(tail)), dtype=np.uint8)
        grid[:, : len(lead)] = np.frombuffer(lead, dtype=np.uint8)
        grid[:, len(lead) : -len(tail)] = codes
        grid[:, -len(tail) :] = np.frombuffer(tail, dtype=np.uint8)
        chunks = grid.tobytes()
    held = sizes + (sizes & 1) + 8
    index = np.empty((n, 4), dtype="<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10  # a key frame
    index[:, 2] = 4 + np.cumsum(held) - held
    index[:, 3] = sizes
    largest = int(sizes.max())
    avih = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 256, 0)
    strl = _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _list(b"hdrl", _chunk(b"avih", avih) + strl)
    body = b"AVI " + hdrl + _list(b"movi", chunks) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def riff_chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the body of each chunk in ``data[at:end]``."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def frame_places(media: bytes) -> np.ndarray:
    """Start and size of each frame of the first video stream: from the ``idx1`` index, else from the ``movi`` list."""
    data = memoryview(media)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index = None, None
    for name, a, b in riff_chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"LIST" and bytes(data[a : a + 4]) == b"movi":
            movi = (a, min(b, len(data)))
        elif name == b"idx1":
            index = np.frombuffer(data[a : a + (min(b, len(data)) - a) // 16 * 16], dtype="<u4").reshape(-1, 4)
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is None or not len(index):
        found = [(name, a, b - a) for name, a, b in _movie_chunks(data, movi[0] + 4, movi[1])]
        names = np.array([int.from_bytes(name, "little") for name, _, _ in found], dtype=np.int64)
        places = np.array([(a, n) for _, a, n in found], dtype=np.int64).reshape(-1, 2)
    else:
        names, places = index[:, 0].astype(np.int64), index[:, 2:].astype(np.int64)
        # offsets are counted from the list's name or from the start of the file
        first = int(places[0, 0])
        places[:, 0] += 8 + (0 if bytes(data[first : first + 4]) == int(names[0]).to_bytes(4, "little") and first > movi[0] else movi[0])
    video = np.isin(names >> 16, [int.from_bytes(b"dc", "little"), int.from_bytes(b"db", "little")])
    if not video.any():
        raise ValueError("an AVI file without frames")
    stream = names & 0xFFFF
    return places[video & (stream == stream[video].min())]


def _movie_chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    for name, a, b in riff_chunks(data, at, end):
        if name == b"LIST":
            yield from _movie_chunks(data, a + 4, min(b, end))
        elif b <= end:
            yield name, a, b


def frames_per_second(media: bytes) -> float:
    """From the main header's time of a frame; ``FRAMES_PER_SECOND`` where it has none."""
    at = media.find(b"avih", 0, 4096)
    micros = int.from_bytes(media[at + 8 : at + 12], "little") if at >= 0 else 0
    return 1_000_000 / micros if micros else float(FRAMES_PER_SECOND)


def _scan_start(image: bytes) -> int:
    """Where the coded samples start in a frame of this module's own kind; 0 for all others."""
    return len(HEAD) if image[: len(HEAD)] == HEAD and image[-len(TAIL) :] == TAIL else 0


def unwrap(media: bytes) -> np.ndarray:
    """The frames' grey samples, (frames, height, width), decoded from the file."""
    places = frame_places(media)
    raw, sizes = np.frombuffer(media, dtype=np.uint8), places[:, 1]
    begin, plain = len(HEAD), len(HEAD) + 2 * FRAME + len(TAIL)
    step = int(places[1, 0] - places[0, 0]) if len(places) > 1 else plain
    last = int(places[-1, 0] + sizes[-1])
    if (sizes == plain).all() and (np.diff(places[:, 0]) == step).all() and step >= plain and last <= len(media):
        grid = np.lib.stride_tricks.as_strided(raw[int(places[0, 0]) :], (len(places), plain), (step, 1))
        if (grid[:, :begin] == np.frombuffer(HEAD, dtype=np.uint8)).all():
            return _samples(np.ascontiguousarray(grid[:, begin : begin + 2 * FRAME]))
    images = [media[at : at + size] for at, size in places.tolist()]
    if all(map(_scan_start, images)):
        rows = [image[begin : -len(TAIL)].replace(b"\xff\x00", b"\xff") for image in images]
        if all(len(r) == 2 * FRAME for r in rows):
            return _samples(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(places), 2 * FRAME))
    decoded: list[np.ndarray] = []
    for image in images:
        # an empty chunk repeats the frame before it
        decoded.append(decoded[-1] if not image and decoded else jpeg.decode(image))
    if len({d.shape for d in decoded}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack(decoded)


def _samples(codes: np.ndarray) -> np.ndarray:
    """The samples of frames of this module's own kind."""
    differences = DIFFERENCE[codes.view(">u2").astype(np.uint16)].reshape(-1, SIDE, SIDE).astype(np.int32)
    if (differences > 255).any():
        raise ValueError("a code that no table has")
    differences[:, :, 0] = np.cumsum(differences[:, :, 0], axis=1) + 128
    return (np.cumsum(differences, axis=2) & 0xFF).astype(np.uint8)


def cuts(frames: np.ndarray) -> np.ndarray:
    """Numbers of the frames that start a new shot."""
    n = len(frames)
    if n < 3:
        return np.zeros(0, dtype=np.int64)
    pixels = frames[0].size
    bins = (frames.reshape(n, pixels) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    histograms = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * pixels)
    # integer sums: the windows' means don't depend on what is before them
    whole = np.rint(change * 2 * pixels).astype(np.int64)
    total, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (whole, whole * whole))
    at = np.arange(len(change))
    low, high = np.maximum(at - WINDOW, 0), np.minimum(at + WINDOW + 1, len(change))
    count = high - low
    mean = (total[high] - total[low]) / count
    deviation = np.sqrt(np.maximum((squares[high] - squares[low]) / count - mean * mean, 0))
    edge = np.concatenate([[-1], whole, [-1]])
    peak = (edge[1:-1] >= edge[:-2]) & (edge[1:-1] > edge[2:])
    return at[peak & (whole > mean + CUT_DEVIATIONS * deviation) & (change > CUT_LEAST)] + 1


def _by_bytes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most 256 rows and about ``HELD_BYTES`` of a column."""
    for batch in slices(batches, 256):
        kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else batch.column(column).type
        sizes = pa.compute.binary_length(batch.column(column).cast(kind)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // HELD_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` (unpadded) and the media column ``media`` of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, "text"):
            data = [x or b"" for x in as_bytes(batch.column("text"))]
            files = [wrap(padded(x)) for x in data]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, shots array<int>, n_frames int, frames_per_second double"
)


def features(files: DataFrame) -> DataFrame:
    """What the stored media bytes decode to: payload digests, and the shots as first frames. ``files``: ``doc_id, n_bytes, media``."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
         ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
         ("shots", pa.list_(pa.int32())), ("n_frames", pa.int32()), ("frames_per_second", pa.float64())]
    )

    def row(i: int | None, n: int | None, stored: bytes | None) -> tuple:
        if stored is None:
            return (i, n, *[None] * 9)
        whole = (len(stored), hashlib.sha256(stored).hexdigest())
        try:
            frames, rate = unwrap(stored), frames_per_second(stored)
        except (ValueError, IndexError):  # not a file that can be decoded
            return (i, n, None, None, None, *whole, *[None] * 4)
        payload, starts = frames.tobytes(), [0, *cuts(frames).tolist()]
        feature = f"frames={len(frames)};shots={','.join(map(str, starts))}"
        return (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *whole, feature, starts, len(frames), rate)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, "media"):
            rows = [row(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(decode, FEATURES)


def clips(found: DataFrame) -> DataFrame:
    """A timed row per shot: ``doc_id, clip, first_frame, n_frames, start_s, end_s``. ``found``: as ``features`` gives it."""
    last = F.coalesce(F.try_element_at("shots", F.col("clip") + 2), F.col("total"))
    rows = found.select("doc_id", F.col("n_frames").alias("total"), "frames_per_second", "shots", F.posexplode("shots").alias("clip", "first_frame"))
    return rows.select(
        "doc_id", "clip", "first_frame", (last - F.col("first_frame")).cast("int").alias("n_frames"),
        (F.col("first_frame") / F.col("frames_per_second")).alias("start_s"), (last / F.col("frames_per_second")).alias("end_s"),
    )
