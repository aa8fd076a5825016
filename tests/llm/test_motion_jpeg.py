"""Frames and files that other encoders write: baseline and lossless JPEG, indexes, damage; shots against plain loops."""

import hashlib
import math
import struct

import numpy as np
import pytest

from abacist.llm import jpeg, mjpeg_avi

#: Huffman tables: all symbols with codes of one length.
DC = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
AC_SYMBOLS = [0x00, 0xF0] + [16 * r + s for r in range(16) for s in range(1, 11)]
AC = bytes([0] * 7 + [len(AC_SYMBOLS)] + [0] * 8) + bytes(AC_SYMBOLS)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def coded(value: int) -> tuple[int, str]:
    """Class and extra bits."""
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def packed(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def zigzag() -> list[int]:
    order, r, c = [], 0, 0
    for _ in range(64):
        order.append(8 * r + c)
        if (r + c) % 2 == 0:
            r, c = (r, c + 1) if r == 0 and c < 7 else (r + 1, c) if c == 7 else (r - 1, c + 1)
        else:
            r, c = (r + 1, c) if c == 0 and r < 7 else (r, c + 1) if r == 7 else (r + 1, c - 1)
    return order


def block_bits(block: np.ndarray, scale: int, before: int, dc, ac) -> tuple[str, int]:
    cos = lambda x, k: math.cos((2 * x + 1) * k * math.pi / 16) * (0.5 if k else math.sqrt(1 / 8))
    base = np.array([[cos(x, k) for k in range(8)] for x in range(8)])
    quantised = np.rint(base.T @ (block.astype(float) - 128) @ base / scale).astype(int).ravel()[zigzag()].tolist()
    size, extra = coded(quantised[0] - before)
    bits, run = dc[size] + extra, 0
    last = max((i for i in range(1, 64) if quantised[i]), default=0)
    for v in quantised[1 : last + 1]:
        if not v:
            run += 1
            continue
        while run > 15:
            bits, run = bits + ac[0xF0], run - 16
        size, extra = coded(v)
        bits, run = bits + ac[16 * run + size] + extra, 0
    return bits + (ac[0] if last < 63 else ""), quantised[0]


def codes_of(table: bytes) -> dict[int, str]:
    out, code, at = {}, 0, 16
    for n in range(16):
        for _ in range(table[n]):
            out[table[at]] = format(code, f"0{n + 1}b")
            code, at = code + 1, at + 1
        code <<= 1
    return out


def baseline(planes, factors, scale=1, interval=0, own_tables=True) -> bytes:
    """Components in one scan; each plane padded to whole units by its edge."""
    height, width = planes[0].shape
    across, down = max(f[0] for f in factors), max(f[1] for f in factors)
    dc, ac = (codes_of(DC), codes_of(AC)) if own_tables else tuple(codes_of(bytes.fromhex(jpeg.STANDARD[k, 0])) for k in (0, 1))
    rows, columns = -(-height // (8 * down)), -(-width // (8 * across))
    parts, bits, before = [], "", [0] * len(planes)
    for unit in range(rows * columns):
        if interval and unit and unit % interval == 0:
            parts.append(packed(bits))
            bits, before = "", [0] * len(planes)
        r, c = divmod(unit, columns)
        for k, (plane, (h, v)) in enumerate(zip(planes, factors)):
            whole = np.pad(plane, ((0, rows * v * 8 - plane.shape[0]), (0, columns * h * 8 - plane.shape[1])), mode="edge")
            for y in range(v):
                for x in range(h):
                    a, b = 8 * (r * v + y), 8 * (c * h + x)
                    more, before[k] = block_bits(whole[a : a + 8, b : b + 8], scale, before[k], dc, ac)
                    bits += more
    parts.append(packed(bits))
    scan = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, 16 * h + v, 0]) for i, (h, v) in enumerate(factors))
    tables = segment(0xC4, b"\x00" + DC + b"\x10" + AC) if own_tables else b""
    return (b"\xff\xd8" + segment(0xE0, b"AVI1") + segment(0xDB, b"\x00" + bytes([scale] * 64)) + tables + segment(0xC0, frame)
            + (segment(0xDD, struct.pack(">H", interval)) if interval else b"")
            + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0])) + scan + b"\xff\xd9")


def lossless(image: np.ndarray, predictor: int) -> bytes:
    table = bytes([0, 0, 0, 10] + [0] * 12) + bytes(range(10))
    codes, bits, x = codes_of(table), "", image.astype(int)
    for r in range(x.shape[0]):
        for c in range(x.shape[1]):
            a, b, d = (x[r, c - 1] if c else 0), (x[r - 1, c] if r else 0), (x[r - 1, c - 1] if r and c else 0)
            if r == 0 or c == 0:
                guess = 128 if r == c == 0 else a if r == 0 else b
            else:
                guess = [a, b, d, a + b - d, a + (b - d) // 2, b + (a - d) // 2, (a + b) // 2][predictor - 1]
            size, extra = coded(int(x[r, c] - guess))
            bits += codes[size] + extra
    frame = struct.pack(">BHHB", 8, *image.shape, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + segment(0xC4, b"\x00" + table) + segment(0xC3, frame) + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + packed(bits) + b"\xff\xd9"


def avi(images, micros=50_000, index="relative", nested=False, sound=True) -> bytes:
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", micros, *[0] * 13)))
    start = 12 + len(head) + 8  # of the name movi
    movi, rows = b"movi", []
    for image in images:
        for name, body in ((b"01wb", b"sound"), (b"00dc", image))[not sound :]:
            rows.append((name, len(movi) + (12 if nested else 0) + (start if index == "absolute" else 0), len(body)))
            movi += chunk(b"LIST", b"rec " + chunk(name, body)) if nested else chunk(name, body)
    table = b"".join(n + struct.pack("<III", 16, a, b) for n, a, b in rows)
    body = b"AVI " + head + chunk(b"LIST", movi) + (chunk(b"idx1", table) if index else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:37, 0:51]
    return [np.clip(128 + 90 * np.sin(x / 9 + k) * np.cos(y / 7) + rng.normal(0, 3, y.shape), 0, 255).astype(np.uint8) for k in range(4)]


@pytest.mark.parametrize("factors,interval,own", [([(1, 1)], 0, True), ([(1, 1)], 3, False), ([(2, 2), (1, 1), (1, 1)], 0, False), ([(2, 1), (1, 1), (1, 1)], 2, True)])
def test_baseline_frames(pictures, factors, interval, own):
    across, down = max(f[0] for f in factors), max(f[1] for f in factors)
    planes = [p[:: down // v, :: across // h] for p, (h, v) in zip(pictures, factors)]
    got = jpeg.decode(baseline(planes, factors, 2, interval, own))
    assert got.shape == planes[0].shape and np.abs(got.astype(int) - planes[0]).max() <= 8 and np.abs(got.astype(int) - planes[0]).mean() < 1.2


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames(pictures, predictor):
    assert (jpeg.decode(lossless(pictures[0], predictor)) == pictures[0]).all()


@pytest.mark.parametrize("index,nested,sound", [("relative", False, True), ("absolute", False, True), (None, False, False), (None, True, True), ("relative", True, False)])
def test_files(pictures, index, nested, sound):
    images = [lossless(p, 1) for p in pictures]
    got = mjpeg_avi.unwrap(avi([*images, b""], index=index, nested=nested, sound=sound))
    assert (got == np.stack([*pictures, pictures[-1]])).all()


def plain_cuts(frames: np.ndarray) -> list[int]:
    """By loops: L1 distances of histograms, local maxima over the mean and deviations of their windows."""
    histograms = [[int((f >> 4 == b).sum()) for b in range(16)] for f in frames]
    change = [sum(abs(p - q) for p, q in zip(a, b)) for a, b in zip(histograms, histograms[1:])]
    out = []
    for i, d in enumerate(change):
        near = change[max(0, i - mjpeg_avi.WINDOW) : i + mjpeg_avi.WINDOW + 1]
        mean = sum(near) / len(near)
        deviation = math.sqrt(max(0.0, sum(x * x for x in near) / len(near) - mean * mean))
        peak = (i == 0 or d >= change[i - 1]) and (i + 1 == len(change) or d > change[i + 1])
        if len(frames) > 2 and peak and d > mean + mjpeg_avi.CUT_DEVIATIONS * deviation and d / (2 * frames[0].size) > mjpeg_avi.CUT_LEAST:
            out.append(i + 1)
    return out


def test_shots_against_loops():
    rng = np.random.default_rng(4)
    for n, side in [(1, 4), (2, 4), (3, 4), (60, 8), (200, 24)] * 4:
        levels = np.repeat(rng.integers(0, 256, n), rng.integers(1, 30, n))[:n]
        frames = np.clip(levels[:, None, None] + rng.normal(0, 12, (n, side, side + 1)), 0, 255).astype(np.uint8)
        assert mjpeg_avi.cuts(frames).tolist() == plain_cuts(frames)


def test_features_of_given_files(spark, pictures):
    """A media column of files from elsewhere: shots and times, and nulls for what can't be decoded."""
    dark, light = np.zeros((16, 16), np.uint8), np.full((16, 16), 200, np.uint8)
    film = avi([lossless(x, 4) for x in [dark] * 20 + [light] * 10 + [dark] * 5], micros=40_000)
    progressive = avi([lossless(dark, 1).replace(b"\xff\xc3", b"\xff\xc2")])
    cut = film[: len(film) // 2]
    rows = [(1, film), (2, film), (3, None), (4, b"not a film"), (5, progressive), (6, avi([])), (7, avi([lossless(dark, 1), lossless(pictures[0], 1)])), (8, avi([lossless(dark, 1)[:-9]])), (9, cut)]
    table = spark.createDataFrame([(i, None, m and bytearray(m), "x") for i, m in rows], "doc_id long, n_bytes long, media binary, shots string")
    got = {r["doc_id"]: r for r in mjpeg_avi.features(table).collect()}
    assert got[1]["feature"] == got[2]["feature"] == "frames=35;shots=0,20,30" and got[1]["payload_bytes"] == 35 * 256
    assert got[1]["media_sha256"] == hashlib.sha256(film).hexdigest() and got[3]["media_sha256"] is None
    assert all(got[i]["feature"] is None and got[i]["shots"] is None for i in (3, 4, 5, 6, 7, 8)) and got[5]["media_bytes"] == len(progressive)
    clips = [tuple(r)[1:] for r in mjpeg_avi.clips(mjpeg_avi.features(table)).where("doc_id = 1").orderBy("clip").collect()]
    assert clips == [(0, 0, 20, 0.0, 0.8), (1, 20, 10, 0.8, 1.2), (2, 30, 5, 1.2, 1.4)]


def test_a_text_of_many_megabytes(spark):
    texts = ["é" * 3_000_000, "short", None, "é" * 3_000_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in mjpeg_avi.features(mjpeg_avi.media(table)).collect()}
    for i, text in enumerate(texts):
        stored = mjpeg_avi.wrap(mjpeg_avi.padded((text or "").encode()))
        assert (got[i]["n_bytes"], got[i]["media_sha256"]) == (len((text or "").encode()), hashlib.sha256(stored).hexdigest())
