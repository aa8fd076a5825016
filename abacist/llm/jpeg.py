"""Decoding of intra frames: baseline and lossless JPEG with any Huffman and quantisation tables.

Baseline (SOF0, and SOF1 of 8 bits): any sampling factors and restart intervals, in one or several scans. Lossless (SOF3): all seven
predictors, components without subsampling. Frames without tables, as motion JPEG may leave them out, take the standard's.
Whatever else is found (progressive, arithmetic, 12 bits, damaged data) raises ``ValueError``.
"""

from __future__ import annotations

import functools
import re

import numpy as np

#: Coefficient numbers in zigzag order: by diagonals, in alternating direction.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
#: The inverse transform's matrix.
_COSINES = np.array([[(0.5 if k else 0.5**1.5) * np.cos((2 * x + 1) * k * np.pi / 16) for k in range(8)] for x in range(8)])

#: The Huffman tables of the JPEG standard (counts of codes by length, then symbols), by class and number.
STANDARD = {
    (0, 0): "00010501010101010100000000000000 000102030405060708090a0b",
    (0, 1): "00030101010101010101010000000000 000102030405060708090a0b",
    (1, 0): "0002010303020403050504040000017d "
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    (1, 1): "00020102040403040705040400010277 "
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
}


@functools.lru_cache(maxsize=64)
def huffman(table: bytes) -> list[int]:
    """For each next 16 bits, 256 times the length of the code there plus its symbol; 0 where no code is."""
    out = np.zeros(1 << 16, dtype=np.int64)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            if at >= len(table) or code >= 1 << bits:
                raise ValueError("a damaged Huffman table")
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = 256 * bits + table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


class Bits:
    """The bits of one entropy-coded segment."""

    def __init__(self, data: bytes):
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 4, dtype=np.uint8)).astype(np.int64)
        n = len(bits) - 16
        peek = np.zeros(n, dtype=np.int64)
        for i in range(16):
            peek = (peek << 1) | bits[i : i + n]
        self.peek, self.at, self.end = peek.tolist(), 0, n - 16

    def symbol(self, table: list[int]) -> int:
        if self.at > self.end:
            raise ValueError("a frame that ends early")
        found = table[self.peek[self.at]]
        if not found:
            raise ValueError("a code that no table has")
        self.at += found >> 8
        return found & 255

    def number(self, bits: int) -> int:
        """The signed number of that many bits."""
        if not bits:
            return 0
        if self.at > self.end:
            raise ValueError("a frame that ends early")
        value = self.peek[self.at] >> (16 - bits)
        self.at += bits
        return value if value >> (bits - 1) else value - (1 << bits) + 1


def decode(image: bytes) -> np.ndarray:
    """The samples of the first component (grey or luma), (height, width), 8 bits."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    tables = {k: bytes.fromhex(v) for k, v in STANDARD.items()}
    scales: dict[int, np.ndarray] = {}
    frame = planes = None
    interval, at = 0, 2
    while at + 4 <= len(image):
        if image[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = image[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                scales[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1, 0xC3):
            frame = _Frame(marker == 0xC3, body)
            planes = frame.planes()
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("a kind of frame that isn't decoded")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            end = next((m.start() for m in re.compile(rb"\xff[^\x00\xd0-\xd7]").finditer(image, at)), len(image))
            parts = [Bits(x) for x in re.split(rb"\xff[\xd0-\xd7]", image[at:end])]
            scan = [(frame.number(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            if frame.lossless:
                frame.lossless_scan(planes, scan, tables, parts, interval, predictor=body[1 + 2 * body[0]], shift=body[3 + 2 * body[0]] & 15)
            else:
                frame.baseline_scan(planes, scan, tables, parts, interval)
            at = end
    if frame is None:
        raise ValueError("no frame")
    return frame.luma(planes, scales)


class _Frame:
    def __init__(self, lossless: bool, body: bytes):
        self.lossless, precision = lossless, body[0]
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if precision != 8 or not self.height or not self.width or not body[5]:
            raise ValueError("a kind of frame that isn't decoded")
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        self.across, self.down = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if not all(p[1] and p[2] for p in self.parts) or lossless and any(p[1:3] != self.parts[0][1:3] for p in self.parts):
            raise ValueError("sampling factors that aren't decoded")

    def number(self, name: int) -> int:
        return [p[0] for p in self.parts].index(name)

    def blocks(self, i: int) -> tuple[int, int]:
        """Rows and columns of blocks that component ``i`` has by its own size."""
        _, h, v, _ = self.parts[i]
        return -(-(-(-self.height * v // self.down)) // 8), -(-(-(-self.width * h // self.across)) // 8)

    def units(self) -> tuple[int, int]:
        return -(-self.height // (8 * self.down)), -(-self.width // (8 * self.across))

    def planes(self) -> list[np.ndarray]:
        if self.lossless:
            return [np.zeros((self.height, self.width), dtype=np.int64) for _ in self.parts]
        rows, columns = self.units()
        return [np.zeros((rows * v, columns * h, 64), dtype=np.int64) for _, h, v, _ in self.parts]

    def baseline_scan(self, planes: list[np.ndarray], scan: list[tuple[int, int]], tables: dict, parts: list[Bits], interval: int) -> None:
        alone = len(scan) == 1
        rows, columns = self.blocks(scan[0][0]) if alone else self.units()
        chosen = [(planes[i], *((1, 1) if alone else self.parts[i][1:3]), huffman(tables[0, t >> 4]), huffman(tables[1, t & 15])) for i, t in scan]
        before = [0] * len(scan)
        zigzag = ZIGZAG.tolist()
        for unit in range(rows * columns):
            if interval and unit % interval == 0:
                before = [0] * len(scan)
            bits = parts[unit // interval if interval else 0]
            r, c = divmod(unit, columns)
            for k, (plane, h, v, dc, ac) in enumerate(chosen):
                for y in range(v):
                    for x in range(h):
                        before[k] += bits.number(bits.symbol(dc) & 15)
                        block = plane[r * v + y, c * h + x]
                        block[0] = before[k]
                        j = 1
                        while j < 64:
                            s = bits.symbol(ac)
                            if s & 15:
                                j += s >> 4
                                if j > 63:
                                    raise ValueError("a block of too many coefficients")
                                block[zigzag[j]] = bits.number(s & 15)
                                j += 1
                            elif s == 0xF0:
                                j += 16
                            else:
                                break

    def lossless_scan(self, planes: list[np.ndarray], scan: list[tuple[int, int]], tables: dict, parts: list[Bits], interval: int, predictor: int, shift: int) -> None:
        if interval or not 1 <= predictor <= 7:
            raise ValueError("a lossless scan that isn't decoded")
        coders = [huffman(tables[0, t >> 4]) for _, t in scan]
        n, bits = self.height * self.width, parts[0]
        differences = np.empty((n, len(scan)), dtype=np.int64)
        for k in range(n):
            for j, coder in enumerate(coders):
                s = bits.symbol(coder)
                differences[k, j] = 1 << 15 if s == 16 else bits.number(s)
        for j, (i, _) in enumerate(scan):
            planes[i][:] = _predicted(differences[:, j].reshape(self.height, self.width), predictor, 1 << (7 - shift)) << shift

    def luma(self, planes: list[np.ndarray], scales: dict[int, np.ndarray]) -> np.ndarray:
        if self.lossless:
            return (planes[0] & 255).astype(np.uint8)
        _, h, v, scale = self.parts[0]
        if scale not in scales:
            raise ValueError("a frame without its quantisation table")
        factors = np.empty(64)
        factors[ZIGZAG] = scales[scale]
        blocks = (planes[0] * factors).reshape(*planes[0].shape[:2], 8, 8)
        samples = _COSINES @ blocks @ _COSINES.T + 128
        whole = samples.transpose(0, 2, 1, 3).reshape(8 * planes[0].shape[0], -1)
        grey = np.clip(np.rint(whole), 0, 255).astype(np.uint8)
        if (h, v) != (self.across, self.down):
            grey = grey.repeat(self.down // v, axis=0).repeat(self.across // h, axis=1)
        return grey[: self.height, : self.width]


def _predicted(differences: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """Samples from their differences (modulo 2^16)."""
    out = differences.copy()
    out[0, 0] += start
    out[0] = np.cumsum(out[0])
    if predictor == 1:
        out[1:, 0] = out[0, 0] + np.cumsum(out[1:, 0])
        out[1:] = np.cumsum(out[1:], axis=1)
        return out & 0xFFFF
    for r in range(1, len(out)):
        up = out[r - 1]
        left = out[r, 0] = (out[r, 0] + up[0]) & 0xFFFF
        for c in range(1, out.shape[1]):
            a, b, d = int(left), int(up[c]) & 0xFFFF, int(up[c - 1]) & 0xFFFF
            guess = (a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[predictor - 1]
            left = out[r, c] = (out[r, c] + guess) & 0xFFFF
    return out & 0xFFFF

