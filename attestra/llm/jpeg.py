"""Baseline JPEG in numpy: a lossless writer for byte planes and a reader for intra frames.

The writer makes every sample of the plane one 8 x 8 block of that constant value. With a DC quantiser of 8 the block
is a single DC coefficient, sample - 128, and decodes to exactly that sample. Its Huffman table gives category c a code
of 12 - c bits, so that code, magnitude and a 4-bit end-of-block always take 16 bits: blocks encode and decode as
arrays, without a loop. The reader handles any baseline frame (any tables, restart intervals, up to three components
with subsampling) and takes the array path where the tables have that fixed width.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BLOCKS = 64  # a row of the plane, in blocks

_CODE = {}
code, size = 0, 4
for _c in range(8, -1, -1):
    _CODE[_c] = code
    code, size = (code + 1) << 1, size + 1
del code, size


def _unit(diff: int) -> int:
    c = abs(diff).bit_length()
    return (_CODE[c] << c | (diff if diff > 0 else diff + (1 << c) - 1 if diff else 0)) << 4


_ENCODE = np.array([_unit(d) for d in range(-255, 256)], ">u2")
_DECODE = np.full(4096, 0x7FFF, np.int32)
_DECODE[_ENCODE.astype(np.int64) >> 4] = np.arange(-255, 256)

# The zigzag order of the JPEG standard, by rule along the anti-diagonals.
ZIGZAG = np.array([8 * r + c for s in range(15) for r, c in ([(i, s - i) for i in range(8) if 0 <= s - i < 8][:: 1 if s % 2 else -1])])
_COS = np.array([[(1 / np.sqrt(2) if u == 0 else 1.0) * np.cos((2 * x + 1) * u * np.pi / 16) / 2 for u in range(8)] for x in range(8)])


@lru_cache(maxsize=256)
def _head(rows: int) -> bytes:
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    counts = bytes(1 if 4 <= n <= 12 else 0 for n in range(1, 17))
    return b"\xff\xd8" + segment(0xDB, b"\0\x08" + b"\x01" * 63) + segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * BLOCKS, 1, 1, 0x11, 0)) + segment(0xC4, b"\0" + counts + bytes(range(8, -1, -1))) + segment(0xC4, b"\x10" + bytes([0, 0, 0, 1] + [0] * 12) + b"\0") + segment(0xDA, b"\x01\x01\0\0\x3f\0")


def encode_plane(plane: np.ndarray) -> bytes:
    """A frame of which each block is one sample of the (rows, BLOCKS) byte plane."""
    v = plane.ravel().astype(np.int64) - 128
    body = _ENCODE[np.diff(v, prepend=0) + 255].tobytes()
    return _head(len(plane)) + body.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


class Frame(NamedTuple):
    width: int
    height: int
    blocks: np.ndarray | None  # (rows, columns) samples, where every block is constant by construction
    luma: np.ndarray | None  # (height, width) otherwise


class _Table(NamedTuple):
    codes: dict  # (length, code) -> symbol
    fixed: bool


class _Head(NamedTuple):
    width: int
    height: int
    parts: tuple  # (id, h, v, quantiser)
    quant: dict
    huff: dict
    scan: tuple  # (component index, dc, ac)
    restart: int
    fast: bool


@lru_cache(maxsize=64)
def _parse(head: bytes) -> _Head:
    quant, huff, parts, scan, restart, width, height, at = {}, {}, (), (), 0, 0, 0, 2
    while at < len(head):
        mark, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        b = head[at + 4 : at + 2 + n]
        if mark == 0xDB:
            while b:
                step = 64 * (1 + (b[0] >> 4))
                table = np.frombuffer(b[1 : 1 + step], ">u2" if b[0] >> 4 else np.uint8).astype(np.int64)
                quant[b[0] & 15], b = table, b[1 + step :]
        elif mark == 0xC4:
            while b:
                key, counts, code, codes, k = b[0], b[1:17], 0, {}, 17
                for bits, c in enumerate(counts, 1):
                    for _ in range(c):
                        codes[bits, code] = b[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                want = {(12 - c, _CODE[c]): c for c in _CODE} if key < 16 else {(4, 0): 0}
                huff[key], b = _Table(codes, codes == want), b[k:]
        elif mark in (0xC0, 0xC1):
            if b[0] != 8:
                raise ValueError("only 8-bit samples")
            height, width = struct.unpack_from(">HH", b, 1)
            parts = tuple((b[6 + 3 * i], b[7 + 3 * i] >> 4, b[7 + 3 * i] & 15, b[8 + 3 * i]) for i in range(b[5]))
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline frames")
        elif mark == 0xDD:
            restart = struct.unpack(">H", b[:2])[0]
        elif mark == 0xDA:
            ids = [p[0] for p in parts]
            scan = tuple((ids.index(b[1 + 2 * i]), b[2 + 2 * i] >> 4, b[2 + 2 * i] & 15) for i in range(b[0]))
        at += 2 + n
    fast = len(parts) == 1 and not restart and huff[scan[0][1]].fixed and huff[16 + scan[0][2]].fixed and quant[parts[0][3]][0] == 8
    return _Head(width, height, parts, quant, huff, scan, restart, fast)


def _coefficients(data: bytes, h: _Head) -> list[np.ndarray]:
    """Dequantised blocks (rows, columns, 64, natural order) of each component, bit by bit."""
    hm, vm = max(p[1] for p in h.parts), max(p[2] for p in h.parts)
    if len(h.parts) == 1:
        across, down, per = -(-h.width // 8), -(-h.height // 8), [(1, 1)]
    else:
        across, down, per = -(-h.width // (8 * hm)), -(-h.height // (8 * vm)), [(p[1], p[2]) for p in h.parts]
    out = [np.zeros((down * v, across * w, 64)) for w, v in per]
    intervals, start, i = [], 0, 0
    while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
        if 0xD0 <= data[i + 1] <= 0xD7:
            intervals.append(data[start:i])
            start = i + 2
        i += 2
    intervals.append(data[start:])
    mcu = 0
    for part in intervals:
        part = part.replace(b"\xff\0", b"\xff")
        bits, at, last = int.from_bytes(part + b"\xff\xff\xff\xff", "big"), 0, [0] * len(h.parts)
        total = 8 * (len(part) + 4)
        take = lambda n: (bits >> (total - at - n)) & ((1 << n) - 1)

        def symbol(table: _Table) -> int:
            nonlocal at
            for n in range(1, 17):
                if (s := table.codes.get((n, take(n)))) is not None:
                    at += n
                    return s
            raise ValueError("bad Huffman code")

        def magnitude(n: int) -> int:
            nonlocal at
            if not n:
                return 0
            v = take(n)
            at += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        for _ in range(h.restart or across * down):
            if mcu >= across * down:
                break
            for k, dc, ac in h.scan:
                w, v = per[k]
                for y in range(v):
                    for x in range(w):
                        block = out[k][mcu // across * v + y, mcu % across * w + x]
                        last[k] += magnitude(symbol(h.huff[dc]))
                        q = h.quant[h.parts[k][3]]
                        block[0] = last[k] * q[0]
                        z = 1
                        while z < 64:
                            s = symbol(h.huff[16 + ac])
                            if s == 0:
                                break
                            z += s >> 4
                            if s & 15:
                                block[ZIGZAG[z]] = magnitude(s & 15) * q[z]
                            z += 1
            mcu += 1
    return out


def decode(jpeg: bytes) -> Frame:
    """The luma of a baseline frame."""
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    h, data = _parse(jpeg[:at]), jpeg[at : jpeg.rindex(b"\xff\xd9")]
    if h.fast:
        units = np.frombuffer(data.replace(b"\xff\0", b"\xff"), ">u2").astype(np.int64)
        samples = np.cumsum(_DECODE[units >> 4]) + 128
        return Frame(h.width, h.height, samples.astype(np.uint8).reshape(-(-h.height // 8), -1), None)
    c = _coefficients(data, h)[0]
    rows, columns = c.shape[:2]
    pixels = np.einsum("xu,rcuv,yv->rxcy", _COS, c.reshape(rows, columns, 8, 8), _COS, optimize=True).reshape(rows * 8, columns * 8)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    y, most = h.parts[0], (max(p[1] for p in h.parts), max(p[2] for p in h.parts))
    if len(h.parts) > 1:
        pixels = pixels.repeat(most[1] // y[2], 0).repeat(most[0] // y[1], 1)
    return Frame(h.width, h.height, None, pixels[: h.height, : h.width])
