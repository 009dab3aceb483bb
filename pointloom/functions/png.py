"""PNG images of eight bits a sample, written and read with numpy and zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (grey, red-green-blue, palette, grey with alpha, colours with alpha).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width) greys or (height, width, 3) colours from 0 to 255."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    height, width = pixels.shape[:2]
    colour = {2: 0, 3: 2}[pixels.ndim]
    rows = np.zeros((height, 1 + pixels[0].size), np.uint8)  # no filter
    rows[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _paeth(left: int, up: int, corner: int) -> int:
    """Of the three neighbours the one nearest to left + up - corner; the first of equally near ones."""
    guess = left + up - corner
    return min((left, up, corner), key=lambda v: abs(guess - v))


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:  # differences to the pixel on the left
        return np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out = [0] * step + row.tolist()
    up = [0] * step + above.tolist()
    for i in range(step, len(out)):
        near = (out[i - step] + up[i]) // 2 if kind == 3 else _paeth(out[i - step], up[i], up[i - step])
        out[i] = (out[i] + near) & 255
    return np.array(out[step:], np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The samples of a PNG of eight bits that is not interlaced: (height, width) or (height, width, samples).

    Of an image with a palette these are the numbers of the colours, as masks mean them.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in SAMPLES:
        raise ValueError("only PNG of eight bits without interlacing is read")
    step = SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for k in range(height):
        above = out[k] = _unfilter(int(rows[k, 0]), rows[k, 1:], above, step)
    return out.reshape(height, width) if step == 1 else out.reshape(height, width, step)
