"""PNG files by zlib: what images come in and go out as where no decoder library is there."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed value: the signature of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def write_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit RGBA image of shape (height, width, 4)."""
    h, w = pixels.shape[:2]
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = pixels.reshape(h, 4 * w)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def png_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header alone."""
    return struct.unpack(">II", data[16:24]) if data[:8] == SIGNATURE and data[12:16] == b"IHDR" and len(data) >= 24 else None


def bmp_size(data: bytes) -> tuple[int, int] | None:
    if data[:2] != b"BM" or len(data) < 26:
        return None
    w, h = struct.unpack("<ii", data[18:26])
    return w, abs(h)


def gif_size(data: bytes) -> tuple[int, int] | None:
    return struct.unpack("<HH", data[6:10]) if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10 else None


def unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG with their filters undone."""
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).copy()
        if kind == 1:
            cells = row.reshape(-1, step) if stride % step == 0 else None
            row = np.cumsum(cells, axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            line, up = row.tolist(), above.tolist()
            for x in range(stride):
                a = line[x - step] if x >= step else 0
                b = up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (line[x] + guess) & 255
            row = np.array(line, np.uint8)
        elif kind:
            raise ValueError(f"filter {kind}")
        out[y] = above = row
    return out


#: First column and row, and steps, of the passes of an interlaced file.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def samples(raw: bytes, w: int, h: int, n: int, depth: int) -> tuple[np.ndarray, int]:
    """The (h, w, n) samples of one pass, and how many bytes it took."""
    stride = (w * n * depth + 7) // 8
    rows = unfiltered(raw, h, stride, max(1, n * depth // 8))
    if depth == 16:
        rows = rows.view(">u2")
    elif depth < 8:
        rows = np.packbits(np.unpackbits(rows, axis=1).reshape(h, -1, depth), axis=2)[..., 0] >> (8 - depth)
    return rows[:, : w * n].reshape(h, w, n), h * (stride + 1)


def read_png(data: bytes) -> np.ndarray:
    """An RGBA image of shape (height, width, 4); of 16 bits the upper 8 are kept."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, parts, palette, clear = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth not in (1, 2, 4, 8, 16) or color not in CHANNELS:
                raise ValueError(f"PNG with {depth} bits and colour type {color}")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    n, raw = CHANNELS[color], zlib.decompress(b"".join(parts))
    if laced:
        found = np.zeros((h, w, n), np.uint16)
        for x, y, dx, dy in PASSES:
            pw, ph = -(-(w - x) // dx), -(-(h - y) // dy)
            if pw > 0 and ph > 0:
                found[y::dy, x::dx], used = samples(raw, pw, ph, n, depth)
                raw = raw[used:]
    else:
        found = samples(raw, w, h, n, depth)[0]
    out = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        index = found[..., 0].astype(np.uint8)
        out[..., :3] = palette[index]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[index]
        return out
    if clear is not None:  # one colour stands for clear
        out[(found == np.frombuffer(clear, ">u2")[:n]).all(axis=2), 3] = 0
    eight = (found >> 8 if depth == 16 else found * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out[..., :3] = eight[..., :1] if n < 3 else eight[..., :3]
    if color in (4, 6):
        out[..., 3] = eight[..., -1]
    return out
