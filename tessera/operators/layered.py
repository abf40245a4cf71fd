"""Photoshop documents, radiance maps and Softimage pictures as RGBA arrays: formats of planes packed in runs."""

from __future__ import annotations

import re
import struct

import numpy as np

GAMMA = 2.2  #: by which radiance is brought into eight bits


def unpacked_bits(data: bytes, at: int, end: int, size: int) -> bytes:
    """A row of PackBits: a count below 128 is followed by that many bytes and one more, one above by a byte to repeat."""
    out, end = bytearray(), min(end, len(data))
    while at < end and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    if len(out) != size:
        raise ValueError("broken PSD file")
    return bytes(out)


def psd_size(data: bytes) -> tuple[int, int] | None:
    if not data.startswith(b"8BPS\0\1") or len(data) < 26:
        return None
    h, w = struct.unpack(">II", data[14:22])
    return (w, h) if w and h else None


def read_psd(data: bytes) -> np.ndarray:
    """The merged picture of a document in red, green and blue (and alpha) or grey, 8 or 16 bits."""
    size = psd_size(data)
    if size is None:
        raise ValueError("broken PSD file")
    w, h = size
    channels, (depth, mode), at = struct.unpack(">H", data[12:14])[0], struct.unpack(">HH", data[22:26]), 26
    if depth not in (8, 16) or mode not in (1, 3):
        raise ValueError("unsupported PSD file")
    for _ in range(3):  # colours, resources, layers
        if at + 4 > len(data):
            raise ValueError("broken PSD file")
        at += 4 + struct.unpack(">I", data[at : at + 4])[0]
    if at + 2 > len(data):
        raise ValueError("broken PSD file")
    packed, wide = struct.unpack(">H", data[at : at + 2])[0], depth // 8
    at += 2
    if packed == 0:
        raw = data[at : at + channels * h * w * wide]
    elif packed == 1:
        counts = np.frombuffer(data, ">u2", channels * h, at)
        at += 2 * channels * h
        ends = at + np.cumsum(counts, dtype=np.int64)
        raw = b"".join(unpacked_bits(data, int(end - n), int(end), w * wide) for n, end in zip(counts, ends, strict=True))
    else:
        raise ValueError("unsupported PSD file")
    if len(raw) != channels * h * w * wide:
        raise ValueError("broken PSD file")
    planes = np.frombuffer(raw, ">u2" if wide == 2 else "u1").reshape(channels, h, w)
    planes = (planes >> 8 if wide == 2 else planes).astype(np.uint8)
    out = np.full((h, w, 4), 255, np.uint8)
    colours = 3 if mode == 3 else 1
    if channels < colours:
        raise ValueError("broken PSD file")
    out[..., :3] = planes[:colours].transpose(1, 2, 0)
    if channels > colours:
        alpha = planes[colours]
        out[..., 3] = alpha
        # The merged picture stands on white; that is taken out again where something shows through.
        part = (alpha > 0) & (alpha < 255)
        share = alpha[part].astype(np.float64)[:, None] / 255
        out[part, :3] = np.clip(np.rint((out[part, :3] - 255 * (1 - share)) / share), 0, 255)
    return out


HDR_HEAD = re.compile(rb"#\?(?:RADIANCE|RGBE)\n(?:[^\n]*\n)*?\n-Y (\d+) \+X (\d+)\n")


def hdr_size(data: bytes) -> tuple[int, int] | None:
    m = HDR_HEAD.match(data[:4096])
    return (int(m[2]), int(m[1])) if m and int(m[1]) and int(m[2]) else None


def read_hdr(data: bytes) -> np.ndarray:
    """A radiance map of shared exponents, brought into eight bits by GAMMA."""
    m = HDR_HEAD.match(data[:4096])
    if not m or b"FORMAT=32-bit_rle_rgbe" not in data[: m.end()]:
        raise ValueError("unsupported HDR file")
    h, w, at = int(m[1]), int(m[2]), m.end()
    rows = np.zeros((h, 4, w), np.uint8)
    for y in range(h):
        if not (8 <= w < 32768 and data[at : at + 2] == b"\2\2" and at + 4 <= len(data) and data[at + 2] << 8 | data[at + 3] == w):
            flat = data[at : at + 4 * w * (h - y)]
            if len(flat) < 4 * w * (h - y):
                raise ValueError("broken HDR file")
            rows[y:] = np.frombuffer(flat, np.uint8).reshape(h - y, w, 4).transpose(0, 2, 1)
            break
        at += 4
        for plane in range(4):
            x = 0
            while x < w:
                if at + 1 >= len(data):
                    raise ValueError("broken HDR file")
                n = data[at]
                run, n = n > 128, n - 128 if n > 128 else n
                part = data[at + 1 : at + 2] * n if run else data[at + 1 : at + 1 + n]
                if not n or x + n > w or len(part) != n:
                    raise ValueError("broken HDR file")
                rows[y, plane, x : x + n] = np.frombuffer(part, np.uint8)
                at, x = at + 1 + (1 if run else n), x + n
    exponent = rows[:, 3].astype(np.int64)
    light = rows[:, :3].transpose(0, 2, 1) * np.where(exponent > 0, np.ldexp(1.0, exponent - 136), 0.0)[..., None]
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = np.clip(light ** (1 / GAMMA) * 255 + 0.5, 0, 255)
    return out


PIC_MAGIC = b"\x53\x80\xf6\x34"


def pic_size(data: bytes) -> tuple[int, int] | None:
    if not data.startswith(PIC_MAGIC) or data[88:92] != b"PICT" or len(data) < 104:
        return None
    w, h = struct.unpack(">HH", data[92:96])
    return (w, h) if w and h else None


def read_pic(data: bytes) -> np.ndarray:
    """A picture whose packets say which channels they hold and how they are packed."""
    size = pic_size(data)
    if size is None:
        raise ValueError("broken PIC file")
    (w, h), at, packets = size, 104, []
    while True:
        if at + 4 > len(data) or len(packets) > 10:
            raise ValueError("broken PIC file")
        more, bits, kind, channels = data[at : at + 4]
        at += 4
        if bits != 8 or kind not in (0, 1, 2):
            raise ValueError("unsupported PIC file")
        packets.append((kind, [c for c in range(4) if channels & 0x80 >> c]))
        if not more:
            break
    out = np.full((h, w, 4), 255, np.uint8)
    for y in range(h):
        for kind, channels in packets:
            n, x = len(channels), 0
            while x < w:
                if at >= len(data):
                    raise ValueError("broken PIC file")
                if kind == 0:
                    count, run = w, False
                else:
                    count, run, at = data[at], kind == 1, at + 1
                    if kind == 2:
                        run = count >= 128
                        if count == 128:
                            count, at = struct.unpack(">H", data[at : at + 2])[0], at + 2
                        else:
                            count = count - 127 if run else count + 1
                if kind == 1:
                    count = min(count, w - x)
                part = data[at : at + (n if run else n * count)]
                if not count or x + count > w or len(part) != (n if run else n * count):
                    raise ValueError("broken PIC file")
                at += len(part)
                out[y, x : x + count, channels] = np.frombuffer(part, np.uint8).reshape(-1, n).T if not run else np.frombuffer(part, np.uint8)[:, None]
                x += count
    return out
