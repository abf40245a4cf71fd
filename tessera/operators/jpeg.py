"""JPEG files, sequential and progressive, as RGBA arrays.

Entropy-coded parts are read symbol by symbol into one list of coefficients per component; the rest
(dequantisation, inverse cosine transform, upsampling, colours) is arithmetic on whole planes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: The order of the coefficients of a block, by diagonals.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8))
FRAMES = {0xC0, 0xC1, 0xC2}  #: baseline, extended and progressive frames with Huffman codes
COSINES = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class Component:
    def __init__(self, name: int, across: int, down: int, table: int) -> None:
        self.name, self.across, self.down, self.table = name, across, down, table
        self.last = 0

    def lay(self, width: int, height: int, most_across: int, most_down: int) -> None:
        """Set sizes in samples and blocks; an interleaved scan goes over whole units."""
        self.w, self.h = -(-width * self.across // most_across), -(-height * self.down // most_down)
        self.blocks_w, self.blocks_h = -(-self.w // 8), -(-self.h // 8)
        self.stride = -(-width // (8 * most_across)) * self.across
        self.rows = -(-height // (8 * most_down)) * self.down
        self.values = [0] * (64 * self.stride * self.rows)


def segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, content, end) of the file's segments."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        at += 2 + size
        yield marker, data[at - size + 2 : at], at


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    if not data.startswith(b"\xff\xd8\xff"):
        return None
    for marker, content, _ in segments(data):
        if marker in FRAMES and len(content) >= 6:
            height, width = struct.unpack(">HH", content[1:5])
            return (width, height) if width and height else None
    return None


def codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits that may stand next, how many of them are a code, and its symbol."""
    table, at, code = [(0, 0)] * 65536, 0, 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            first, span = code << (16 - bits), 1 << (16 - bits)
            table[first : first + span] = [(bits, symbols[at])] * span
            at, code = at + 1, code + 1
        code <<= 1
    return table


class Bits:
    """The bits of one stretch between restarts; byte stuffing is already undone."""

    __slots__ = ("at", "data", "end")

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        at = self.at
        bits, symbol = table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF]
        if not bits or at > self.end:
            raise ValueError("broken JPEG file")
        self.at = at + bits
        return symbol

    def take(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (24 - (at & 7) - n) & ((1 << n) - 1)

    def number(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


class Scan:
    """What a scan's header says, and how one block of it is read."""

    def __init__(self, tables: dict, progressive: bool, first: int, last: int, high: int, low: int) -> None:
        self.tables, self.first, self.last, self.high, self.low, self.run = tables, first, last, high, low, 0
        self.read = self.whole if not progressive else (self.dc if not first else self.ac) if not high else (self.dc_bit if not first else self.ac_bit)

    def whole(self, bits: Bits, c: Component, at: int, dc: list, ac: list) -> None:
        values = c.values
        c.last += bits.number(bits.symbol(dc))
        values[at] = c.last
        k = 1
        while k < 64:
            s = bits.symbol(ac)
            zeros, size = s >> 4, s & 15
            if not size:
                if zeros < 15:
                    return
                k += 16
                continue
            k += zeros
            if k > 63:
                raise ValueError("broken JPEG file")
            values[at + ZIGZAG[k]] = bits.number(size)
            k += 1

    def dc(self, bits: Bits, c: Component, at: int, dc: list, ac: list) -> None:
        c.last += bits.number(bits.symbol(dc))
        c.values[at] = c.last << self.low

    def dc_bit(self, bits: Bits, c: Component, at: int, dc: list, ac: list) -> None:
        c.values[at] |= bits.take(1) << self.low

    def ac(self, bits: Bits, c: Component, at: int, dc: list, ac: list) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.first
        while k <= self.last:
            s = bits.symbol(ac)
            zeros, size = s >> 4, s & 15
            if not size:
                if zeros < 15:
                    self.run = (1 << zeros) - 1 + bits.take(zeros)
                    return
                k += 16
                continue
            k += zeros
            if k > 63:
                raise ValueError("broken JPEG file")
            c.values[at + ZIGZAG[k]] = bits.number(size) * (1 << self.low)
            k += 1

    def ac_bit(self, bits: Bits, c: Component, at: int, dc: list, ac: list) -> None:
        values, step, k = c.values, 1 << self.low, self.first

        def refine(place: int) -> None:
            if bits.take(1) and not abs(values[place]) & step:
                values[place] += step if values[place] > 0 else -step

        if not self.run:
            while k <= self.last:
                s = bits.symbol(ac)
                zeros, size = s >> 4, s & 15
                if not size and zeros < 15:
                    self.run = (1 << zeros) + bits.take(zeros)
                    break
                new = (step if bits.take(1) else -step) if size else 0
                while k <= self.last:
                    place = at + ZIGZAG[k]
                    k += 1
                    if values[place]:
                        refine(place)
                    elif zeros:
                        zeros -= 1
                    else:
                        if new:
                            values[place] = new
                        break
        if self.run:
            self.run -= 1
            for place in (at + ZIGZAG[j] for j in range(k, self.last + 1)):
                if values[place]:
                    refine(place)


def stretches(data: bytes, at: int) -> list[bytes]:
    """The entropy-coded bytes from `at` on, parted at restarts, without stuffing."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:].replace(b"\xff\x00", b"\xff")]
        marker = data[at + 1]
        if 0xD0 <= marker <= 0xD7:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at + 2
        elif marker not in (0x00, 0xFF):
            return [*out, data[start:at].replace(b"\xff\x00", b"\xff")]
        at += 1 if marker == 0xFF else 2


def read_scan(parts: list[bytes], scan: Scan, chosen: list[tuple[Component, list, list]], units: tuple[int, int], restart: int) -> None:
    """Read the blocks of a scan: all of one component's own, or of several by units of the picture."""
    if len(chosen) == 1:
        c = chosen[0][0]
        across, total = c.blocks_w, c.blocks_w * c.blocks_h
    else:
        across, total = units[0], units[0] * units[1]
    each, part, bits = restart or total, -1, Bits(b"")
    for unit in range(total):
        if unit % each == 0:
            part += 1
            if part >= len(parts):
                raise ValueError("broken JPEG file")
            bits, scan.run = Bits(parts[part]), 0
            for c, _, _ in chosen:
                c.last = 0
        row, col = divmod(unit, across)
        if len(chosen) == 1:
            c, dc, ac = chosen[0]
            scan.read(bits, c, 64 * (row * c.stride + col), dc, ac)
            continue
        for c, dc, ac in chosen:
            for y in range(row * c.down, (row + 1) * c.down):
                for x in range(col * c.across, (col + 1) * c.across):
                    scan.read(bits, c, 64 * (y * c.stride + x), dc, ac)


def plane(c: Component, table: np.ndarray) -> np.ndarray:
    """A component's samples."""
    blocks = np.array(c.values, np.float64).reshape(-1, 8, 8) * table.reshape(8, 8)
    samples = np.clip(np.rint(COSINES.T @ blocks @ COSINES) + 128, 0, 255).astype(np.int32)
    return samples.reshape(c.rows, c.stride, 8, 8).swapaxes(1, 2).reshape(8 * c.rows, 8 * c.stride)[: c.h, : c.w]


def widened(p: np.ndarray) -> np.ndarray:
    """Twice as wide: each new sample is three parts of the nearest and one of the next one (twice, in sums of four)."""
    before, after = np.concatenate((p[:, :1], p[:, :-1]), axis=1), np.concatenate((p[:, 1:], p[:, -1:]), axis=1)
    return np.stack((3 * p + before, 3 * p + after), axis=2).reshape(len(p), -1)


def upsampled(p: np.ndarray, across: int, down: int, width: int, height: int) -> np.ndarray:
    """A plane at full size; halved ones are interpolated, as decoders do, others repeated."""
    if across == 2 and down == 1 and p.shape[1] > 2:
        out = widened(p)
        p = (out + np.where(np.arange(out.shape[1]) % 2, 2, 1)) >> 2
    elif across == 2 and down == 2 and p.shape[1] > 2:
        out = widened(widened(p.T).T)
        p = (out + np.where(np.arange(out.shape[1]) % 2, 7, 8)) >> 4
    else:
        p = p.repeat(down, axis=0).repeat(across, axis=1)
    return p[:height, :width]


def read_jpeg(data: bytes) -> np.ndarray:
    """An RGBA image of shape (height, width, 4)."""
    quant, huffman, parts, restart, adobe = {}, {}, [], 0, None
    size, progressive, most_across, most_down = None, False, 1, 1
    for marker, content, end in segments(data):
        if marker == 0xDB:
            while content:
                wide = content[0] >> 4
                values = np.frombuffer(content, ">u2" if wide else "u1", 64, 1)
                table = np.zeros(64)
                table[ZIGZAG] = values
                quant[content[0] & 15], content = table, content[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while content:
                n = sum(content[1:17])
                huffman[content[0]], content = codes(content[1:17], content[17 : 17 + n]), content[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", content[:2])[0]
        elif marker == 0xEE and content.startswith(b"Adobe") and len(content) >= 12:
            adobe = content[11]
        elif marker in FRAMES:
            depth, height, width, n = struct.unpack(">BHHB", content[:6])
            if depth != 8 or not width or not height or n not in (1, 3, 4):
                raise ValueError("unsupported JPEG file")
            size, progressive = (width, height), marker == 0xC2
            parts = [Component(content[6 + 3 * k], content[7 + 3 * k] >> 4, content[7 + 3 * k] & 15, content[8 + 3 * k]) for k in range(n)]
            if not all(1 <= c.across <= 4 and 1 <= c.down <= 4 for c in parts):
                raise ValueError("broken JPEG file")
            most_across, most_down = max(c.across for c in parts), max(c.down for c in parts)
            for c in parts:
                c.lay(width, height, most_across, most_down)
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("unsupported JPEG file")
        elif marker == 0xDA:
            if size is None:
                raise ValueError("broken JPEG file")
            n = content[0]
            by_name = {c.name: c for c in parts}
            chosen = [(by_name[content[1 + 2 * k]], huffman.get(content[2 + 2 * k] >> 4), huffman.get(16 + (content[2 + 2 * k] & 15))) for k in range(n)]
            first, last, steps = content[1 + 2 * n : 4 + 2 * n]
            scan = Scan(huffman, progressive, first, last, steps >> 4, steps & 15)
            units = (-(-size[0] // (8 * most_across)), -(-size[1] // (8 * most_down)))
            read_scan(stretches(data, end), scan, chosen, units, restart)
    if size is None:
        raise ValueError("broken JPEG file")
    width, height = size
    planes = [upsampled(plane(c, quant[c.table]), most_across // c.across, most_down // c.down, width, height) for c in parts]
    return coloured(planes, adobe, bytes(c.name for c in parts) == b"RGB")


def coloured(planes: list[np.ndarray], adobe: int | None, named_rgb: bool) -> np.ndarray:
    out = np.full((*planes[0].shape, 4), 255, np.uint8)
    if len(planes) == 1:
        out[..., :3] = planes[0][..., None]
        return out
    first = np.stack(planes[:3], axis=2).astype(np.float64)
    if adobe in (1, 2) or (adobe is None and not named_rgb and len(planes) == 3):
        y, b, r = first[..., 0], first[..., 1] - 128, first[..., 2] - 128
        first = np.stack((y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b), axis=2)
    first = np.clip(np.rint(first), 0, 255)
    if len(planes) == 4:  # inks, stored inverted
        first = np.rint(first * planes[3][..., None] / 255)
    out[..., :3] = first
    return out
