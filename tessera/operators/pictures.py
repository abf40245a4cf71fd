"""Image files of several formats as RGBA rasters: PNG, JPEG, BMP, GIF, TGA, PSD, HDR, PIC and portable maps."""

from __future__ import annotations

import struct

import numpy as np

from .jpeg import jpeg_size, read_jpeg
from .layered import PIC_MAGIC, hdr_size, pic_size, psd_size, read_hdr, read_pic, read_psd
from .png import SIGNATURE, bmp_size, gif_size, png_size, read_png


def opaque(rgb: np.ndarray) -> np.ndarray:
    """RGBA of grey (1 channel), RGB or RGBA samples."""
    h, w, n = rgb.shape
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., : 4 if n == 4 else 3] = rgb
    return out


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed files of 8 (with palette), 24 or 32 bits a pixel."""
    start, head, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packed}")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows  # from the bottom up, unless the height is negative
    if bits == 8:
        colours = int.from_bytes(data[46:50], "little") or 256
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
        return opaque(palette[rows][..., 2::-1])
    pixels = rows.reshape(abs(h), w, bits // 8)
    out = opaque(pixels[..., 2::-1])
    if bits == 32 and pixels[..., 3].any():
        out[..., 3] = pixels[..., 3]
    return out


def tga_size(data: bytes) -> tuple[int, int] | None:
    if len(data) < 18 or data[1] > 1 or data[2] not in (1, 2, 3, 9, 10, 11) or data[16] not in (8, 24, 32):
        return None
    w, h = struct.unpack("<HH", data[12:16])
    return (w, h) if w and h else None


def read_tga(data: bytes) -> np.ndarray:
    """Palette, colour and grey files, plain or with runs."""
    size = tga_size(data)
    if size is None:
        raise ValueError("no TGA file")
    (w, h), kind, n = size, data[2], data[16] // 8
    first, colours, bits = struct.unpack("<HHB", data[3:8])
    at = 18 + data[0]
    palette = np.frombuffer(data, np.uint8, colours * bits // 8, at).reshape(colours, bits // 8) if data[1] else None
    at += colours * bits // 8 if data[1] else 0
    if kind < 8:
        raw = data[at : at + w * h * n]
    else:
        parts, left = [], w * h
        while left > 0:
            count = (data[at] & 0x7F) + 1
            run = data[at] & 0x80
            step = n if run else n * count
            parts.append(data[at + 1 : at + 1 + step] * (count if run else 1))
            at, left = at + 1 + step, left - count
        raw = b"".join(parts)[: w * h * n]
    pixels = np.frombuffer(raw, np.uint8).reshape(h, w, n)
    if kind & 7 == 1:
        pixels = palette[pixels[..., 0].astype(int) - first]
    pixels = pixels[..., [2, 1, 0, 3][: pixels.shape[2]]] if pixels.shape[2] > 1 else pixels
    pixels = pixels if data[17] & 0x20 else pixels[::-1]
    return opaque(pixels[:, ::-1] if data[17] & 0x10 else pixels)


def map_head(data: bytes) -> tuple[bytes, int, int, int, int] | None:
    """Kind, width, height, greatest value and where the samples begin, of a binary portable map; comments are passed over."""
    if data[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3 and at < len(data):
        if data[at : at + 1].isspace():
            at += 1
        elif data[at] == ord("#"):
            at = data.find(b"\n", at) + 1 or len(data)
        else:
            end = at
            while end < len(data) and data[end : end + 1].isdigit():
                end += 1
            if end == at:
                return None
            numbers.append(int(data[at:end]))
            at = end
    return (data[:2], *numbers, at + 1) if len(numbers) == 3 else None


def read_map(data: bytes) -> np.ndarray:
    head = map_head(data)
    if head is None or not 0 < head[3] < 1 << 16:
        raise ValueError("no portable map")
    kind, w, h, most, at = head
    n = 3 if kind == b"P6" else 1
    samples = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * n, at).reshape(h, w, n)
    return opaque((samples.astype(np.uint32) * 255 // most).astype(np.uint8))


def unpacked(codes: bytes, least: int, size: int) -> bytes:
    """LZW as GIF has it: codes grow from least + 1 to 12 bits; a clear code starts anew."""
    clear, out = 1 << least, bytearray()
    table: list[bytes] = []
    bits = held = at = 0
    width, last = least + 1, None
    while len(out) < size:
        while held < width:
            if at >= len(codes):
                return bytes(out)
            bits |= codes[at] << held
            held, at = held + 8, at + 1
        code, bits, held = bits & (1 << width) - 1, bits >> width, held - width
        if code == clear:
            table = [bytes([k]) for k in range(clear)] + [b"", b""]
            width, last = least + 1, None
        elif code == clear + 1:
            break
        else:
            if not table or code > len(table):
                raise ValueError("broken GIF codes")
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            out += entry
            last = entry
            if len(table) == 1 << width and width < 12:
                width += 1
    return bytes(out[:size])


def read_gif(data: bytes) -> np.ndarray:
    """The first picture of a file, on a clear canvas."""
    size = gif_size(data)
    if size is None:
        raise ValueError("no GIF file")
    out = np.zeros((size[1], size[0], 4), np.uint8)
    palette, at, clear = None, 13, None
    colours = lambda flags, place: np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, place).reshape(-1, 3)
    if data[10] & 0x80:
        palette = colours(data[10], at)
        at += palette.size
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            at += 2
        elif data[at] == 0x2C:
            x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if flags & 0x80:
                palette = colours(flags, at)
                at += palette.size
            least, blocks = data[at], []
            at += 1
            while data[at]:
                blocks.append(data[at + 1 : at + 1 + data[at]])
                at += 1 + data[at]
            index = np.frombuffer(unpacked(b"".join(blocks), least, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:  # rows come in four passes
                rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                index = index[np.argsort(rows)]
            picture = opaque(palette[index])
            if clear is not None:
                picture[index == clear] = 0
            out[y : y + h, x : x + w] = picture[: size[1] - y, : size[0] - x]
            return out
        else:
            raise ValueError("broken GIF file")
        while data[at]:
            at += 1 + data[at]
        at += 1
    raise ValueError("no picture in the GIF file")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header alone."""
    head = map_head(data)
    return png_size(data) or jpeg_size(data) or psd_size(data) or hdr_size(data) or pic_size(data) or bmp_size(data) or gif_size(data) or (head[1:3] if head else None) or tga_size(data)


def read_image(data: bytes) -> np.ndarray:
    """An RGBA image of shape (height, width, 4)."""
    for begin, read in ((SIGNATURE, read_png), (b"\xff\xd8\xff", read_jpeg), (b"8BPS", read_psd), (b"#?R", read_hdr), (PIC_MAGIC, read_pic), (b"BM", read_bmp), (b"GIF8", read_gif), (b"P5", read_map), (b"P6", read_map)):
        if data.startswith(begin):
            return read(data)
    if tga_size(data):
        return read_tga(data)
    raise ValueError("unknown format")
