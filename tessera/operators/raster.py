"""Operators on single rasters, numpy arrays of shape (height, width, 4); Spark spreads images and atlases over tasks."""

from __future__ import annotations

import struct

import numpy as np

#: The 4 by 4 ordered dither matrix.
BAYER = np.array([[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]])


def trim_bounds(pixels: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, w, h of what isn't transparent; of a blank image its first pixel."""
    seen = pixels[..., 3] != 0
    ys, xs = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    if not len(ys):
        return 0, 0, 1, 1
    return int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)


def turned(pixels: np.ndarray) -> np.ndarray:
    """By 90 degrees clockwise."""
    return np.rot90(pixels, -1)


def unturned(pixels: np.ndarray) -> np.ndarray:
    return np.rot90(pixels, 1)


def _weights(kind: str, t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    if kind == "bilinear":
        return np.clip(1 - t, 0, None)
    b, c = (0.0, 0.5) if kind == "bicubic" else (1 / 3, 1 / 3)
    inner = (12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t**2 + 6 - 2 * b
    outer = (-b - 6 * c) * t**3 + (6 * b + 30 * c) * t**2 + (-12 * b - 48 * c) * t + 8 * b + 24 * c
    return np.where(t < 1, inner, np.where(t < 2, outer, 0)) / 6


def _axis(pixels: np.ndarray, size: int, kind: str) -> np.ndarray:
    n = len(pixels)
    wide = max(1.0, n / size)
    centre = (np.arange(size) + 0.5) * n / size - 0.5
    reach = int(np.ceil(2 * wide)) + 1
    at = np.floor(centre).astype(int)[:, None] + np.arange(-reach, reach + 1)[None, :]
    weight = _weights(kind, (at - centre[:, None]) / wide)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.einsum("sk,sk...->s...", weight, pixels[at.clip(0, n - 1)])


def resampled(pixels: np.ndarray, width: int, height: int, kind: str = "nearest") -> np.ndarray:
    """To another size: nearest, bilinear, bicubic (Catmull-Rom) or mitchell; colours are weighted by alpha."""
    h, w = pixels.shape[:2]
    if (w, h) == (width, height):
        return pixels
    if kind == "nearest":
        return pixels[np.arange(height)[:, None] * h // height, np.arange(width)[None, :] * w // width]
    x = pixels.astype(np.float64)
    x[..., :3] *= x[..., 3:] / 255
    x = np.swapaxes(_axis(np.swapaxes(_axis(x, height, kind), 0, 1), width, kind), 0, 1)
    alpha = x[..., 3:].clip(0, 255)
    x[..., :3] = np.where(alpha > 0, x[..., :3] * 255 / np.where(alpha > 0, alpha, 1), 0)
    x[..., 3:] = alpha
    return np.rint(x.clip(0, 255)).astype(np.uint8)


def quantised(pixels: np.ndarray, levels: int, dither: bool = False) -> np.ndarray:
    """Red, green and blue in so many levels each; 0 leaves them as they are, dithered or not."""
    if levels < 2:
        return pixels
    out, x = pixels.copy(), pixels[..., :3].astype(np.float64) * (levels - 1) / 255
    if dither:
        h, w = pixels.shape[:2]
        x += ((BAYER[np.arange(h)[:, None] % 4, np.arange(w)[None, :] % 4] + 0.5) / 16 - 0.5)[..., None]
    out[..., :3] = np.rint(np.rint(x.clip(0, levels - 1)) * 255 / (levels - 1))
    return out


def extruded(atlas: np.ndarray, x: int, y: int, w: int, h: int, by: int) -> None:
    """Repeat a sprite's edge outwards within the atlas."""
    if by <= 0 or w <= 0 or h <= 0:
        return
    rows = np.arange(max(0, y - by), min(len(atlas), y + h + by))
    cols = np.arange(max(0, x - by), min(atlas.shape[1], x + w + by))
    source = atlas[rows.clip(y, y + h - 1)[:, None], cols.clip(x, x + w - 1)[None, :]]
    atlas[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] = source


def dilated(atlas: np.ndarray, x: int, y: int, w: int, h: int) -> None:
    """Give transparent pixels of a sprite and one pixel around it the colour of the first opaque neighbour: left, right, up, down."""
    top, left = max(0, y - 1), max(0, x - 1)
    area = atlas[top : y + h + 1, left : x + w + 1]
    seen, colour = area[..., 3] != 0, area[..., :3].copy()
    todo = ~seen
    for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
        near, near_colour = np.zeros_like(seen), np.zeros_like(colour)
        to = (slice(max(0, -dy), len(seen) - max(0, dy)), slice(max(0, -dx), seen.shape[1] - max(0, dx)))
        fro = (slice(max(0, dy), len(seen) + min(0, dy)), slice(max(0, dx), seen.shape[1] + min(0, dx)))
        near[to], near_colour[to] = seen[fro], colour[fro]
        take = todo & near
        area[take, :3] = near_colour[take]
        todo &= ~take


def outlined(atlas: np.ndarray, x: int, y: int, w: int, h: int, line: int = 1, colour: tuple[int, int, int, int] = (255, 0, 0, 255)) -> None:
    """Draw a frame of `line` pixels inside a sprite's rectangle."""
    inside = atlas[y : y + h, x : x + w]
    keep = inside[line : h - line, line : w - line].copy() if h > 2 * line and w > 2 * line else None
    inside[:] = colour
    if keep is not None:
        inside[line : h - line, line : w - line] = keep


def keyed_out(pixels: np.ndarray, near: int = 15) -> tuple[np.ndarray, str | None]:
    """Where the first pixel is opaque, its colour is the background: pixels close to it become transparent. Also its hex code."""
    if not pixels[0, 0, 3]:
        return pixels, None
    key = pixels[0, 0, :3].astype(int)
    out = pixels.copy()
    out[np.abs(pixels[..., :3].astype(int) - key).sum(axis=-1) <= near, 3] = 0
    return out, "".join(f"{c:02x}" for c in key)


#: Of the eight neighbours, those that follow a pixel: right, below left, below, below right.
FOLLOWING = ((0, 1), (1, -1), (1, 0), (1, 1))


def shifted(a: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """The pixels that have a neighbour at (dy, dx), and those neighbours."""
    h, w = a.shape[:2]
    return a[: h - dy, max(0, -dx) : w - max(0, dx)], a[dy:, max(0, dx) : w + min(0, dx)]


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things, linked in pairs (a, b), the smallest one that it hangs together with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    return label


def labelled(linked: list[tuple[int, int, np.ndarray]], h: int, w: int) -> np.ndarray:
    """A label for each pixel, equal where pixels hang together.

    linked says, for each step (dy, dx), which of the pixels that have such a neighbour are joined with
    it; stretches along a row are found first, so that only they are linked to one another.
    """
    starts = np.ones((h, w), bool)
    for dy, dx, joined_ in linked:
        if (dy, dx) == (0, 1):
            starts[:, 1:] = ~joined_
    run = (np.cumsum(starts.reshape(-1)) - 1).reshape(h, w)
    n = int(run[-1, -1]) + 1
    pairs = np.unique(np.concatenate([fro[joined_] * n + to[joined_] for dy, dx, joined_ in linked if dy for fro, to in (shifted(run, dy, dx),)]))
    return merged(n, pairs // n, pairs % n)[run]


def extents(label: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each label among the pixels `where`, in the order they are met: (label, count, x0, y0, x1, y1), and the places of the labels."""
    ys, xs = np.nonzero(where)
    names, first, place = np.unique(label[ys, xs], return_index=True, return_inverse=True)
    met = np.argsort(first, kind="stable")
    place = np.argsort(met, kind="stable")[place]
    out = np.zeros((len(names), 6), np.int64)
    out[:, 0], out[:, 1] = names[met], np.bincount(place, minlength=len(names))
    for column, of, values in ((2, np.minimum, xs), (3, np.minimum, ys), (4, np.maximum, xs), (5, np.maximum, ys)):
        out[:, column] = 1 << 40 if of is np.minimum else -1
        of.at(out[:, column], place, values)
    return out, place


def components(pixels: np.ndarray, tolerance: int = 1, least: int = 4, most: int = 10_000) -> list[tuple[int, int, int, int]]:
    """Rectangles x, y, w, h of what hangs together, largest first.

    A component starts at an opaque pixel and grows to all eight neighbours that are opaque or whose
    colour is nearer to the pixel it comes from than the tolerance; smaller ones are left out.  So
    opaque areas and transparent ones of like colours are whole; an opaque area enters a transparent
    one only by a like colour, but a transparent one leads to every opaque one at its border.
    """
    h, w = pixels.shape[:2]
    if not h or not w:
        return []
    solid, colour = pixels[..., 3] != 0, pixels[..., :3].astype(np.int32)
    linked, across = [], []
    for dy, dx in FOLLOWING:
        (a, b), (p, q) = shifted(solid, dy, dx), shifted(colour, dy, dx)
        like = np.abs(p - q).sum(axis=-1) < tolerance
        linked.append((dy, dx, (a & b) | (~a & ~b & like)))
        across.append((dy, dx, a != b, like))
    label = labelled(linked, h, w)
    areas, place = extents(label, np.ones_like(solid))
    place, n = place.reshape(h, w), len(areas)
    opaque = np.zeros(n, bool)
    opaque[place[solid]] = True
    leads: dict[int, set[int]] = {}
    for dy, dx, border, like in across:
        fro, to = shifted(place, dy, dx)
        for pair in np.unique((fro[border] * n + to[border]) * 2 + like[border]).tolist():
            x, y = divmod(pair >> 1, n)
            clear, full = (y, x) if opaque[x] else (x, y)
            leads.setdefault(clear, set()).add(full)
            if pair & 1:
                leads.setdefault(full, set()).add(clear)
    found, seen = [], np.zeros(len(areas), bool)
    for start in np.flatnonzero(opaque):
        if seen[start]:
            continue
        group, stack = [], [int(start)]
        seen[start] = True
        while stack:
            group.append(stack.pop())
            for k in leads.get(group[-1], ()):
                if not seen[k]:
                    seen[k] = True
                    stack.append(k)
        own = areas[group]
        x0, y0, x1, y1 = (int(v) for v in (own[:, 2].min(), own[:, 3].min(), own[:, 4].max(), own[:, 5].max()))
        if own[:, 1].sum() >= least:
            found.append((-((x1 - x0 + 1) * (y1 - y0 + 1)), len(found), (x0, y0, x1 - x0 + 1, y1 - y0 + 1)))
    return [f[2] for f in sorted(found)[:most]]


def bordered(pixels: np.ndarray, colour: tuple[int, int, int] = (255, 0, 255), near: int = 30, least: int = 4, most: int = 10_000) -> list[tuple[int, int, int, int]]:
    """Rectangles within frames drawn in a colour, in the order they are met; the border itself is left off."""
    marked = np.abs(pixels[..., :3].astype(int) - np.array(colour)).sum(axis=-1) < near
    if not marked.any():
        return []
    label = labelled([(dy, dx, np.logical_and(*shifted(marked, dy, dx))) for dy, dx in ((0, 1), (1, 0))], *marked.shape)
    boxes, _ = extents(label, marked)
    found = [[x0, y0, x1 - x0 + 1, y1 - y0 + 1] for _, _, x0, y0, x1, y1 in boxes.tolist() if (x1 - x0 + 1) * (y1 - y0 + 1) >= least]
    frames = joined(found)[:most]
    return [(x + 1, y + 1, w - 2, h - 2) for x, y, w, h in frames if w > 2 and h > 2]


def joined(boxes: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """Each box in turn takes in the later ones it meets and grows by them; earlier ones are not looked at again."""
    left, out = [tuple(b) for b in boxes], []
    while left:
        x, y, w, h = left.pop(0)
        grown = True
        while grown:
            grown, rest = False, []
            for b in left:
                if x < b[0] + b[2] and b[0] < x + w and y < b[1] + b[3] and b[1] < y + h:
                    x1, y1 = max(x + w, b[0] + b[2]), max(y + h, b[1] + b[3])
                    x, y = min(x, b[0]), min(y, b[1])
                    w, h, grown = x1 - x, y1 - y, True
                else:
                    rest.append(b)
            left = rest
        out.append((x, y, w, h))
    return out


# Files.


def masked(data: bytes, magic: bytes = b"TSSR!", key: bytes = b"tessera") -> bytes:
    """A file made unreadable to image viewers: a mark, then its bytes XORed with a repeated key."""
    return magic + unmasked_bytes(data, key)


def unmasked_bytes(data: bytes, key: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    return (x ^ np.resize(np.frombuffer(key, np.uint8), len(x))).tobytes() if len(x) else b""


def unmasked(data: bytes, magic: bytes = b"TSSR!", key: bytes = b"tessera") -> bytes:
    return unmasked_bytes(data[len(magic) :], key) if data.startswith(magic) else data


def write_dds(pixels: np.ndarray, alpha: bool = True) -> bytes:
    """Block compression: DXT5 with alpha, DXT1 without; both sides must be multiples of four."""
    h, w = pixels.shape[:2]
    if h % 4 or w % 4:
        raise ValueError("sides must be multiples of 4")
    blocks = pixels.reshape(h // 4, 4, w // 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 4).astype(np.int64)
    low, high = blocks[..., :3].min(axis=1), blocks[..., :3].max(axis=1)
    pack = lambda c: (c[:, 0] >> 3) << 11 | (c[:, 1] >> 2) << 5 | c[:, 2] >> 3
    c0, c1 = pack(high), pack(low)
    swap = c0 < c1
    c0, c1 = np.where(swap, c1, c0), np.where(swap, c0, c1)
    wide = lambda c: np.stack(((c >> 11) * 255 // 31, (c >> 5 & 63) * 255 // 63, (c & 31) * 255 // 31), axis=1)
    a, b = wide(c0), wide(c1)
    shades = np.stack((a, b, (2 * a + b) // 3, (a + 2 * b) // 3), axis=1)
    pick = np.abs(blocks[:, :, None, :3] - shades[:, None]).sum(axis=-1).argmin(axis=-1)
    bits = (pick << 2 * np.arange(16)).sum(axis=1)
    colour = np.empty(len(blocks), dtype=[("c0", "<u2"), ("c1", "<u2"), ("bits", "<u4")])
    colour["c0"], colour["c1"], colour["bits"] = c0, c1, np.where(c0 == c1, 0, bits)
    if alpha:
        top, bottom = blocks[..., 3].max(axis=1), blocks[..., 3].min(axis=1)
        # With the larger first there are six steps between: index 0 is the first, 1 the second, 2 to 7 the steps down.
        steps = np.stack([top, bottom, *(((7 - k) * top + k * bottom) // 7 for k in range(1, 7))], axis=1)
        index = np.where((top == bottom)[:, None], 0, np.abs(blocks[..., 3][:, :, None] - steps[:, None]).argmin(axis=-1)).astype(np.uint64)
        packed = (index << (3 * np.arange(16)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        part = np.empty((len(blocks), 8), np.uint8)
        part[:, 0], part[:, 1], part[:, 2:] = top, bottom, packed.view(np.uint8).reshape(-1, 8)[:, :6]
        body = np.hstack((part, colour.view(np.uint8).reshape(-1, 8))).tobytes()
    else:
        body = colour.tobytes()
    form = struct.pack("<II4sIIIII", 32, 4, b"DXT5" if alpha else b"DXT1", 0, 0, 0, 0, 0)
    head = struct.pack("<4sIIIIIII", b"DDS ", 124, 0x81007, h, w, len(body), 0, 0) + bytes(44) + form + struct.pack("<IIIII", 0x1000, 0, 0, 0, 0)
    return head + body
