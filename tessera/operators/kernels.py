"""Small packing routines for one list of rectangles; Spark spreads jobs and candidates over tasks.

Each takes boxes [(w, h), ...] in the order they are to be placed, padding included, and returns
the placements [(x, y, turned), ...] (None for a box that found no room, if that is allowed).
"""

from __future__ import annotations

from collections.abc import Callable

Box = tuple[int, int]
Spot = tuple[int, int, bool]
Free = tuple[int, int, int, int]  #: x and y of its first corner and of its last one


def carve(free: list[Free], x: int, y: int, right: int, below: int) -> list[Free]:
    """The free rectangles once what lies from (x, y) to (right, below) is taken.

    What is left of a rectangle at the sides keeps its full height, what is left above and below
    only the breadth that was cut; rectangles within others are dropped.  Of those given none lies
    within another, so only the pieces need a look.  This and the spots take most of a search, hence no calls.
    """
    whole = [f for f in free if x >= f[2] or f[0] >= right or y >= f[3] or f[1] >= below]
    if len(whole) == len(free):
        return free
    pieces: list[Free] = []
    out: list[Free] = []
    for f in free:
        fx, fy, fr, fb = f
        if x >= fr or fx >= right or y >= fb or fy >= below:
            out.append(f)
            continue
        a, b = x if x > fx else fx, right if right < fr else fr
        for r in ((fx, fy, x, fb), (right, fy, fr, fb), (a, fy, b, y), (a, below, b, fb)):
            left, top, far, low = r
            if left >= far or top >= low:
                continue
            for o in whole:
                if left >= o[0] and top >= o[1] and far <= o[2] and low <= o[3]:
                    break
            else:
                inner = []
                for o in pieces:
                    if left >= o[0] and top >= o[1] and far <= o[2] and low <= o[3]:
                        break
                    if o[0] >= left and o[1] >= top and o[2] <= far and o[3] <= low:
                        inner.append(o)
                else:
                    if inner:
                        pieces, out = [o for o in pieces if o not in inner], [o for o in out if o not in inner]
                    pieces.append(r)
                    out.append(r)
    return out


# What a free rectangle and the room left in it are judged by, smallest first; of equals the first is taken.


def _by_short_side(free: list[Free], shapes: tuple) -> tuple | None:
    """Least room at the nearer side, then at the other one, then y and x."""
    best, least, second, top, left = None, 1 << 60, 0, 0, 0
    for fx, fy, fr, fb in free:
        fw, fh = fr - fx, fb - fy
        for w, h, turned in shapes:
            if w <= fw and h <= fh:
                a, b = fw - w, fh - h
                if a > b:
                    a, b = b, a
                if a < least or (a == least and (b < second or (b == second and (fy < top or (fy == top and fx < left))))):
                    best, least, second, top, left = (fx, fy, w, h, turned), a, b, fy, fx
    return best


def _by_area(free: list[Free], shapes: tuple) -> tuple | None:
    """Least product of the room at both sides, then room at the nearer one, then y and x."""
    best, least, second, top, left = None, 1 << 60, 0, 0, 0
    for fx, fy, fr, fb in free:
        fw, fh = fr - fx, fb - fy
        for w, h, turned in shapes:
            if w <= fw and h <= fh:
                a, b = fw - w, fh - h
                area = a * b
                if area > least:
                    continue
                if a > b:
                    a = b
                if area < least or a < second or (a == second and (fy < top or (fy == top and fx < left))):
                    best, least, second, top, left = (fx, fy, w, h, turned), area, a, fy, fx
    return best


def _by_place(free: list[Free], shapes: tuple) -> tuple | None:
    """Least y, then x, then room at the nearer side."""
    best, top, left, least = None, 1 << 60, 0, 0
    for fx, fy, fr, fb in free:
        if fy > top or (fy == top and fx > left):
            continue
        fw, fh = fr - fx, fb - fy
        for w, h, turned in shapes:
            if w <= fw and h <= fh:
                a, b = fw - w, fh - h
                if a > b:
                    a = b
                if fy < top or fx < left or a < least:
                    best, top, left, least = (fx, fy, w, h, turned), fy, fx, a
    return best


HEURISTICS: dict[str, Callable] = {"short_side": _by_short_side, "area": _by_area, "bottom_left": _by_place}


#: Whether an atlas of some width and height can't become a wanted one any more; both only grow while boxes are placed.
Beyond = Callable[[int, int], bool]
#: Whether that many boxes without room, worth so much together, are too many.
Lost = Callable[[int, int], bool]


def maxrects(boxes: list[Box], width: int, height: int, heuristic: str = "short_side", turn: bool = False, partial: bool = False, taken: list[Free] | None = None, beyond: Beyond | None = None, lost: Lost | None = None, worth: list[int] | None = None) -> list[Spot | None] | None:
    """Maximal rectangles; None if a box finds no room, unless partial, if what is used goes beyond, or too much is lost.

    taken: what is occupied beforehand; worth: what each box counts where it finds no room.
    """
    free, find, out = [(0, 0, width, height)], HEURISTICS[heuristic], []
    wide = tall = missed = value = 0
    for x, y, w, h in taken or ():
        free = carve(free, x, y, x + w, y + h)
    for k, (w, h) in enumerate(boxes):
        spot = find(free, ((w, h, False), (h, w, True)) if turn and w != h else ((w, h, False),))
        if spot is None:
            if not partial:
                return None
            out.append(None)
            if lost:
                missed, value = missed + 1, value + worth[k]
                if lost(missed, value):
                    return None
            continue
        x, y, bw, bh, turned = spot
        out.append((x, y, turned))
        right, below = x + bw, y + bh
        if beyond and (right > wide or below > tall):
            wide, tall = max(wide, right), max(tall, below)
            if beyond(wide, tall):
                return None
        free = carve(free, x, y, right, below)
    return out


def shelf(boxes: list[Box], width: int, turn: bool = False, beyond: Beyond | None = None) -> list[Spot] | None:
    """Rows from left to right; a box is turned only where that lowers its row's place or height."""
    x = y = tall = wide = 0
    out: list[Spot] = []
    for w, h in boxes:
        def cost(bw: int, bh: int) -> tuple[int, int]:
            return (y + tall, bh) if x and x + bw > width else (y, max(tall, bh))  # noqa: B023

        turned = turn and w != h and h <= width and cost(h, w) < cost(w, h)
        if turned:
            w, h = h, w
        if x and x + w > width:
            x, y, tall = 0, y + tall, 0
        if w > width:
            return None
        out.append((x, y, turned))
        x, tall = x + w, max(tall, h)
        if beyond and (x > wide or tall == h):
            wide = max(wide, x)
            if beyond(wide, y + tall):
                return None
    return out


def guillotine(boxes: list[Box], width: int, height: int, turn: bool = False) -> list[Spot] | None:
    """Cuts that go right through: the leaves stand in a list, right parts before lower ones, and the first with room is taken."""
    leaves, out = [(0, 0, width, height)], []
    for w, h in boxes:
        for k, (lx, ly, lw, lh) in enumerate(leaves):
            upright, turned = w <= lw and h <= lh, turn and h <= lw and w <= lh
            if upright or turned:
                lying = turned and (not upright or min(lw - h, lh - w) < min(lw - w, lh - h))
                bw, bh = (h, w) if lying else (w, h)
                parts = [(lx + bw, ly, lw - bw, bh), (lx, ly + bh, lw, lh - bh)]
                leaves[k : k + 1] = [p for p in parts if p[2] > 0 and p[3] > 0]
                out.append((lx, ly, lying))
                break
        else:
            return None
    return out


def extent(boxes: list[Box], spots: list[Spot | None]) -> Box:
    """The width and height that the placed boxes use."""
    ends = [(s[0] + (h if s[2] else w), s[1] + (w if s[2] else h)) for (w, h), s in zip(boxes, spots, strict=True) if s]
    return (max(e[0] for e in ends), max(e[1] for e in ends)) if ends else (0, 0)
