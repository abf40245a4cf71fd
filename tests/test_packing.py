"""The searches against plain loops over every candidate, with a slow maximal-rectangles kernel of their own."""

import math
import random

import pytest
from support import rows

from tessera.plans import layouts

KEYS = {
    "height": lambda s: (-s[2], -s[1]), "width": lambda s: (-s[1], -s[2]), "area": lambda s: (-s[1] * s[2], -s[2], -s[1]),
    "maxside": lambda s: (-max(s[1], s[2]), -s[1] * s[2]), "perimeter": lambda s: (-s[1] - s[2], -s[1] * s[2]), "none": lambda s: (),
}
SCORES = {"short_side": lambda a, b, x, y: (min(a, b), max(a, b), y, x), "area": lambda a, b, x, y: (a * b, min(a, b), y, x), "bottom_left": lambda a, b, x, y: (y, x, min(a, b))}


def slow_maxrects(boxes, width, height, score, turn, partial=False):
    """Every free rectangle is cut by what is placed; then those within another go."""
    free, out = [(0, 0, width, height)], []
    for w, h in boxes:
        fits = [(SCORES[score](fw - bw, fh - bh, fx, fy), k, t, fx, fy, bw, bh) for k, (fx, fy, fw, fh) in enumerate(free) for t, (bw, bh) in enumerate([(w, h), (h, w)] if turn and w != h else [(w, h)]) if bw <= fw and bh <= fh]
        if not fits:
            if not partial:
                return None
            out.append(None)
            continue
        _, _, t, x, y, bw, bh = min(fits)
        out.append((x, y, bool(t)))
        cut = []
        for fx, fy, fw, fh in free:
            x0, x1, y0, y1 = max(fx, x), min(fx + fw, x + bw), max(fy, y), min(fy + fh, y + bh)
            if x0 >= x1 or y0 >= y1:
                cut.append((fx, fy, fw, fh))
            else:
                cut += [(fx, fy, x0 - fx, fh), (x1, fy, fx + fw - x1, fh), (x0, fy, x1 - x0, y0 - fy), (x0, y1, x1 - x0, fy + fh - y1)]
        cut = list(dict.fromkeys(c for c in cut if c[2] > 0 and c[3] > 0))
        free = [c for c in cut if not any(o != c and o[0] <= c[0] and o[1] <= c[1] and o[0] + o[2] >= c[0] + c[2] and o[1] + o[3] >= c[1] + c[3] for o in cut)]
    return out


def slow_shelf(boxes, width, turn):
    x = y = tall = 0
    out = []
    for w, h in boxes:
        after = lambda bw, bh: (y + tall, bh) if x > 0 and x + bw > width else (y, max(tall, bh))  # noqa: B023, E731
        turned = turn and w != h and h <= width and after(h, w) < after(w, h)
        bw, bh = (h, w) if turned else (w, h)
        if x > 0 and x + bw > width:
            x, y, tall = 0, y + tall, 0
        if bw > width:
            return None
        out.append((x, y, turned))
        x, tall = x + bw, max(tall, bh)
    return out


def used(boxes, spots):
    placed = [(p[0] + (h if p[2] else w), p[1] + (w if p[2] else h)) for (w, h), p in zip(boxes, spots, strict=True) if p]
    return max((a for a, _ in placed), default=0), max((b for _, b in placed), default=0)


RANKS = {"gpu": lambda w, h: (max(w, h), w * h, abs(w - h), w), "space": lambda w, h: (w * h, max(w, h), abs(w - h), w)}


def slow_compact(sprites, limits, goal):
    gap = limits.gap
    padded = {s[0]: (s[1] + gap, s[2] + gap) for s in sprites}
    most, least = min(sum(w for w, _ in padded.values()), limits.max_width), max(w for w, _ in padded.values())
    root = max(min(math.ceil(math.sqrt(sum(w * h for w, h in padded.values()))), most), least)
    step = max(8, (most - root) // 24)
    widths = sorted({w for a in (root, least, most) for m in layouts.OFFSETS if least <= (w := a + step * m) <= most} | {root})
    tries = [(root, o, m) for o in KEYS for m in SCORES] + [(w, o, m) for w in widths for o in ("height", "area", "maxside", "none") for m in (*SCORES, "shelf")]
    best = None
    for width, order, method in tries:
        ordered = sorted(sprites, key=lambda s: (*KEYS[order](s), s[0]))
        boxes = [padded[s[0]] for s in ordered]
        spots = slow_shelf(boxes, width, limits.rotate) if method == "shelf" else slow_maxrects(boxes, width, limits.max_height, method, limits.rotate)
        if spots and used(boxes, spots)[1] <= limits.max_height:
            rank = RANKS[goal](*used(boxes, spots))
            if best is None or rank < best[0]:
                best = rank, {s[0]: p for s, p in zip(ordered, spots, strict=True)}
    return best[1] if best else {}


def made(spark, seed, jobs, most):
    rng = random.Random(seed)
    found = [(j, k, f"p{k}.png", rng.randint(3, most), rng.randint(3, most)) for j in range(jobs) for k in range(rng.randint(1, 9))]
    return found, spark.createDataFrame(found, "job long, seq long, path string, w int, h int")


@pytest.mark.parametrize(("goal", "turn"), [("gpu", False), ("space", True), ("gpu", True)])
def test_compact_is_the_best_of_all_candidates(spark, goal, turn):
    found, sprites = made(spark, 5, 8, 40)
    limits = layouts.Limits(120, 200, 1, rotate=turn)
    got = rows(layouts.compact(sprites, limits, goal), "job", "seq", "x", "y", "rotated")
    want = [(j, k, *p) for j in range(8) for k, p in slow_compact([f[1:2] + f[3:] for f in found if f[0] == j], limits, goal).items()]
    assert got == sorted(want)


def slow_multipack(sprites, limits, goal):
    gap, left, out, atlas = limits.gap, list(sprites), [], 0
    while left:
        narrow = min(min(s[1], s[2]) if limits.rotate else s[1] for s in left) + gap
        area = sum(s[1] * s[2] for s in left)
        root, step = math.ceil(math.sqrt(area)), max(8, (limits.max_width - narrow) // 24)
        widths = sorted({w for w in (narrow, limits.max_width, root, *(narrow + m * step for m in layouts.OFFSETS)) if narrow <= w <= limits.max_width})
        best = None
        for order in KEYS:
            ordered = sorted(left, key=lambda s: (*KEYS[order](s), s[0]))  # noqa: B023
            boxes = [(s[1] + gap, s[2] + gap) for s in ordered]
            for width in widths:
                for method in SCORES:
                    spots = slow_maxrects(boxes, width, limits.max_height, method, limits.rotate, partial=True)
                    packed = [s for s, p in zip(ordered, spots, strict=True) if p]
                    filled = sum(s[1] * s[2] for s in packed)
                    rank = ((-len(packed), -filled) if goal == "gpu" else (-filled, -len(packed))) + RANKS[goal](*used(boxes, spots))
                    if packed and (best is None or rank < best[0]):
                        best = rank, {s[0]: p for s, p in zip(ordered, spots, strict=True) if p}
        if best is None:
            return []
        out += [(k, atlas, *p) for k, p in best[1].items()]
        left, atlas = [s for s in left if s[0] not in best[1]], atlas + 1
    return out


@pytest.mark.parametrize(("goal", "turn"), [("gpu", True), ("space", False)])
def test_multipack_takes_the_best_atlas_each_time(spark, goal, turn):
    found, sprites = made(spark, 6, 5, 30)
    limits = layouts.Limits(48, 40, 1, rotate=turn)
    got = rows(layouts.multipack(sprites, limits, goal), "job", "seq", "atlas_index", "x", "y", "rotated")
    want = [(j, *p) for j in range(5) for p in slow_multipack([f[1:2] + f[3:] for f in found if f[0] == j], limits, goal)]
    assert got == sorted(want)


def test_a_first_pass_bounds_the_rest(spark):
    found, sprites = made(spark, 7, 6, 40)
    limits = layouts.Limits(150, 300, 1)
    for goal in ("gpu", "space"):
        placed, effort = layouts.searched(sprites, layouts.compact_candidates, limits, goal)
        want = [(j, k, *p) for j in range(6) for k, p in slow_compact([f[1:2] + f[3:] for f in found if f[0] == j], limits, goal).items()]
        assert rows(placed, "job", "seq", "x", "y", "rotated") == sorted(want)
        told = effort.collect()
        assert len(told) == 6 and all(r["packings"] <= r["candidates"] and r["given_up"] <= r["packings"] for r in told)
        assert goal == "space" or sum(r["packings"] for r in told) < sum(r["candidates"] for r in told)


def test_an_earlier_width_is_the_first_passes(spark):
    _, sprites = made(spark, 8, 4, 30)
    limits = layouts.Limits(200, 200)
    sized = layouts.bounds(sprites, limits)
    hints = sized.selectExpr("job", "least + 1 as hint").where("job < 3")
    first = layouts.compact_candidates(sized, limits, hints).where(f"cand < {layouts.FIRST_PASS}")
    got = rows(first.select("job", "width").distinct())
    want = [(r["job"], r["least"] + 1 if r["job"] < 3 and r["least"] < r["most"] else r["root"]) for r in sized.collect()]
    assert got == sorted(want)


def test_one_large_job_is_packed_in_rounds(spark):
    rng = random.Random(3)
    found = [(0, k, f"p{k}.png", rng.randint(3, 30), rng.randint(3, 30)) for k in range(400)]
    sprites = spark.createDataFrame(found, "job long, seq long, path string, w int, h int")
    limits = layouts.Limits(96, 96, order="area")
    got = layouts.multipack(sprites, limits).collect()
    assert sorted(r["seq"] for r in got) == list(range(400)) and {r["atlas_index"] for r in got} == set(range(max(r["atlas_index"] for r in got) + 1))
    cover = {}
    for r in got:
        for x in range(r["x"], r["x"] + r["w"]):
            for y in range(r["y"], r["y"] + r["h"]):
                assert x < 96 and y < 96 and cover.setdefault((r["atlas_index"], x, y), r["seq"]) == r["seq"]


def test_multipack_of_what_fits_nowhere(spark):
    sprites = spark.createDataFrame([(0, 0, "a", 9, 9), (0, 1, "b", 99, 9), (1, 0, "c", 5, 5)], "job long, seq long, path string, w int, h int")
    assert rows(layouts.multipack(sprites, layouts.Limits(20, 20)), "job", "seq", "atlas_index") == [(1, 0, 0)]
    assert layouts.multipack(sprites.where("job > 5"), layouts.Limits(20, 20)).count() == 0
