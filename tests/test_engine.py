"""Operators on sprites, layouts and images, held against plain Python and against invariants."""

import io
import json
import random
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import rows

from tessera import api
from tessera.functions import scalars as s
from tessera.operators import kernels, png, raster
from tessera.operators import relations as r
from tessera.options import options
from tessera.plans import atlases, documents, layouts
from tessera.sources import images, sinks, texts


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


def test_natural_order(spark):
    paths = ["walk 10", "walk (10)", "walk_2", "walk 2", "walk (2)", "walk_10", "a01", "a1", "file10name", "file1name", "", "z"]
    made = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [x["path"] for x in made.orderBy(s.natural_key(F.col("path")), "path").collect()]
    assert got == ["", "a01", "a1", "file1name", "file10name", "walk (2)", "walk (10)", "walk 2", "walk 10", "walk_2", "walk_10", "z"]


@pytest.mark.parametrize(("text", "pair"), [("10,20", (10, 20)), ("1020", None), ("10,", None), (",20", None), ("10,20,30", None), (" 1,2", None), ("-1,2", (-1, 2))])
def test_pairs(spark, text, pair):
    got = one(spark, text, s.parse_pair)
    assert (tuple(got) if got else None) == pair


def test_numbers_and_names(spark):
    assert [one(spark, v, s.parse_int) for v in ("5", "-5", "+5", "5 ", "", "99999999999")] == [5, -5, None, None, None, None]
    assert one(spark, "0", s.parse_positive) is None and one(spark, "1e400", s.parse_double) is None and one(spark, "2.5", s.parse_double) == 2.5
    assert [one(spark, v, s.stem) for v in ("a/b.c.png", ".png", "x/.hid", "plain")] == ["b.c", ".png", ".hid", "plain"]
    assert [one(spark, v, s.css_name) for v in ("a b", "1x", "ok-_")] == ["a-b", "_1x", "ok-_"]
    assert one(spark, 'a"b,c', s.csv_field) == '"a""b,c"' and one(spark, "<a & 'b'>", s.xml_text) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, 'a"\\b', s.quoted) == '"a\\"\\\\b"' and one(spark, "run_01 (2)", s.animation_base) == "run"


def test_index_patterns(spark):
    assert one(spark, "12", lambda c: s.index_path("atlas_%d%%.png", c)) == "atlas_12%.png" == atlases.atlas_name("atlas_%d%%.png", 12)
    for bad in ("%s", "x%"):
        with pytest.raises(ValueError):
            s.check_index_pattern(bad)
    with pytest.raises(ValueError):
        s.check_index_pattern("atlas.png", 2)


def test_fnv1a(spark):
    for text in ("", "a", "foobar", "ünï😀"):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        assert one(spark, text, lambda c: s.unsigned(s.fnv1a(c))) == str(h) and one(spark, text, lambda c: s.hex16(s.fnv1a(c))) == f"{h:016x}"


def test_powers_of_two(spark):
    made = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 1023, 1024, 1025)], "n int")
    assert [x[0] for x in made.select(s.next_power_of_two(F.col("n"))).collect()] == [1, 1, 2, 4, 4, 8, 1024, 1024, 2048]


LAYOUT = """# made by hand
root "./frames"
scale 0.5
extrude 2
multipack true
atlas 64,32
sprite "./frames/a.png" 0,0 16,16
sprite "./frames/b\\"q.png" 16,0 8,8 1,2 3,4 rotated
sprite "c.png" 0 16 8 8 1 2 dither colors=8 slice=1,2,3,4,repeat,stretch
atlas 128 64
sprite "d.png" 28,0 100,64
alias "e.png" "./frames/a.png"
"""


def parsed(spark, text, file="f"):
    return texts.parse_layouts(texts.split_lines(spark.createDataFrame([(file, text)], "file string, value string")))


def test_layouts_are_read(spark):
    p = parsed(spark, LAYOUT)
    assert p["errors"].count() == 0
    assert rows(p["header"]) == [("f", "./frames", 0.5, 2, True)] and rows(p["atlas"]) == [("f", 0, 64, 32), ("f", 1, 128, 64)]
    got = rows(p["sprite"].drop("file", "slice"))
    assert got[1] == (1, './frames/b"q.png', 0, 16, 0, 8, 8, 1, 2, 3, 4, True, True, False, 0)
    assert got[2] == (2, "c.png", 0, 0, 16, 8, 8, 1, 2, 0, 0, True, False, True, 8) and got[3][2] == 1
    assert p["sprite"].where("index = 2").first()["slice"].asDict() == {"left": 1, "top": 2, "right": 3, "bottom": 4, "h": "repeat", "v": "stretch"}
    assert rows(p["alias"]) == [("f", 0, "e.png", "./frames/a.png")]


def test_layouts_round_trip(spark):
    p = parsed(spark, LAYOUT)
    written = sinks.as_texts(texts.layout_lines(p["header"], p["atlas"], p["sprite"], p["alias"])).first()["value"]
    again = parsed(spark, written)
    for name in ("header", "atlas", "sprite", "alias"):
        assert rows(again[name]) == rows(p[name])


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ("atlas 512", "bad atlas size"), ("atlas 0,5", "bad atlas size"), ("notatlas 1,2", "unknown line"), ("extrude", "bad extrude"), ("extrude -1", "bad extrude"), ("scale 0", "bad scale"), ("multipack maybe", "bad multipack"),
        ('sprite "p" 500,0 100,100', "sprite outside its atlas"), ('sprite "p" -1,0 10,10', "negative value"), ('sprite "p" 0,0 10', "bad rectangle"), ('sprite "p" 0,0', "bad number of fields"), ("sprite 0,0 1,1", "no quoted path"),
        ('sprite "p" 0,0 1,1 colors=1', "bad colors"), ('sprite "p" 0,0 1,1 slice=abc', "bad slice"), ('sprite "p" 0,0 1,1 slice=1,2,3', "bad slice"), ('sprite "p" 0,0 1,1 slice=1,2,3,4,5', "bad slice"), ('sprite "p" 0,0 1,1 slice=1,2,3,4,odd,stretch', "bad slice"),
        ('sprite "p" 412,412 100,100', None), ('sprite "p" 0,0 1,1 slice=8,8,8,8,repeat,stretch', None), ('sprite "p" 0 0 32 32', None), ("extrude 2", None),
    ],
)
def test_layout_rules(spark, line, error):
    p = parsed(spark, "atlas 512,512\n" + line)
    assert [x["error"] for x in p["errors"].collect()] == ([error] if error else [])


def test_layouts_need_an_atlas_and_say_things_once(spark):
    assert {x["error"] for x in parsed(spark, "scale 1")["errors"].collect()} == {"no atlas"}
    assert {x["error"] for x in parsed(spark, 'sprite "a" 0,0 1,1\natlas 2,2\nscale 1\nscale 2')["errors"].collect()} == {"sprite before any atlas", "repeated scale"}


MARKERS = """path "./frames/a.png"
- marker "hit" point 3,5
- marker "hurt" circle 6,7 4
- marker "bad" circle 1
path "b"
- marker "foot" rectangle 1,2 3,4
- marker "zone" polygon 0,0 4,0 4,4
"""
ANIMATIONS = """animation "run"
- frame "./frames/a.png"
- frame "b"
fps 12
animation "idle"
- frame 1
- frame 9
- frame "nobody"
animation "run-alias" alias "run" flip h
"""
DOC = 'atlas 64,32\nscale 1\nsprite "./frames/a.png" 0,0 16,16\nsprite "./frames/b.png" 16,0 8,8 1,2 3,4 rotated\n'


@pytest.fixture(scope="module")
def document(spark):
    lines = lambda t: texts.split_lines(spark.createDataFrame([("f", t)], "file string, value string"))
    p = texts.parse_layouts(lines(DOC))
    job = lambda df: df.withColumnRenamed("file", "job")
    sprites = documents.named(job(p["sprite"]))
    marks = documents.with_sprites(job(texts.parse_markers(lines(MARKERS))), sprites)
    moving, frames = texts.parse_animations(lines(ANIMATIONS))
    return documents.documents(job(p["header"]), job(p["atlas"]), sprites, marks, job(moving), documents.resolved_frames(job(frames), sprites)).cache()


def test_markers_and_animations_meet_their_sprites(document):
    doc = document.first()
    assert [(m["name"], m["sprite_index"], m["type"]) for m in doc["markers"]] == [("hit", 0, "point"), ("hurt", 0, "circle"), ("foot", 1, "rectangle"), ("zone", 1, "polygon")]
    assert [(a["name"], a["fps"], [f["index"] for f in a["frames"]], a["alias_source"], a["flip"]) for a in doc["animations"]] == [("run", 8, [0, 1], "", ""), ("idle", 12, [1], "", ""), ("run-alias", 12, [], "run", "h")]


@pytest.mark.parametrize("kind", documents.RENDERINGS)
def test_renderings(document, kind):
    text = documents.rendered(document, kind).first()["content"]
    assert text
    if documents.RENDERINGS[kind][1] == ".json":
        json.loads(text)
    if kind == "csv":
        assert "1,b,./frames/b.png,0,atlas_0.png,16,0,8,8,0,0,1,2,3,4,2," in text and text.count("\nmarker,") == 4 and "animation,2,run-alias,alias,run,h\n" in text
    if kind == "css":
        assert "background-position: -16px -0px;" in text
    if kind in ("phaser-hash", "aseprite"):
        sizes = {name: f for name, f in json.loads(text)["frames"].items()} if kind == "phaser-hash" else {f["filename"]: f for f in json.loads(text)["frames"]}
        assert sizes["a"]["sourceSize"] == {"w": 16, "h": 16} and sizes["b"]["sourceSize"] == {"w": 12, "h": 14} and sizes["b"]["trimmed"]
    if kind == "aseprite":
        assert [(t["from"], t["to"]) for t in json.loads(text)["meta"]["frameTags"]] == [(0, 1), (1, 1)]


def test_unity_numbers(spark):
    p = parsed(spark, 'atlas 100,200\nsprite "player.png" 10,20 30,40 5,5 5,5\n')
    job = lambda df: df.withColumnRenamed("file", "job")
    marks = spark.createDataFrame([("f", 0, 0, "pivot", "point", 20, 30)], "job string, index int, sprite_index int, name string, type string, x int, y int")
    got = documents.sprite_fields(documents.named(job(p["sprite"])), job(p["atlas"]), marks).first()
    assert (got["unity_y"], got["pivot_x_norm"], round(got["pivot_y_norm"], 9), got["pivot_y_norm_raw"]) == (140, 0.5, 0.4, 0.6)


def test_lists_and_exclusions(spark):
    lines = texts.split_lines(spark.createDataFrame([("l", 'root "frames"\n# note\nexclude "c.png"\na.png\nc.png\n"b.png"\n/abs.png\n')], "file string, value string"))
    assert sorted(x["path"] for x in texts.parse_lists(lines).collect()) == ["/abs.png", "frames/a.png", "frames/b.png"]
    found = spark.createDataFrame([("file:/in/a.png",), ("file:/in/b.png",), ("file:/in/x/c.png",)], "path string")
    ignore = spark.createDataFrame([('exclude "b.png"',), ("# x",), ("/in/x/c.png",)], "text string")
    assert rows(texts.excluded(found, ignore, "/in")) == [("file:/in/a.png",)]


def test_frames_in_all_forms(spark):
    lines = texts.split_lines(spark.createDataFrame([("s.png", 'path "s.png"\nsprite 0,0 1,1\nsprite "n" 2,3 4,5 rotated\n')], "file string, value string"))
    frames = texts.parse_frames(lines)
    assert rows(frames.drop("file")) == [(0, "sprite_0", 0, 0, 1, 1, False), (1, "n", 2, 3, 4, 5, True)]
    assert [x["text"] for x in texts.frame_lines(frames).orderBy("ord").collect()] == ['path "s.png"', "sprite 0,0 1,1", "sprite 2,3 4,5"]
    by_name = '{"frames": {"a": {"frame": {"x": 1, "y": 2, "w": 3, "h": 4}, "rotated": true}}}'
    listed = '{"frames": [{"filename": "a", "frame": {"x": 1, "y": 2, "w": 3, "h": 4}, "rotated": true}]}'
    for text in (by_name, listed, listed[11:-1]):
        assert rows(texts.parse_frames_json(spark.createDataFrame([("s", text)], "file string, value string"))) == [("s", 0, "a", 1, 2, 3, 4, True)]


# Packing.


def free_of_overlaps(boxes, spots, width, height):
    cells = np.zeros((height, width), int)
    for (w, h), (x, y, turned) in zip(boxes, spots, strict=True):
        w, h = (h, w) if turned else (w, h)
        assert 0 <= x and 0 <= y and x + w <= width and y + h <= height
        cells[y : y + h, x : x + w] += 1
    return cells.max(initial=0) <= 1


@pytest.mark.parametrize("turn", [False, True])
def test_kernels_never_overlap(turn):
    rng = random.Random(8)
    for _ in range(25):
        boxes = [(rng.randint(1, 20), rng.randint(1, 20)) for _ in range(rng.randint(1, 30))]
        for h in kernels.HEURISTICS:
            spots = kernels.maxrects(boxes, 60, 400, h, turn)
            assert spots is None or free_of_overlaps(boxes, spots, 60, 400)
        shelf = kernels.shelf(boxes, 60, turn)
        assert free_of_overlaps(boxes, shelf, 60, 1000)
        cut = kernels.guillotine(boxes, 200, 200, turn)
        assert cut is None or free_of_overlaps(boxes, cut, 200, 200)
        some = kernels.maxrects(boxes, 25, 25, "area", turn, partial=True)
        kept = [(b, p) for b, p in zip(boxes, some, strict=True) if p]
        assert kept and free_of_overlaps(*zip(*kept, strict=True), 25, 25)
        pinned = [(0, 0, 10, 10)]
        assert all(not (x < 10 and y < 10) for x, y, _ in kernels.maxrects(boxes, 60, 400, "short_side", turn, taken=pinned) or ())


def sprite_rows(spark, sizes, job=0):
    return spark.createDataFrame([(job, i, f"s{i}.png", w, h) for i, (w, h) in enumerate(sizes)], "job long, seq long, path string, w int, h int")


def size_of(placed):
    return tuple(r.tight_bounds(placed).select("width", "height").first())


def test_layouts_of_the_known_cases(spark):
    pixels = sprite_rows(spark, [(1, 1)] * 17)
    pot = layouts.power_of_two(pixels, layouts.Limits(1024, 1024))
    assert pot.count() == 17 and all(v <= 8 for v in size_of(pot))
    gpu, space = layouts.compact(pixels, layouts.Limits(), "gpu"), layouts.compact(pixels, layouts.Limits(), "space")
    assert max(size_of(gpu)) <= min(max(size_of(space)), max(size_of(layouts.fast(pixels))))
    assert size_of(layouts.compact(pixels, layouts.Limits(4096, 4)))[1] <= 4
    assert size_of(layouts.compact(sprite_rows(spark, [(60, 60)] * 3), layouts.Limits(120, 120))) == (120, 120)
    turned = sprite_rows(spark, [(3, 2), (3, 2)])
    assert layouts.compact(turned, layouts.Limits(4, 3, rotate=True)).where("rotated").count() >= 1 and layouts.compact(turned, layouts.Limits(4, 3)).count() == 0
    assert {x["atlas_index"] for x in layouts.multipack(sprite_rows(spark, [(1, 1)] * 3), layouts.Limits(1, 1)).collect()} == {0, 1, 2}
    assert layouts.multipack(sprite_rows(spark, [(9, 9)]), layouts.Limits(4, 4)).count() == 0
    area = lambda goal: sum(x["width"] * x["height"] for x in r.tight_bounds(layouts.multipack(sprite_rows(spark, [(10, 10), (10, 10), (1, 30)]), layouts.Limits(30, 30), goal)).collect())
    assert area("space") <= area("gpu")
    assert [x["seq"] for x in layouts.fast(sprite_rows(spark, [(40, 40), (10, 10), (20, 20), (30, 30)]), layouts.Limits(40, 400)).orderBy("y", "x").collect()] == [0, 3, 2, 1]


def test_grid_needs_equal_sizes(spark):
    assert layouts.grid(sprite_rows(spark, [(2, 2), (2, 3)])).count() == 0 and r.odd_sizes(sprite_rows(spark, [(2, 2), (2, 3)])).first()["path"] == "s1.png"
    placed = layouts.grid(sprite_rows(spark, [(2, 2)] * 5), layouts.Limits(100, 4))
    assert size_of(placed) == (6, 4)


def with_paths(placed, source):
    return placed.join(source.select("job", "seq", "path"), ["job", "seq"])


def test_incremental_keeps_places_by_path(spark):
    sizes = {"a.png": (5, 5), "b.png": (6, 4), "c.png": (3, 9)}
    make = lambda names: spark.createDataFrame([(0, k, n, *sizes.get(n, (2, 2)), 0) for k, n in enumerate(names)], "job long, seq long, path string, w int, h int, trim_left int")
    limits, first = layouts.Limits(64, 64), make(sorted(sizes))
    old = with_paths(layouts.compact(first.drop("trim_left"), limits), first).persist()
    spots = {r["path"]: (r["x"], r["y"]) for r in old.collect()}
    for names in (["0.png", "a.png", "b.png", "c.png"], ["c.png", "b.png", "x.png", "a.png"], ["b.png"]):
        source = make(names)
        got = with_paths(layouts.incremental(source, old, limits), source)
        assert {r["path"]: (r["x"], r["y"]) for r in got.collect() if r["path"] in sizes} == {n: spots[n] for n in names if n in sizes}
        assert got.count() == len(names) and r.overlaps(got).count() == 0
    # Another trim: c.png is placed anew.
    source = make(["0.png", "a.png", "b.png", "c.png"])
    moved = with_paths(layouts.incremental(source, old.withColumn("trim_left", F.when(F.col("path") == "c.png", 1).otherwise(0)), limits), source)
    assert {r["path"]: (r["x"], r["y"]) for r in moved.collect() if r["path"] in "a.png b.png"} == {n: spots[n] for n in ("a.png", "b.png")}
    assert moved.count() == 4 and r.overlaps(moved).count() == 0


@pytest.mark.parametrize("change", ["x = 0, y = 0", "x = x + 60", "x = -1", "path = 'z'"])
def test_incremental_refuses_what_does_not_fit(spark, change):
    source = sprite_rows(spark, [(5, 5), (6, 4), (3, 9)])
    limits = layouts.Limits(64, 64)
    old = with_paths(layouts.compact(source, limits), source)
    for part in change.split(", "):
        name, to = part.split(" = ")
        old = old.withColumn(name, F.expr(to))
    assert layouts.incremental(source, old, limits).count() == 0
    o = options(mode="compact", incremental=True, max_width=64, max_height=64)
    fresh = api.layout(source, o, previous=old)
    assert fresh["sprite"].count() == 3 and fresh["error"].count() == 0 and r.overlaps(fresh["sprite"]).count() == 0


def test_odd_sprites_of_a_grid_are_named(spark):
    got = api.layout(sprite_rows(spark, [(2, 2), (2, 3)]), options(mode="grid"))
    assert [r["message"] for r in got["error"].collect()] == ["s1.png is 2x3, not the size of the first sprite of the grid"]


def test_overlaps_are_found_once(spark):
    rng = random.Random(9)
    boxes = [(0, 0, i, rng.randint(0, 150), rng.randint(0, 150), rng.randint(1, 90), rng.randint(1, 90)) for i in range(40)]
    boxes += [(0, 0, 40, -30, 20, 5000, 3), (0, 0, 41, 100, 100, 1, 1), (0, 0, 42, 0, 0, 64, 64), (0, 0, 43, 63, 63, 65, 2)]
    made = spark.createDataFrame(boxes, "job int, atlas_index int, seq int, x int, y int, w int, h int")
    want = [(a[2], b[2]) for a in boxes for b in boxes if a[2] < b[2] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[6] and b[4] < a[4] + a[6]]
    assert rows(r.overlaps(made), "a", "b") == sorted(want)


def hash_rows(spark, hashes):
    return spark.createDataFrame([(0, 8, 8, i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "job int, w int, h int, seq int, perceptual_hash long")


@pytest.mark.parametrize("threshold", [0, 1, 5, 15, 30])
def test_similar_pairs_match_all_pairs(spark, threshold):
    rng = random.Random(10)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 20))}) for h in hashes] + [0, 0, 1 << 63, (1 << 63) | 5]
    made = hash_rows(spark, hashes)
    want = [(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if hashes[i] and hashes[j] and bin(hashes[i] ^ hashes[j]).count("1") <= threshold]
    assert rows(r.similar_pairs(made, threshold), "a", "b") == want
    for bands in r.band_choices(threshold):
        assert rows(r.similar_pairs(made, threshold, choices=[bands]), "a", "b") == want


def test_wider_bands_meet_fewer_pairs(spark):
    rng = random.Random(11)
    made = hash_rows(spark, [rng.getrandbits(64) | 1 for _ in range(1000)])
    met = {bands.m: r.meeting_pairs(made, 15, choices=[bands]).count() for bands in r.band_choices(15)}
    assert met[4] * 10 < met[16] and abs(met[16] / (16 * 999 * 500 / 16) - 1) < 0.1
    big, small = (min(r.band_choices(15), key=lambda b: b.cost(n)).m for n in (1e6, 1e2))  # noqa: B023
    assert (big, small) == (4, 16)


@pytest.mark.parametrize("block", [7, 40, 1 << 15])
def test_blocks_of_hashes_match_all_pairs(spark, monkeypatch, block):
    """Links and chains over copies, blank hashes, several sizes and jobs; no pair of hashes is a row anywhere."""
    rng = random.Random(12)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    hashes += [h ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 9))}) for h in hashes for _ in range(2)] + hashes[:5] * 3 + [0, 0, 1 << 63]
    made = [(i % 2, 8 + i % 3 // 2, 8, i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    near = lambda a, b: a[:3] == b[:3] and a[4] and b[4] and bin((a[4] ^ b[4]) % (1 << 64)).count("1") <= 5
    links = [(a[3], min((b[3] for b in made if near(a, b) and a[4] == b[4]), default=a[3]), sum(bool(near(a, b)) for b in made if a is not b)) for a in made]
    first = list(range(len(made)))
    for _ in made:
        first = [min([first[a[3]]] + [first[b[3]] for b in made if near(a, b)]) for a in made]
    monkeypatch.setattr(r.hash_blocks, "__defaults__", ("job", block))
    frame = spark.createDataFrame(made, "job int, w int, h int, seq int, perceptual_hash long")
    assert rows(r.similar_counts(frame), "seq", "class_seq", "links") == links
    assert rows(r.perceptual_duplicates(frame), "seq", "canonical_seq") == list(enumerate(first))


def test_dense_hashes_are_joined_without_their_pairs(spark):
    """Four hundred hashes of which any two are alike: chains tell them by fewer links than there are hashes."""
    rng = random.Random(13)
    made = hash_rows(spark, sorted({(1 << 40) | sum(1 << b for b in rng.sample(range(30), 2)) for _ in range(400)}))
    n = made.count()
    assert {x["canonical_seq"] for x in r.perceptual_duplicates(made).collect()} == {0}
    assert {x["links"] for x in r.similar_counts(made).collect()} == {n - 1}
    h = np.array([x["perceptual_hash"] for x in made.collect()], np.uint64)
    half = n // 2
    assert len(r.chains_between(h[:half], np.zeros(half, np.int64), h[half:], np.arange(half, n), 5)) == n - half
    assert set(r.chained(h, 5)) == {0}


# Images.


def picture(h, w, seed=0):
    out = np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)
    out[..., 3] = 255
    return out


def test_png_round_trip():
    p = picture(7, 5)
    assert (png.read_png(png.write_png(p)) == p).all() and png.png_size(png.write_png(p)) == (5, 7)
    with pytest.raises(ValueError):
        png.read_png(b"no")


def test_folders_and_archives(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    blank = np.zeros((3, 3, 4), np.uint8)
    blank[1, 1] = 255
    (tmp_path / "d" / "a.PNG").write_bytes(png.write_png(blank))
    (tmp_path / "d" / "e" / "b.png").write_bytes(b"broken")
    (tmp_path / "d" / "c.txt").write_text("no image")
    found = images.images(spark, str(tmp_path / "d"))
    assert found.count() == 2
    meta = {x["path"].rsplit("/", 1)[1]: x for x in images.metadata(found, trim=True, content=True, perceptual=True).collect()}
    assert [meta["a.PNG"][c] for c in ("w", "h", "trim_left", "trim_top", "trim_right", "trim_bottom")] == [1, 1, 1, 1, 1, 1] and meta["b.png"]["error"]
    assert images.metadata(found).where("w = 3 and h = 3").count() == 1
    zipped, tarred = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("in/x.png", png.write_png(blank))
        z.writestr("../out.png", b"x")
    with tarfile.open(fileobj=tarred, mode="w:gz") as t:
        for name in ("y.png", "/abs.png", "n.txt"):
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(b"x"))
    made = spark.createDataFrame([("a.zip", None, bytearray(zipped.getvalue())), ("b.tgz", None, bytearray(tarred.getvalue()))], "path string, modificationTime timestamp, content binary")
    assert rows(images.archived(made), "path") == [("a.zip/in/x.png",), ("b.tgz/y.png",)]


def test_atlases_are_drawn_and_cut_again(spark, tmp_path):
    pictures = {f"s{i}.png": picture(4 + i, 6, i) for i in range(3)}
    files = spark.createDataFrame([(n, bytearray(png.write_png(p))) for n, p in pictures.items()], "path string, content binary")
    source = spark.createDataFrame([(0, i, n, 6, 4 + i) for i, n in enumerate(pictures)], "job long, seq long, path string, w int, h int")
    placed = layouts.compact(source, layouts.Limits(11, 64, 1, rotate=True)).join(source.select("job", "seq", "path"), ["job", "seq"])
    trims = [F.lit(0).alias(c) for c in ("trim_left", "trim_top", "trim_right", "trim_bottom")]
    sheets = atlases.composed(placed.select("*", *trims), r.tight_bounds(placed), files, atlases.Finish(mask=True))
    sheet = sheets.select(F.lit("sheet").alias("path"), "content")
    frames = placed.select(F.lit("sheet").alias("file"), F.col("seq").cast("int").alias("index"), F.col("path").alias("name"), "x", "y", "w", "h", "rotated")
    bad = frames.where("index = 0").withColumns({"index": F.lit(9), "name": F.lit("../up")}).unionByName(frames.where("index = 0").withColumns({"index": F.lit(10), "x": F.lit(999)}))
    got = atlases.cut_frames(sheet, frames.unionByName(bad)).collect()
    assert sum(x["error"] is not None for x in got) == 2
    for x in got:
        if x["content"]:
            assert (png.read_png(bytes(x["content"])) == pictures[x["name"]]).all()
    done = sinks.write_files(spark.createDataFrame([("a/b.png", bytearray(b"xyz"))], "name string, content binary"), f"file://{tmp_path}").collect()
    assert done[0]["bytes"] == 3 and (tmp_path / "a/b.png").read_bytes() == b"xyz"
    with tarfile.open(fileobj=io.BytesIO(atlases.bundle([("atlas_0.png", b"1"), ("atlas_1.png", b"2")]))) as t:
        assert t.getnames() == ["atlas_0.png", "atlas_1.png"]


def test_frames_are_found(spark):
    sheet = np.zeros((20, 20, 4), np.uint8)
    sheet[1:5, 1:5] = (200, 0, 0, 255)
    sheet[10:18, 8:14] = (0, 200, 0, 255)
    sheet[0, 19] = 255
    lined = np.zeros((20, 20, 4), np.uint8)
    lined[2, 2:10] = lined[9, 2:10] = lined[2:10, 2] = lined[2:10, 9] = (255, 0, 255, 255)
    made = spark.createDataFrame([("a", bytearray(png.write_png(sheet))), ("b", bytearray(png.write_png(lined)))], "path string, content binary")
    assert rows(atlases.found_frames(made.where("path = 'a'")), "index", "x", "y", "w", "h") == [(0, 8, 10, 6, 8), (1, 1, 1, 4, 4)]
    assert rows(atlases.found_frames(made.where("path = 'b'"), bordered=True), "x", "y", "w", "h") == [(3, 3, 6, 6)]


def test_raster_operators():
    atlas = np.zeros((4, 4, 4), np.uint8)
    atlas[1:3, 1:3] = (255, 0, 0, 255)
    grown = atlas.copy()
    raster.extruded(grown, 1, 1, 2, 2, 1)
    assert (grown == (255, 0, 0, 255)).all()
    spread = atlas.copy()
    raster.dilated(spread, 1, 1, 2, 2)
    assert spread[0, 1].tolist() == [255, 0, 0, 0] and spread[0, 0].tolist() == [0, 0, 0, 0]
    p = picture(6, 4, 3)
    assert (raster.unturned(raster.turned(p)) == p).all() and raster.unmasked(raster.masked(b"abc")) == b"abc"
    for kind in ("nearest", "bilinear", "bicubic", "mitchell"):
        flat = np.full((9, 5, 4), 77, np.uint8)
        assert (raster.resampled(flat, 3, 4, kind) == 77).all()
    assert set(np.unique(raster.quantised(p, 2, True)[..., :3])) <= {0, 255} and (raster.quantised(p, 0, True) == p).all()
    framed = np.zeros((5, 5, 4), np.uint8)
    raster.outlined(framed, 0, 0, 5, 5, 1)
    assert framed[0].any() and not framed[2, 2].any()
    assert raster.write_dds(picture(8, 8))[:4] == b"DDS " and len(raster.write_dds(picture(8, 8), False)) == 128 + 4 * 8
    with pytest.raises(ValueError):
        raster.write_dds(picture(5, 8))
    assert raster.joined([[0, 0, 4, 4], [3, 3, 4, 4], [20, 20, 2, 2]]) == [(0, 0, 7, 7), (20, 20, 2, 2)]
    with pytest.raises(ValueError):
        atlases.Finish(format="webp")


def test_caches(spark):
    cache = spark.createDataFrame([("a", False, 1, 1, 5, "x"), ("b", False, 1, 1, 0, "x")], "path string, trim boolean, length long, mtime long, content_hash long, cached_at string")
    now = spark.createDataFrame([("a", False, 1, 1), ("b", False, 1, 1), ("c", False, 1, 1)], "path string, trim boolean, length long, mtime long")
    assert rows(r.cache_hits(now, cache, need_content=True), "path", "hit") == [("a", True), ("b", False), ("c", False)]
    fresh = now.where("path <> 'a'").withColumn("content_hash", F.lit(7).cast("long"))
    assert rows(r.merged_cache(cache, fresh, F.lit("y")), "path", "content_hash", "cached_at") == [("a", 5, "x"), ("b", 7, "y"), ("c", 7, "y")]
    prints = r.fingerprint(spark.createDataFrame([(0, 1, "b", 1, 1), (0, 0, "a", 1, 1)], "job int, seq int, path string, length int, mtime int"))
    assert r.signature(prints, {"padding": 1}).first()["signature"] != r.signature(prints, {"padding": 2}).first()["signature"]


def test_options():
    from tessera import options as o

    assert o.options().mode == "fast" and o.options("legacy").padding == 1 and o.options("desktop", preset="small").optimize == "space"
    assert o.options("space", mode="fast").rotate and o.options(sort="stable:width").order == ("width", True)
    half = o.options(source_resolution=(100, 200), target_resolution=(50, 50), scale=0.5)
    assert half.whole_scale == 0.25 and o.options(source_resolution=(100, 200), target_resolution=(50, 50), resolution_reference="smallest").whole_scale == 0.25
    mine = "[profile tiny]\n# x\nmax_width=8\nrotate=yes\n"
    assert o.options("tiny", profiles=mine).max_width == 8
    for wrong in ({"scale": 0}, {"scale": 2}, {"dedup_threshold": 65}, {"mode": "odd"}, {"source_resolution": (1, 1)}, {"sort": "odd"}):
        with pytest.raises(ValueError):
            o.options(**wrong)
    for text in ("[profile a]\nnot an option\n", "x=1\n", "[profile a]\nodd=1\n"):
        with pytest.raises(ValueError):
            o.parse_profiles(text)
    assert o.parse_colour("#f0f") == o.parse_colour("rgb(255, 0, 255)") == o.parse_colour("#FF00ff") == (255, 0, 255) and o.parse_colour("1,2,3,4") == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        o.parse_colour("256,0,0")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    for job in ("walk", "run"):
        (top / job).mkdir()
        for i in range(4):
            p = np.zeros((10, 12, 4), np.uint8)
            p[2 : 6 + i % 3, 3:9] = picture(4 + i % 3, 6, i % 3)
            (top / job / f"f_{i}.png").write_bytes(png.write_png(p))
    return top


@pytest.mark.parametrize("mode", ["fast", "compact", "pot", "grid"])
def test_from_folder_to_documents(spark, folder, mode):
    from tessera import api
    from tessera.options import options

    o = options(mode=mode, trim_transparent=mode != "grid", deduplicate="none" if mode == "grid" else "exact", max_width=64, max_height=64, padding=1)
    found = api.layout(api.folder_sprites(spark, str(folder), o), o)
    assert found["sprite"].count() == (8 if mode == "grid" else 6) and found["alias"].count() == (0 if mode == "grid" else 2)
    assert r.overlaps(found["sprite"]).count() == 0 and r.out_of_bounds(found["sprite"], found["atlas"]).count() == 0
    sheets = api.pack(found, images.images(spark, str(folder))).collect()
    sizes = {x["job"]: (x["width"], x["height"]) for x in found["atlas"].collect()}
    assert {x["job"]: png.png_size(bytes(x["content"])) for x in sheets} == sizes
    if mode == "pot":
        assert all(v & (v - 1) == 0 for wh in sizes.values() for v in wh)


def test_conversion_with_auto_animations(spark):
    from tessera import api

    lines = texts.split_lines(spark.createDataFrame([("f", 'atlas 64,16\nsprite "f_10.png" 0,0 8,8\nsprite "f_2.png" 8,0 8,8\nsprite "x.png" 16,0 8,8\n')], "file string, value string"))
    doc = json.loads(api.convert(lines, "json", auto=True).first()["content"])
    assert [(a["name"], a["sprite_indexes"]) for a in doc["animations"]] == [("f", [0, 1])]
    assert api.convert(lines, "unity.anim", auto=True).first()["name"] == "f.anim"


def test_watching_a_folder(spark, folder, tmp_path):
    from tessera import api
    from tessera.options import options
    from tessera.streaming.watch import newest, watch

    watch(spark, str(folder), f"{tmp_path}/cache", f"{tmp_path}/state", trim=True).awaitTermination()
    cache = newest(spark, f"{tmp_path}/cache")
    assert cache.count() == 8
    o = options(trim_transparent=True, deduplicate="exact")
    files = images.images(spark, str(folder)).withColumn("job", F.lit(0).cast("long"))
    assert rows(api.source_sprites(files, o, cache), "path", "w", "h", "content_hash") == rows(api.source_sprites(files, o), "path", "w", "h", "content_hash")


def test_seeds_are_taken_over_or_hint_at_widths(spark, folder):
    o = options(mode="compact", padding=1)
    found = api.folder_sprites(spark, str(folder), o)
    first = api.layout(found, o)
    seeds = first["sprite"].persist()
    again = api.layout(found, o, seeds=seeds)
    columns = ("job", "seq", "x", "y", "w", "h", "rotated")
    assert rows(again["sprite"], *columns) == rows(seeds, *columns) and first["error"].count() == 0
    moved = seeds.withColumn("x", F.col("x") + 5)  # kept where they are, for they still fit
    assert rows(api.layout(found, o, seeds=moved)["sprite"], *columns) == rows(moved, *columns)
    heaped = seeds.withColumns({"x": F.lit(0), "y": F.lit(0)})
    assert r.overlaps(api.layout(found, o, seeds=heaped)["sprite"]).count() == 0
    trimmed = seeds.withColumn("trim_left", F.col("trim_left") + 1)
    assert r.reusable_seeds(found, trimmed).count() == 0 and r.reusable_seeds(found, seeds, 1).count() == found.select("job").distinct().count()


def test_jobs_without_a_layout_say_why(spark):
    sprites = spark.createDataFrame([(1, 0, "a", 9, 9), (2, 0, "b", 99, 9), (3, 0, "c", 60, 60), (3, 1, "d", 60, 60)], "job long, seq long, path string, w int, h int")
    for mode in ("fast", "compact", "pot"):
        found = api.layout(sprites, options(mode=mode, max_width=64, max_height=64))
        assert rows(found["error"]) == [(2, "b exceeds the atlas limits"), (3, "no layout within the limits")]
        assert {x["job"] for x in found["sprite"].collect()} == {1}


def test_stored_outputs_are_found_by_signature(spark):
    images_ = spark.createDataFrame([(1, 0, "a", 5, 6), (1, 1, "b", 7, 8), (2, 0, "a", 5, 7)], "job long, seq long, path string, length long, mtime long")
    signed = r.signature(r.fingerprint(images_), {"mode": "fast", "padding": 1})
    stored = signed.where("job = 1").select("signature", F.lit("old").alias("content"), F.lit(1).alias("cached_at"))
    stored = stored.unionByName(stored.withColumns({"content": F.lit("new"), "cached_at": F.lit(2)}))
    assert rows(r.stored_outputs(signed, stored), "job", "content", "hit") == [(1, "new", True), (2, None, False)]
    other = r.signature(r.fingerprint(images_), {"mode": "fast", "padding": 2})
    assert r.stored_outputs(other, stored).where("hit").count() == 0


def test_frames_beside_their_sheets(spark):
    js = '{"frames": {"one": {"frame": {"x": 1, "y": 2, "w": 3, "h": 4}, "rotated": false}}}'
    files = spark.createDataFrame(
        [("d/a.json", js), ("d/a.frames", "sprite 9,9 9,9"), ("d/b.frames", 'path "b"\nsprite "two" 5,6 7,8 rotated'), ("d/c.frames", ' [{"filename": "three", "frame": {"x": 1, "y": 1, "w": 2, "h": 2}}]'), ("d/d.txt", "sprite 1,1 1,1")],
        "path string, value string",
    )
    sheets = spark.createDataFrame([(f"d/{n}.png",) for n in "abcd"], "path string")
    got = api.sheet_frames(sheets, files)
    assert rows(got, "file", "name", "x", "y", "w", "h", "rotated") == [("d/a.png", "one", 1, 2, 3, 4, False), ("d/b.png", "two", 5, 6, 7, 8, True), ("d/c.png", "three", 1, 1, 2, 2, False)]


def test_renderings_are_listed(spark):
    own = {"mine": ("My rows", ".txt", None)}
    found = [(x["name"], x["extension"]) for x in documents.listing(spark, own).collect()]
    assert found == sorted(found) and ("mine", ".txt") in found and ("unity.anim", ".anim") in found and len(found) == len(documents.RENDERINGS) + 2


def test_stores_commit_whole_versions(spark, tmp_path):
    from tessera.sources.store import Store

    where, schema = f"{tmp_path}/store", "name string, n long"
    store = Store(spark, where, schema)
    assert store.read().count() == 0
    add = lambda *names: lambda old: old.unionByName(spark.createDataFrame([(n, 1) for n in names], schema))
    assert store.update(add("a")) == 1
    # A writer that dies before its mark, and one that dies while it writes it, leave the version as it is.
    spark.createDataFrame([("lost", 1)], schema).write.parquet(f"{where}/data-dead")
    assert rows(store.read(), "name") == [("a",)]
    # A second writer that starts from the same version repeats its change on the first one's.
    other, tries = Store(spark, where, schema), []

    def late(old):
        tries.append(old.count())
        if len(tries) == 1:
            other.update(add("b"))
        return add("c")(old)

    assert store.update(late) == 3 and tries == [1, 2]
    assert rows(store.read(), "name") == [("a",), ("b",), ("c",)]

    def broken(old):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        store.update(broken)
    (tmp_path / "store" / "versions" / f"{4:012d}").write_bytes(b"data-ha")  # cut off in its name
    from tessera.sources import store as module

    module.GRACE, before = 0.3, module.GRACE
    assert rows(store.read(), "name") == [("a",), ("b",), ("c",)] and store.update(add("d")) == 5
    module.GRACE = before
    store.tidy()
    assert rows(store.read(), "name") == [("a",), ("b",), ("c",), ("d",)] and len(list((tmp_path / "store").glob("data-*"))) == 3


def test_layouts_are_remembered(spark, folder, tmp_path):
    from tessera.plans import memory

    o = options(mode="compact", padding=1, trim_transparent=True, max_width=64, max_height=64)
    files = images.images(spark, str(folder)).withColumn("job", (F.length("path") % 2).cast("long"))
    at = lambda minute: F.lit(f"2026-01-01 00:{minute:02d}:00").cast("timestamp")
    first = memory.remembered(files, o, f"{tmp_path}/kept", at(0))
    assert {x["hit"] for x in first["text"].collect()} == {False} and first["error"].count() == 0
    texts_ = rows(first["text"], "job", "content")
    again = memory.remembered(files, o, f"{tmp_path}/kept", at(5))
    assert {x["hit"] for x in again["text"].collect()} == {True} and rows(again["text"], "job", "content") == texts_
    parsed = texts.parse_layouts(texts.split_lines(again["text"].select(F.col("job").cast("string").alias("file"), F.col("content").alias("value"))))
    assert parsed["errors"].count() == 0 and parsed["sprite"].count() == files.count()
    # Other options: laid out anew, from sizes that are known; what is used again is as new.
    other = options(mode="compact", padding=2, trim_transparent=True, max_width=64, max_height=64)
    third = memory.remembered(files, other, f"{tmp_path}/kept", at(50))
    assert {x["hit"] for x in third["text"].collect()} == {False}
    metas = memory.Store(spark, f"{tmp_path}/kept/metadata", memory.META).read()
    assert metas.count() == files.count() and {str(x["cached_at"]) for x in metas.collect()} == {"2026-01-01 00:50:00"}
    late = memory.remembered(files, o, f"{tmp_path}/kept", F.lit("2026-01-01 02:00:00").cast("timestamp"))
    assert {x["hit"] for x in late["text"].collect()} == {False} and rows(late["text"], "job", "content") == texts_


def test_remembered_places_of_a_folder_that_grows(spark, folder, tmp_path):
    from tessera.plans import memory

    o = options(mode="compact", incremental=True, max_width=64, max_height=64)
    files = images.images(spark, str(folder)).withColumn("job", F.lit(1).cast("long")).persist()
    last = files.agg(F.min("path")).first()[0]
    places = lambda found: {x["path"]: (x["x"], x["y"]) for x in texts.parse_layouts(texts.split_lines(found["text"].select(F.lit("f").alias("file"), F.col("content").alias("value"))))["sprite"].collect()}
    some = places(memory.remembered(files.where(F.col("path") != last), o, f"{tmp_path}/kept"))
    every = places(memory.remembered(files, o, f"{tmp_path}/kept"))
    assert len(every) == len(some) + 1 and {p: every[p] for p in some} == some


def test_entries_that_cannot_be_true_are_dropped(spark):
    from tessera.plans import memory

    made = spark.createDataFrame([("a", 5, 5, 0), ("b", 0, 5, 0), ("c", 5, 100_001, 0), ("d", 5, 5, -1)], "path string, w int, h int, trim_left int")
    assert rows(memory.sound(made.withColumns({c: F.lit(0) for c in r.TRIMS[1:]})), "path") == [("a",)]


def test_paths_are_made_normal(spark):
    import posixpath

    paths = ["a/b", "./a//b/", "a/../b", "../a", "a/../../b", "/../a", "/a/./b/..", ".", "", "a/..", "../../x/..", "/"]
    made = spark.createDataFrame([(p,) for p in paths], "p string").select("p", s.normal_path(F.col("p")).alias("n"), s.beside(F.lit("in/list.frames"), F.col("p")).alias("b"))
    for x in made.collect():
        assert x["n"] == posixpath.normpath(x["p"]), x
        assert x["b"] == posixpath.normpath(posixpath.join("in", x["p"])), x


def test_frame_lists_that_name_their_sheet(spark):
    sheets = spark.createDataFrame([("in/x.png",), ("in/y.png",), ("in/z.png",)], "path string")
    files = spark.createDataFrame([("in/lists/one.txt", 'path "../x.png"\nsprite "a" 1,2 3,4\n'), ("in/y.json", '{"frames": {"b": {"frame": {"x": 0, "y": 0, "w": 5, "h": 6}}}}'), ("in/lists/two.txt", 'path "../y.png"\nsprite "no" 1,2 3,4\n')], "path string, value string")
    assert rows(api.sheet_frames(sheets, files), "file", "name", "w", "h") == [("in/x.png", "a", 3, 4), ("in/y.png", "b", 5, 6)]


def test_sheets_that_are_too_large_are_told(spark):
    import struct

    from tessera.operators.png import SIGNATURE

    wide = SIGNATURE + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 40_000, 2, 8, 6, 0, 0, 0)
    many = SIGNATURE + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 20_000, 20_000, 8, 6, 0, 0, 0)
    made = spark.createDataFrame([("w", bytearray(wide)), ("m", bytearray(many))], "path string, content binary")
    assert all("too large" in x["error"] for x in atlases.found_frames(made).collect())


def test_renderings_of_ones_own(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "job long, names array<string>")
    one = documents.Rendering("names", ".txt", content=lambda: F.array_join("names", " "))
    assert rows(documents.output_files(docs, one, "sheet")) == [(1, "sheet.txt", "a b"), (2, "sheet.txt", "c")]
    each = documents.Rendering("a file for each", ".txt", files=lambda: F.transform("names", lambda n: F.struct(F.concat(n, F.lit(".txt")).alias("name"), n.alias("content"))))
    assert rows(documents.output_files(docs, each)) == [(1, "a.txt", "a"), (1, "b.txt", "b"), (2, "c.txt", "c")]
    for wrong in ({"extension": "txt", "content": F.lit}, {"extension": ".txt"}, {"extension": ".txt", "content": F.lit, "files": F.lit}):
        with pytest.raises(ValueError, match="extension|content"):
            documents.Rendering("no", **wrong)


def test_each_marker_line_is_taken_apart_once(spark):
    """The quoted head's expression stands in the plan a few times, not once for each field made of it."""
    lines = spark.createDataFrame([("f", 0, 'path "a.png"'), ("f", 1, '- marker "m" circle 1,2 3')], "file string, line int, text string").repartition(1)
    plan = texts.parse_markers(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4 and plan.count("regexp_extract") <= 2
    assert rows(texts.parse_markers(lines), "key", "name", "type", "x", "y", "radius") == [("a.png", "m", "circle", 1, 2, 3)]


def test_a_job_of_few_sprites_is_one_chunk(spark):
    """Its candidates share what the best of them came to; a shelf is given up like any other packing."""
    sprites = spark.createDataFrame([(0, i, f"s{i}", 3 + i * 5 % 7, 2 + i * 3 % 8) for i in range(12)], "job long, seq long, path string, w int, h int")
    limits = layouts.Limits(40, 100, 1)
    every = layouts.compact_candidates(layouts.bounds(sprites, limits), limits)
    told = layouts.tried(layouts.jobs(sprites), every, limits, "space").collect()
    assert every.count() > 64 and len(told) == 1 and told[0]["packings"] == every.count()
    boxes = [(4, 4)] * 10
    assert kernels.shelf(boxes, 8, beyond=lambda w, h: h > 12) is None and len(kernels.shelf(boxes, 8, beyond=lambda w, h: h > 20)) == 10
