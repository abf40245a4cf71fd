"""Frames of sheets in tiles against the search of whole sheets."""

import random

import numpy as np
import pytest
from support import rows

from tessera.operators import png
from tessera.plans import atlases, tiled


def blotches(seed, h, w):
    """Opaque and transparent areas of few colours, so that some are alike."""
    rng = np.random.default_rng(seed)
    pixels = np.zeros((h, w, 4), np.uint8)
    pixels[..., :3] = rng.integers(0, 2 + seed % 3, (h, w, 1)) * 40
    pixels[..., 3] = (rng.random((h, w)) < (0.15, 0.3, 0.45)[seed % 3]) * 255
    r = random.Random(seed)
    for _ in range(3):
        y, x = r.randrange(h), r.randrange(w)
        pixels[y : y + r.randint(1, 9), x : x + r.randint(1, 9)] = (r.randrange(3) * 40, 0, 0, r.choice([0, 255]))
    pixels[0, 0, 3] = (seed % 4 == 0) * 255
    return pixels


@pytest.mark.parametrize("side", [3, 7, 100])
def test_tiles_find_what_whole_sheets_do(spark, side):
    sheets = {f"s{k}": blotches(k, 5 + k * 3, 23 - k) for k in range(8)} | {"one": blotches(9, 1, 1), "wide": blotches(10, 1, 30)}
    made = spark.createDataFrame([(n, bytearray(png.write_png(p))) for n, p in sheets.items()] + [("bad", bytearray(b"no"))], "path string, content binary")
    for tolerance, least in ((1, 2), (41, 4)):
        want = rows(atlases.found_frames(made, tolerance=tolerance, least=least).where("error is null").drop("error", "background"))
        parts = tiled.tiles(made, side)
        got = tiled.tiled_frames(parts, tolerance, least)
        assert rows(got.select("file", "index", "x", "y", "w", "h")) == want
    assert [r["path"] for r in parts.where("error is not null").collect()] == ["bad"]


def test_labels_do_not_go_through_the_driver(spark, monkeypatch):
    """However small the files of a round are, nothing in it is broadcast."""
    from tessera.operators import relations

    plans, written = [], relations.written
    note = lambda df, folder: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, folder))[1]
    monkeypatch.setattr(relations, "written", note)
    monkeypatch.setattr(tiled, "written", note)
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(9)], "job int, a long, b long")
    assert {r["component"] for r in relations.connected(edges).collect()} == {0}
    areas = spark.createDataFrame([("s", 0, True), ("s", 1, False), ("s", 2, True)], "path string, area long, opaque boolean")
    leads = spark.createDataFrame([("s", 0, 1), ("s", 1, 2)], "path string, a long, b long")
    assert sorted((r["area"], r["start"]) for r in tiled.reached(areas, leads).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
