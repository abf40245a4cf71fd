"""Frames of sheets in tiles: sheets that are too large for one task are searched by their pieces.

A tile also has the first column of the tile to its right and the first row of the one below, so any two
neighbouring pixels stand together in some tile.  Areas (what is opaque, or transparent and of like
colours) are labelled within each tile; areas that have a pixel of a tile's edge in common are one, and
Spark joins them over all tiles.  An area's name is the number of its first pixel in the sheet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import raster
from ..operators.png import read_png, write_png
from ..operators.relations import connected, materialised, written
from .atlases import sheet

TILE = "path string, x int, y int, width int, height int, content binary, error string"
AREA = "path string, area long, other long, kind string, n long, x0 int, y0 int, x1 int, y1 int, opaque boolean"


def tiles(sheets: DataFrame, side: int = 1024) -> DataFrame:
    """The tiles of sheets (path, content), as PNG files with their places and the sheet's size; a sheet that can't be read gives a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pixels = raster.keyed_out(sheet(content))[0]
                except Exception as e:  # whatever a broken file leads to is that file's result
                    yield pd.DataFrame([(path, 0, 0, 0, 0, None, f"{type(e).__name__}: {e}"[:200])], columns=[c.split()[0] for c in TILE.split(", ")])
                    continue
                h, w = pixels.shape[:2]
                out = [(path, x, y, w, h, write_png(pixels[y : y + side + 1, x : x + side + 1], 1), None) for y in range(0, h, side) for x in range(0, w, side)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in TILE.split(", ")])

    return sheets.select("path", "content").mapInPandas(run, TILE)


def tile_areas(pixels: np.ndarray, x: int, y: int, width: int, height: int, tolerance: int) -> list[tuple]:
    """Of a tile: its areas, the pixels of its edges that they hold, and which areas lead to which."""
    h, w = pixels.shape[:2]
    solid, colour = pixels[..., 3] != 0, pixels[..., :3].astype(np.int32)
    linked, across = [], []
    for dy, dx in raster.FOLLOWING:
        (a, b), (p, q) = raster.shifted(solid, dy, dx), raster.shifted(colour, dy, dx)
        like = np.abs(p - q).sum(axis=-1) < tolerance
        linked.append((dy, dx, (a & b) | (~a & ~b & like)))
        across.append((dy, dx, a != b, like))
    label = raster.labelled(linked, h, w)
    areas, place = raster.extents(label, np.ones_like(solid))
    place = place.reshape(h, w)
    number = (np.arange(h)[:, None] + y) * width + np.arange(w)[None, :] + x
    _, first = np.unique(place.reshape(-1), return_index=True)  # pixels are met row by row
    name = number.reshape(-1)[first]
    # A pixel counts in the tile that has it to itself: not in the column and row that are the next one's.
    own = np.ones((h, w), bool)
    own[:, -1] &= x + w == width
    own[-1] &= y + h == height
    n = np.bincount(place[own], minlength=len(areas))
    opaque = solid.reshape(-1)[first]
    out = [(int(name[k]), None, "area", int(n[k]), int(x0) + x, int(y0) + y, int(x1) + x, int(y1) + y, bool(opaque[k])) for k, (_, _, x0, y0, x1, y1) in enumerate(areas.tolist())]
    edge = np.zeros((h, w), bool)
    edge[[0, -1]] = True
    edge[:, [0, -1]] = True
    pairs = np.unique(np.stack((name[place[edge]], number[edge]), axis=1), axis=0)
    out += [(a, b, "edge", *[None] * 6) for a, b in pairs.tolist()]
    leads = set()
    for dy, dx, border, like in across:
        fro, to = raster.shifted(place, dy, dx)
        for a, b, alike in np.unique(np.stack((fro[border], to[border], like[border]), axis=1), axis=0).tolist():
            clear, full = (b, a) if opaque[a] else (a, b)
            leads.add((int(name[clear]), int(name[full])))
            if alike:
                leads.add((int(name[full]), int(name[clear])))
    return out + [(a, b, "lead", *[None] * 6) for a, b in sorted(leads)]


def reached(areas: DataFrame, leads: DataFrame) -> DataFrame:
    """areas (path, area, opaque) with `start`: the first opaque area that leads to each, by any number of steps; areas that none leads to are left out.

    Each round takes the starts of those that lead to an area, and the start of its start; it ends when nothing changes.
    """
    folder, turn = f"{areas.sparkSession.sparkContext.getCheckpointDir()}/reached-{uuid.uuid4().hex}", 0
    starts = written(areas.select("path", "area", F.when(F.col("opaque"), F.col("area")).alias("start")), f"{folder}/0")
    while True:
        told = leads.hint("merge").join(starts.withColumnRenamed("area", "a"), ["path", "a"]).select("path", F.col("b").alias("area"), "start")
        both = starts.select("path", "area", "start", F.lit(True).alias("_own")).unionByName(told.select("path", "area", "start", F.lit(False).alias("_own")))
        near = both.groupBy("path", "area").agg(F.min("start").alias("start"), F.max(F.when(F.col("_own"), F.col("start"))).alias("_was"))
        far = near.hint("merge").join(starts.select("path", F.col("area").alias("start"), F.col("start").alias("_far")), ["path", "start"], "left")
        turn += 1
        moved = written(far.select("path", "area", F.least("start", "_far").alias("start"), "_was"), f"{folder}/{turn}")
        starts = moved.select("path", "area", "start")
        if moved.where(~F.col("start").eqNullSafe(F.col("_was"))).isEmpty():
            return starts.where("start is not null")


def tiled_frames(parts: DataFrame, tolerance: int = 1, least: int = 4, most: int = 10_000) -> DataFrame:
    """file, index, x, y, w and h of the frames of sheets in tiles: those that atlases.found_frames finds in whole sheets."""
    columns = [c.split()[0] for c in AREA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, x, y, w, h, content in zip(*(frame[c] for c in ("path", "x", "y", "width", "height", "content")), strict=True):
                rows = [(path, *row) for row in tile_areas(read_png(bytes(content)), x, y, w, h, tolerance)]
                yield pd.DataFrame(rows, columns=columns).astype({"other": "Int64", "n": "Int64", "opaque": "boolean"} | {c: "Int32" for c in ("x0", "y0", "x1", "y1")})

    # What stands for each area or pixel is shuffled: it grows with the sheets, and a broadcast goes through the driver.
    found = materialised(parts.where("error is null").select("path", "x", "y", "width", "height", "content").mapInPandas(run, AREA))
    whole = connected(found.where("kind = 'edge'").select("path", F.col("area").alias("a"), F.col("other").alias("b")), ("path",))
    named = lambda df, c: df.hint("merge").join(whole.select("path", F.col("node").alias(c), "component"), ["path", c], "left").withColumn(c, F.coalesce("component", c)).drop("component")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    areas = materialised(named(found.where("kind = 'area'"), "area").groupBy("path", "area").agg(F.sum("n").alias("n"), F.max("opaque").alias("opaque"), *box))
    leads = named(named(found.where("kind = 'lead'").select("path", F.col("area").alias("a"), F.col("other").alias("b")), "a"), "b")
    starts = reached(areas, materialised(leads.select("path", "a", "b").distinct()))
    frames = areas.hint("merge").join(starts, ["path", "area"]).groupBy("path", "start").agg(F.sum("n").alias("n"), *box).where(F.col("n") >= least)
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    order = W.partitionBy("path").orderBy(F.desc(w.cast("long") * h), "start")
    rows = frames.withColumn("index", F.row_number().over(order) - 1).where(F.col("index") < most)
    return rows.select(F.col("path").alias("file"), F.col("index").cast("int").alias("index"), F.col("x0").alias("x"), F.col("y0").alias("y"), w.alias("w"), h.alias("h"))
