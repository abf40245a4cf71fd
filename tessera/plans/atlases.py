"""Atlases made of placed sprites, and sprites found in and cut out of sheets.

An atlas is the unit of work: its sprites' files are joined by path and come together in one task,
whose size is that of one atlas.  Sheets are cut one file at a time.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import check_index_pattern
from ..operators import raster
from ..operators.pictures import image_size, read_image
from ..operators.png import write_png


@dataclass(frozen=True)
class Finish:
    """What is done to an atlas once its sprites stand in it, and its format (png, dxt1 or dxt5)."""

    extrude: int = 0
    dilate: bool = False
    lines: int = 0
    line_colour: tuple[int, int, int, int] = (255, 0, 0, 255)
    scale_filter: str = "nearest"
    format: str = "png"
    level: int = 6
    mask: bool = False

    def __post_init__(self) -> None:
        if self.format not in ("png", "dxt1", "dxt5"):
            raise ValueError(f"{self.format}: this build writes png, dxt1 and dxt5 only")


def drawn(sprites: Iterable[dict], width: int, height: int, finish: Finish) -> bytes:
    """The file of one atlas. Order: place, extrude, dilate, outline, encode, mask."""
    atlas = np.zeros((height, width, 4), np.uint8)
    places = []
    for s in sprites:
        pixels = read_image(bytes(s["content"]))
        full_h, full_w = pixels.shape[:2]
        if min(s["trim_left"], s["trim_top"], s["trim_right"], s["trim_bottom"]) < 0 or s["trim_left"] + s["trim_right"] >= full_w or s["trim_top"] + s["trim_bottom"] >= full_h:
            raise ValueError(f"{s['path']}: trims leave nothing of {full_w} by {full_h} pixels")
        if min(s["x"], s["y"]) < 0 or s["x"] + s["w"] > width or s["y"] + s["h"] > height:
            raise ValueError(f"{s['path']}: outside its atlas of {width} by {height} pixels")
        pixels = pixels[s["trim_top"] : full_h - s["trim_bottom"], s["trim_left"] : full_w - s["trim_right"]]
        w, h = (s["h"], s["w"]) if s["rotated"] else (s["w"], s["h"])
        pixels = raster.quantised(raster.resampled(pixels, w, h, finish.scale_filter), s.get("colors") or 0, bool(s.get("dither")))
        atlas[s["y"] : s["y"] + s["h"], s["x"] : s["x"] + s["w"]] = raster.turned(pixels) if s["rotated"] else pixels
        places.append((s["x"], s["y"], s["w"], s["h"]))
    for p in places:
        raster.extruded(atlas, *p, finish.extrude)
    for p in places if finish.dilate else ():
        raster.dilated(atlas, *p)
    for p in places if finish.lines else ():
        raster.outlined(atlas, *p, finish.lines, finish.line_colour)
    if finish.format != "png":
        return raster.write_dds(atlas, finish.format == "dxt5")
    data = write_png(atlas, finish.level)
    return raster.masked(data) if finish.mask else data


def composed(sprites: DataFrame, atlases: DataFrame, files: DataFrame, finish: Finish = Finish(), job: str = "job") -> DataFrame:  # noqa: B008
    """job, atlas_index, content and error of every atlas: sprites (path, place, trims) meet their files (path, content).

    An atlas of which a file can't be read, or a sprite's trims or place don't fit, has an error only.
    """
    keys = [job, "atlas_index"]
    optional = [c for c in ("colors", "dither") if c in sprites.columns]
    rows = sprites.join(files.select("path", "content"), "path").join(atlases.select(*keys, "width", "height"), keys)
    rows = rows.select(*keys, "width", "height", "seq", "x", "y", "w", "h", "trim_left", "trim_top", "trim_right", "trim_bottom", "rotated", *optional, "path", "content")

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("seq").to_dict("records")
        first, content, error = ordered[0], None, None
        try:
            content = drawn(ordered, first["width"], first["height"], finish)
        except Exception as e:  # whatever a broken file leads to is that atlas's result
            error = f"{type(e).__name__}: {e}"[:200]
        return pd.DataFrame({job: [first[job]], "atlas_index": [first["atlas_index"]], "content": [content], "error": [error]})

    return rows.groupBy(*keys).applyInPandas(draw, f"{job} long, atlas_index int, content binary, error string")


def at_index(atlases: DataFrame, index: int) -> DataFrame:
    """Of each job the atlas with this index."""
    return atlases.where(F.col("atlas_index") == index)


def tarred(cut: DataFrame) -> DataFrame:
    """file, content and error: for each sheet a tar of its frames, as cut_frames gives them by name; one bad frame stops its sheet's."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        bad = [e for e in frame["error"] if e is not None]
        named = sorted((n, bytes(c)) for n, c in zip(frame["name"], frame["content"], strict=True) if c is not None)
        return pd.DataFrame({"file": [frame["file"].iloc[0]], "content": [None if bad else bundle(named)], "error": [bad[0] if bad else None]})

    return cut.groupBy("file").applyInPandas(one, "file string, content binary, error string")


def bundle(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A tar file of a few finished files, such as the atlases of one layout."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, data in files:
            entry = tarfile.TarInfo(name)
            entry.size, entry.mode = len(data), 0o644
            archive.addfile(entry, io.BytesIO(data))
    return out.getvalue()


def atlas_name(pattern: str, index: int) -> str:
    check_index_pattern(pattern)
    return "%".join(part.replace("%d", str(index)) for part in pattern.split("%%"))


# Sheets.

LONGEST_SIDE, MOST_PIXELS = 32_768, 100_000_000  #: of a sheet


def sheet(content: bytes) -> np.ndarray:
    """The pixels of a sheet, unmasked; those of one that is too large are not decoded."""
    data = raster.unmasked(bytes(content))
    size = image_size(data)
    if size and (max(size) > LONGEST_SIDE or size[0] * size[1] > MOST_PIXELS):
        raise ValueError(f"a sheet of {size[0]} by {size[1]} pixels is too large")
    return read_image(data)


FRAMES = "file string, index int, x int, y int, w int, h int, background string, error string"


def found_frames(sheets: DataFrame, bordered: bool = False, colour: tuple[int, int, int] = (255, 0, 255), tolerance: int = 1, least: int = 4, most: int = 10_000) -> DataFrame:
    """Frames of sheets (path, content): what hangs together on the background, or stands within drawn borders. A sheet that can't be read gives a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pixels = sheet(content)
                except Exception as e:  # whatever a broken file leads to is that file's result
                    out.append((path, *[None] * 6, f"{type(e).__name__}: {e}"[:200]))
                    continue
                if bordered:
                    boxes, background = raster.bordered(pixels, colour, least=least, most=most), None
                else:
                    pixels, background = raster.keyed_out(pixels)
                    boxes = raster.components(pixels, tolerance, least, most)
                out += [(path, k, *b, background, None) for k, b in enumerate(boxes)]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in FRAMES.split(", ")]).astype({c: "Int32" for c in ("index", "x", "y", "w", "h")})

    return sheets.select("path", "content").mapInPandas(run, FRAMES)


def safe_name(name: str) -> str:
    """The file name of a frame; names that lead out of the folder are refused."""
    name = name if posixpath.splitext(name)[1] else f"{name}.png"
    if posixpath.isabs(name) or ".." in posixpath.normpath(name).split("/"):
        raise ValueError(f"{name!r} leads out of the folder")
    return name


def cut_frames(sheets: DataFrame, frames: DataFrame) -> DataFrame:
    """file, name, content and error of every frame (file, index, name, x, y, w, h, rotated) of sheets (path, content).

    A frame that reaches out of its sheet, or whose name does out of the folder, has an error only.
    """
    listed = frames.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("index", "name", "x", "y", "w", "h", "rotated"))).alias("frames"))
    rows = sheets.select("path", "content").join(listed, F.col("path") == F.col("file")).select("path", "content", "frames")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content, wanted in zip(part["path"], part["content"], part["frames"], strict=True):
                out = []
                try:
                    pixels = sheet(content)
                except Exception as e:  # whatever a broken file leads to is its frames' result
                    wanted, out = [], [(path, f["name"], None, f"{type(e).__name__}: {e}"[:200]) for f in wanted]
                for f in wanted:
                    try:
                        name = safe_name(f["name"])
                        if min(f["x"], f["y"]) < 0 or f["x"] + f["w"] > pixels.shape[1] or f["y"] + f["h"] > pixels.shape[0] or min(f["w"], f["h"]) <= 0:
                            raise ValueError("outside the sheet")
                        piece = pixels[f["y"] : f["y"] + f["h"], f["x"] : f["x"] + f["w"]]  # as it stands there, turned or not
                        out.append((path, name, write_png(raster.unturned(piece) if f["rotated"] else piece), None))
                    except ValueError as e:
                        out.append((path, f["name"], None, str(e)))
                yield pd.DataFrame(out, columns=["file", "name", "content", "error"])

    return rows.mapInPandas(run, "file string, name string, content binary, error string")
