"""Image folders, archives and lists as tables of files, and what is read from the files."""

from __future__ import annotations

import hashlib
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pictures import image_size, read_image
from ..operators.raster import trim_bounds

#: The file types that are looked at.
TYPES = ("png", "jpg", "jpeg", "bmp", "tga", "gif", "psd", "pic", "pnm", "pgm", "ppm", "hdr", "webp")
LARGEST_FILE, LONGEST_SIDE = 1_000_000_000, 100_000


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of the images below a folder; content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return only_images(files)


def only_images(files: DataFrame) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).isin(*TYPES) & (F.col("length") <= LARGEST_FILE))


def listed_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The images of a list, which must all exist."""
    return only_images(spark.read.format("binaryFile").load(paths))


def missing(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Listed paths that no file has: an error for lists, not for folders."""
    return listed.join(found.select(F.regexp_replace("path", "^file:/*", "/").alias("path")), "path", "left_anti")


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an archive (tar, also compressed, or zip) but those that would leave its folder."""

    def safe(member: str) -> bool:
        return not posixpath.isabs(member) and ".." not in posixpath.normpath(member).split("/") and ":" not in member.split("/")[0]

    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for m in archive.infolist():
                if not m.is_dir() and safe(m.filename):
                    yield m.filename, archive.read(m)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
            for m in archive:
                if m.isfile() and safe(m.name):
                    yield m.name, archive.extractfile(m).read()


def archived(archives: DataFrame) -> DataFrame:
    """The image files within archives (path, modificationTime, content), with paths below the archive's.

    An archive that can't be read, or not to its end, gives what comes before and a row of its own with the error and no content.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, at, content in zip(frame["path"], frame["modificationTime"], frame["content"], strict=True):
                try:
                    for name, data in members(path, bytes(content)):
                        yield pd.DataFrame({"path": [f"{path}/{name}"], "modificationTime": [at], "length": [len(data)], "content": [data], "error": [None]})
                except Exception as e:  # whatever a broken archive leads to is that archive's result
                    yield pd.DataFrame({"path": [path], "modificationTime": [at], "length": [0], "content": [None], "error": [f"{type(e).__name__}: {e}"[:200]]})

    found = archives.select("path", "modificationTime", "content").mapInPandas(run, "path string, modificationTime timestamp, length long, content binary, error string")
    return found.where(F.col("error").isNotNull()).unionByName(only_images(found.where("error is null")))


def luma_hash(pixels: np.ndarray) -> int:
    """The 64-bit difference hash over a 9 by 8 grid of nearest pixels, weighted by alpha."""
    h, w = pixels.shape[:2]
    cells = pixels[(np.arange(8) * (h - 1) // 7)[:, None], (np.arange(9) * (w - 1) // 8)[None, :]].astype(np.float64)
    luma = (0.299 * cells[..., 0] + 0.587 * cells[..., 1] + 0.114 * cells[..., 2]) * (cells[..., 3] / 255)
    bits = (luma[:, :-1] < luma[:, 1:]).reshape(-1)
    return int((bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def content_hash(pixels: np.ndarray) -> int:
    """A 64-bit digest of the size and the pixels, as a signed number."""
    digest = hashlib.blake2b(repr(pixels.shape).encode() + pixels.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "big", signed=True)


META = "path string, length long, mtime timestamp, w int, h int, trim_left int, trim_top int, trim_right int, trim_bottom int, content_hash long, perceptual_hash long, error string"


def metadata(files: DataFrame, trim: bool = False, content: bool = False, perceptual: bool = False) -> DataFrame:
    """Sizes, trims and hashes of image files; those that can't be read have an error and nothing else.

    Without trim and hashes only the header of a file is looked at.
    """
    whole = trim or content or perceptual

    def one(data: bytes) -> tuple:
        if not whole:
            size = image_size(data)
            if size is None:
                return (*[None] * 8, "unknown format")
            return (*size, 0, 0, 0, 0, None, None, None) if max(size) <= LONGEST_SIDE else (*[None] * 8, "too large")
        try:
            pixels = read_image(data)
        except Exception as e:  # whatever a broken file leads to is that file's result
            return (*[None] * 8, f"{type(e).__name__}: {e}"[:200])
        h, w = pixels.shape[:2]
        x, y, tw, th = trim_bounds(pixels) if trim else (0, 0, w, h)
        kept = pixels[y : y + th, x : x + tw]
        return tw, th, x, y, w - x - tw, h - y - th, content_hash(kept) if content else None, luma_hash(kept) if perceptual else None, None

    names = [f.split()[0] for f in META.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n, t, *one(bytes(d))) for p, n, t, d in zip(frame["path"], frame["length"], frame["modificationTime"], frame["content"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in names[3:9]} | {c: "Int64" for c in ("content_hash", "perceptual_hash")})

    return files.select("path", "length", "modificationTime", "content").mapInPandas(run, META)
