"""From folders to layouts, atlases, documents and frames: the commands as functions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import normal_path, scaled
from .operators import relations as r
from .options import LayoutOptions
from .plans import atlases, documents, layouts
from .plans.atlases import Finish
from .sources import images, texts

#: Beyond the limits that are asked for: the largest side of an atlas.
LARGEST = 1 << 15


def read_sprites(files: DataFrame, o: LayoutOptions, cache: DataFrame | None = None, job: str = "job") -> tuple[DataFrame, DataFrame]:
    """Image files (job, path, modificationTime, length, content) as sprites, probed or decoded and in source order, and the files left out (job, path, error).

    With a cache, files that it knows unchanged are not opened.
    """
    content, perceptual = o.deduplicate == "exact", o.deduplicate == "perceptual"
    ordered = r.natural_order(files, job) if o.sort == "name" else files.withColumn("seq", F.row_number().over(_by_path(job)) - 1)
    places = ordered.select(job, "path", "seq")
    if cache is None:
        meta = images.metadata(files, o.trim_transparent, content, perceptual)
    else:
        known = r.cache_hits(files.select("path", F.lit(o.trim_transparent).alias("trim"), "length", F.col("modificationTime").alias("mtime")), cache, content, perceptual)
        columns = [c.split()[0] for c in images.META.split(", ") if c.split()[0] != "error"]
        fresh = images.metadata(files.join(known.where("not hit").select("path"), "path", "left_semi"), o.trim_transparent, content, perceptual)
        meta = known.where("hit").select(*columns, F.lit(None).cast("string").alias("error")).unionByName(fresh.select(*columns, "error"))
    rows = r.materialised(meta).join(places, "path")
    return rows.where("error is null"), rows.where("error is not null").select(job, "path", "error")


def source_sprites(files: DataFrame, o: LayoutOptions, cache: DataFrame | None = None, job: str = "job") -> DataFrame:
    """The sprites of read_sprites alone."""
    return read_sprites(files, o, cache, job)[0]


def _by_path(job: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(job).orderBy("path")


def deduplicated(sprites: DataFrame, o: LayoutOptions) -> tuple[DataFrame, DataFrame]:
    """(the sprites that stay, alias_path and canonical_path of the others)."""
    if o.deduplicate == "exact":
        rows = r.exact_duplicates(sprites)
    elif o.deduplicate == "perceptual":
        found = r.perceptual_duplicates(sprites, o.dedup_threshold)
        first = sprites.select("job", F.col("seq").alias("canonical_seq"), F.col("path").alias("canonical_path"))
        rows = found.join(first, ["job", "canonical_seq"]).drop("canonical_seq")
    else:
        rows = sprites.withColumn("canonical_path", F.col("path"))
    same = F.col("path") == F.col("canonical_path")
    return rows.where(same).drop("canonical_path"), rows.where(~same).select("job", F.col("path").alias("alias_path"), "canonical_path", "seq")


def searched(kept: DataFrame, o: LayoutOptions, limits: layouts.Limits, previous: DataFrame | None, hints: DataFrame | None) -> DataFrame:
    if previous is not None and o.incremental:
        found = r.materialised(layouts.incremental(kept, previous, limits))
        rest = kept.join(found.select("job").distinct(), "job", "left_anti")
        return found.unionByName(searched(rest, o, limits, None, hints).select(*found.columns))
    if o.mode == "grid":
        return layouts.grid(kept, limits, o.multipack)
    if o.multipack:
        return layouts.multipack(kept, limits, o.optimize, o.mode == "pot")
    if o.mode == "compact":
        return layouts.compact(kept, limits, o.optimize, hints)
    return layouts.power_of_two(kept, limits, o.optimize) if o.mode == "pot" else layouts.fast(kept, limits)


def layout(sprites: DataFrame, o: LayoutOptions, previous: DataFrame | None = None, seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """atlas, sprite, alias, header and error of every job of sprites (job, seq, path, w, h and trims).

    seeds is the `sprite` table of an earlier run with the same options: jobs that it fits exactly are
    taken over, and in the others its widths are tried too.  error has the jobs without a layout.
    """
    kept, alias = deduplicated(sprites, o)
    kept = kept.withColumns({c: scaled(F.col(c), o.whole_scale) for c in "wh"})
    order, stable = o.order
    limits = layouts.Limits(o.max_width or LARGEST, o.max_height or LARGEST, o.padding, o.extrude, o.rotate, order, stable)
    if seeds is None:
        placed = searched(kept, o, limits, previous, None)
    else:
        same = r.reusable_seeds(kept, seeds, limits.gap)
        hints = r.tight_bounds(seeds, padding=limits.gap).groupBy("job").agg(F.max("width").alias("hint"))
        places = seeds.select("job", "path", "atlas_index", "x", "y", "w", "h", "rotated").join(same, "job", "left_semi")
        reused = kept.select("job", F.col("seq").cast("long").alias("seq"), "path").join(places, ["job", "path"]).drop("path")
        placed = searched(kept.join(same, "job", "left_anti"), o, limits, previous, hints)
        placed = placed.unionByName(reused.select(*placed.columns))
    placed = r.materialised(placed)  # all tables below are made of it
    own = kept.select("job", "seq", "path", *(c if c in kept.columns else F.lit(0).alias(c) for c in r.TRIMS))
    sprite = placed.join(own, ["job", "seq"])
    size = r.tight_bounds(sprite)
    if o.mode == "pot":
        from .functions.scalars import next_power_of_two

        size = size.withColumns({c: next_power_of_two(F.col(c)).cast("int") for c in ("width", "height")})
    header = size.select("job").distinct().select("job", F.lit(o.whole_scale).alias("scale"), F.lit(o.extrude).alias("extrude"), F.lit(o.multipack).alias("multipack"))
    return {"atlas": size, "sprite": sprite, "alias": alias, "header": header, "error": unplaced(kept, placed, limits, o.mode == "grid")}


def unplaced(kept: DataFrame, placed: DataFrame, limits: layouts.Limits, grid: bool = False) -> DataFrame:
    """job and message of the jobs without a layout: the first sprite that no atlas can hold, or that has another size in a grid, if there is one."""
    left = kept.join(placed.select("job").distinct(), "job", "left_anti")
    large = r.over_limits(left, limits.max_width, limits.max_height, limits.gap, limits.rotate).groupBy("job").agg(F.min_by("path", "seq").alias("_path"))
    reasons = [F.concat(F.col("_path"), F.lit(" exceeds the atlas limits")), F.lit("no layout within the limits")]
    rows = left.select("job").distinct().join(large, "job", "left")
    if grid:
        rows = rows.join(r.odd_sizes(left).select("job", F.struct("path", "w", "h").alias("_odd")), "job", "left")
        reasons.insert(1, F.concat(F.col("_odd.path"), F.lit(" is "), F.col("_odd.w").cast("string"), F.lit("x"), F.col("_odd.h").cast("string"), F.lit(", not the size of the first sprite of the grid")))
    return rows.select("job", F.coalesce(*reasons).alias("message"))


def pack(found: dict[str, DataFrame], files: DataFrame, finish: Finish = Finish()) -> DataFrame:  # noqa: B008
    return atlases.composed(found["sprite"], found["atlas"], files, finish)


def convert(layout_lines: DataFrame, kind: str = "json", markers: DataFrame | None = None, animations: DataFrame | None = None, auto: bool = False, pattern: str = "atlas_%d.png") -> DataFrame:
    """job and content: each layout file's document in one of the formats.

    Markers and animations are read from their own lines, or else from the layout's.
    """
    job = lambda df: df.withColumnRenamed("file", "job")
    p = texts.parse_layouts(layout_lines)
    sprites = documents.named(job(p["sprite"]))
    marks = documents.with_sprites(job(texts.parse_markers(markers if markers is not None else layout_lines)), sprites)
    moving, frames = texts.parse_animations(animations if animations is not None else layout_lines)
    moving, frames = job(moving), documents.resolved_frames(job(frames), sprites)
    if auto:
        last = moving.groupBy("job").agg((F.max("index") + 1).alias("_n"))
        more = r.auto_animations(sprites).join(last, "job", "left").withColumn("index", (F.row_number().over(_by_name()) - 1 + F.coalesce("_n", F.lit(0))).cast("int"))
        moving = moving.unionByName(more.select("job", "index", "name", F.lit(documents.FPS).alias("fps"), F.lit(None).cast("string").alias("alias_source"), F.lit(None).cast("string").alias("flip")))
        frames = frames.unionByName(more.select("job", "index", F.posexplode("frames").alias("pos", "sprite_index")))
    docs = documents.documents(job(p["header"]), job(p["atlas"]), sprites, marks, moving, frames, pattern)
    return documents.unity_anims(docs) if kind == "unity.anim" else documents.rendered(docs, kind)


def _by_name():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("job").orderBy("name")


def read_folder(spark: SparkSession, folder: str, o: LayoutOptions, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The sprites of a folder and the files left out; each folder right below it is a job, numbered by name, and what lies in none is one too."""
    files = images.images(spark, folder)
    below = F.regexp_extract("path", rf"{folder.rstrip('/')}/([^/]+)/", 1)
    named = files.withColumn("_dir", below)
    numbers = named.select("_dir").distinct().withColumn("job", F.xxhash64("_dir"))
    return read_sprites(named.join(numbers, "_dir").drop("_dir"), o, cache)


def folder_sprites(spark: SparkSession, folder: str, o: LayoutOptions, cache: DataFrame | None = None) -> DataFrame:
    """The sprites of read_folder alone."""
    return read_folder(spark, folder, o, cache)[0]


def sheet_frames(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """Frames of sheets (path): from the file beside each that has its name and ends in .json or .frames, which are looked for in that order, or else from a frame list whose path line names it.

    files has path and value, the whole text.  What is JSON by its name or its look is read as that.
    """
    stem = lambda c: F.regexp_replace(c, r"[.][^./]*\z", "")
    kind = F.regexp_extract("path", r"[.]([^./]*)\z", 1)
    ranked = lambda rank: F.struct(rank.alias("rank"), "path", "value").alias("_f")
    beside = files.where(kind.isin("json", "frames")).select(stem(F.col("path")).alias("_stem"), ranked((kind != "json").cast("int")))
    by_name = sheets.select(F.col("path").alias("file")).withColumn("_stem", stem(F.col("file"))).join(beside, "_stem").select("file", "_f")
    named = texts.named_sheets(texts.split_lines(files.withColumnRenamed("path", "file"))).withColumnRenamed("file", "path")
    by_line = named.join(files, "path").select("sheet", ranked(F.lit(2)))
    by_line = sheets.select(F.col("path").alias("file"), normal_path(F.col("path")).alias("sheet")).join(by_line, "sheet").select("file", "_f")
    found = by_name.unionByName(by_line).groupBy("file").agg(F.min("_f").alias("_f"))
    found = found.select("file", "_f.value", texts.frames_format(F.col("_f.path"), F.col("_f.value")).alias("format"))
    lined = found.where("format = 'text'").select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return texts.parse_frames_json(found.where("format = 'json'").select("file", "value")).unionByName(texts.parse_frames(lined))


frames = atlases.found_frames
unpack = atlases.cut_frames
