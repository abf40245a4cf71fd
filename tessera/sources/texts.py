"""Line formats: layouts, markers, animations, image lists and frame lists.

A file is one row of `read_lines` per line, with its place, so that all files of a folder are parsed
in one job.  What a line inherits from earlier ones (the atlas of a sprite, the path of a marker, the
animation of a frame, a list's root) is a window over the file's lines.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import QUOTED, beside, parse_double, parse_int, parse_pair, unquoted

FILE = "file"
SLICE_MODES = ("stretch", "repeat", "mirror")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0) and text of every line of the files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias(FILE), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return split_lines(whole)


def split_lines(texts: DataFrame, value: str = "value") -> DataFrame:
    return texts.select(FILE, F.posexplode(F.split(value, r"\r?\n", -1)).alias("line", "text"))


def carried(value: Column) -> Column:
    """The last value so far in the file."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(FILE).orderBy("line"))


def before(value: Column) -> Column:
    return F.coalesce(F.sum(value).over(W.partitionBy(FILE).orderBy("line").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))


def first_quoted(text: Column) -> Column:
    """The first quoted token, or null."""
    return F.when(text.rlike(QUOTED), unquoted(F.regexp_extract(text, QUOTED, 1)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


# Layouts.

KINDS = ("root", "scale", "extrude", "multipack", "atlas", "sprite", "alias")


def layout_rows(lines: DataFrame) -> DataFrame:
    """Lines with kind, atlas_index, the values of their kind, and error where they break a rule."""
    text = F.trim("text")
    kind = F.coalesce(*(F.when(text.startswith(k), k) for k in KINDS))
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("kind", kind)
    rows = rows.withColumn("atlas_index", (before((F.col("kind") == "atlas").cast("int")) - 1).cast("int"))

    head = tokens(F.regexp_replace(text, "^[a-z]+", " "))
    path = first_quoted(text)
    after = F.regexp_replace(text, rf"^sprite\s*{QUOTED}", "")
    words = tokens(after)
    is_flag = lambda t: t.isin("rotated", "dither") | t.startswith("colors=") | t.startswith("slice=")
    flags, plain = F.filter(words, is_flag), F.filter(words, lambda t: ~is_flag(t))
    paired = F.get(plain, F.lit(0)).contains(",")
    pair = lambda k: parse_pair(F.get(plain, F.lit(k)))
    number = lambda k: parse_int(F.get(plain, F.lit(k)))
    either = lambda p, side, k: F.when(paired, pair(p)[side]).otherwise(number(k))
    option = lambda name: F.get(F.transform(F.filter(flags, lambda t: t.startswith(name)), lambda t: F.substring(t, len(name) + 1, 1 << 20)), F.lit(0))
    parts = F.split(option("slice="), ",", -1)
    side = lambda k: parse_int(F.get(parts, F.lit(k)), signed=False)
    mode = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit("stretch"))
    sliced = F.when(
        option("slice=").isNotNull() & F.size(parts).isin(4, 5, 6) & side(0).isNotNull() & side(1).isNotNull() & side(2).isNotNull() & side(3).isNotNull() & mode(4).isin(*SLICE_MODES) & mode(5).isin(*SLICE_MODES) & (F.size(parts) != 5),
        F.struct(side(0).alias("left"), side(1).alias("top"), side(2).alias("right"), side(3).alias("bottom"), mode(4).alias("h"), mode(5).alias("v")),
    )
    sizes = F.when(F.size(head) == 1, parse_pair(head[0])).when(F.size(head) == 2, F.struct(parse_int(head[0]).alias("a"), parse_int(head[1]).alias("b")))
    is_sprite, is_atlas = F.col("kind") == "sprite", F.col("kind") == "atlas"
    rows = rows.withColumns(
        {
            "path": F.when(F.col("kind").isin("root", "sprite", "alias"), path),
            "canonical_path": F.when(F.col("kind") == "alias", first_quoted(F.regexp_replace(text, rf"^alias\s*{QUOTED}", ""))),
            "number": F.when(F.col("kind").isin("scale", "extrude"), parse_double(F.get(head, F.lit(0)))),
            "flag": F.when(F.col("kind") == "multipack", F.get(head, F.lit(0)).isin("true", "1")),
            "width": F.when(is_atlas, sizes["a"]),
            "height": F.when(is_atlas, sizes["b"]),
            "x": F.when(is_sprite, either(0, "a", 0)),
            "y": F.when(is_sprite, either(0, "b", 1)),
            "w": F.when(is_sprite, either(1, "a", 2)),
            "h": F.when(is_sprite, either(1, "b", 3)),
            "trim_left": F.when(is_sprite, F.coalesce(F.when(paired, pair(2)["a"]).otherwise(number(4)), F.lit(0))),
            "trim_top": F.when(is_sprite, F.coalesce(F.when(paired, pair(2)["b"]).otherwise(number(5)), F.lit(0))),
            "trim_right": F.when(is_sprite, F.coalesce(F.when(paired, pair(3)["a"]), F.lit(0))),
            "trim_bottom": F.when(is_sprite, F.coalesce(F.when(paired, pair(3)["b"]), F.lit(0))),
            "rotated": F.when(is_sprite, F.array_contains(flags, "rotated")),
            "dither": F.when(is_sprite, F.array_contains(flags, "dither")),
            "colors": F.when(is_sprite, F.coalesce(F.when(option("colors=").isNotNull(), F.coalesce(parse_int(option("colors="), signed=False), F.lit(-1))), F.lit(0))),
            "slice": F.when(is_sprite, sliced),
            "_bad_slice": is_sprite & option("slice=").isNotNull() & sliced.isNull(),
            "_words": F.size(plain),
            "_paired": paired,
            "_head": head,
        }
    )
    of_atlas = W.partitionBy(FILE, "atlas_index")
    rows = rows.withColumn("_w", F.max("width").over(of_atlas)).withColumn("_h", F.max("height").over(of_atlas))
    nth = F.count("*").over(W.partitionBy(FILE, "kind").orderBy("line"))
    c = F.col
    broken = F.coalesce(
        F.when(c("kind").isNull(), "unknown line"),
        F.when(c("kind").isin(*KINDS[:4]) & (nth > 1), F.concat(F.lit("repeated "), "kind")),
        F.when((c("kind") == "scale") & ~F.coalesce(c("number") > 0, F.lit(False)), "bad scale"),
        F.when((c("kind") == "extrude") & ~F.coalesce((c("number") >= 0) & (c("number") == F.floor("number")) & (F.size("_head") == 1), F.lit(False)), "bad extrude"),
        F.when((c("kind") == "multipack") & ~F.coalesce(F.get("_head", F.lit(0)).isin("true", "1", "false", "0"), F.lit(False)), "bad multipack"),
        F.when((c("kind") == "atlas") & ~F.coalesce((c("width") > 0) & (c("height") > 0), F.lit(False)), "bad atlas size"),
        F.when(c("kind").isin("root", "sprite", "alias") & c("path").isNull(), "no quoted path"),
        F.when((c("kind") == "alias") & c("canonical_path").isNull(), "alias without its original"),
        F.when(is_sprite & (c("atlas_index") < 0), "sprite before any atlas"),
        F.when(is_sprite & ~F.when(c("_paired"), c("_words").isin(2, 4)).otherwise(c("_words").isin(4, 6)), "bad number of fields"),
        F.when(is_sprite & (c("x").isNull() | c("y").isNull() | c("w").isNull() | c("h").isNull()), "bad rectangle"),
        F.when(is_sprite & (F.least("x", "y", "w", "h", "trim_left", "trim_top", "trim_right", "trim_bottom") < 0), "negative value"),
        F.when(is_sprite & ((c("x") + c("w") > c("_w")) | (c("y") + c("h") > c("_h"))), "sprite outside its atlas"),
        F.when(is_sprite & ~((c("colors") == 0) | c("colors").between(2, 256)), "bad colors"),
        F.when(c("_bad_slice"), "bad slice"),
    )
    return rows.withColumn("error", broken)


def parse_layouts(lines: DataFrame) -> Mapping[str, DataFrame]:
    """header, atlas, sprite, alias and errors (also of files without an atlas) of all files."""
    rows = layout_rows(lines)
    good = rows.where("error is null")
    one = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    header = good.groupBy(FILE).agg(one("root", "path").alias("root"), one("scale", "number").alias("scale"), one("extrude", "number").cast("int").alias("extrude"), one("multipack", "flag").alias("multipack"))
    sprite = good.where("kind = 'sprite'")
    numbered = sprite.withColumn("index", (F.row_number().over(W.partitionBy(FILE).orderBy("line")) - 1).cast("int"))
    trims = ("trim_left", "trim_top", "trim_right", "trim_bottom")
    sprites = numbered.select(FILE, "index", "path", "atlas_index", "x", "y", "w", "h", *trims, (F.greatest(*trims) > 0).alias("has_trim"), "rotated", "dither", "colors", "slice")
    alias = good.where("kind = 'alias'").select(FILE, (F.row_number().over(W.partitionBy(FILE).orderBy("line")) - 1).alias("seq"), F.col("path").alias("alias_path"), "canonical_path")
    missing = lines.groupBy(FILE).agg(F.max(F.trim("text").startswith("atlas").cast("int")).alias("_has")).where("_has = 0").select(FILE, F.lit(None).cast("int").alias("line"), F.lit("no atlas").alias("error"))
    errors = rows.where("error is not null").select(FILE, "line", "error").unionByName(missing)
    return {"header": header, "atlas": good.where("kind = 'atlas'").select(FILE, "atlas_index", "width", "height"), "sprite": sprites, "alias": alias, "errors": errors}


def repeated_paths(sprites: DataFrame) -> DataFrame:
    """Paths that occur more than once in a layout: worth a warning."""
    return sprites.groupBy(FILE, "path").agg(F.count("*").alias("times")).where("times > 1")


def layout_lines(header: DataFrame, atlas: DataFrame, sprite: DataFrame, alias: DataFrame) -> DataFrame:
    """file, ord and text: layouts in their text form, to be written in the order of ord."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    pair = lambda a, b: F.concat_ws(",", a, b)
    line = lambda df, major, minor, step, text: df.select(FILE, F.struct(F.lit(major).alias("part"), F.coalesce(minor.cast("int"), F.lit(0)).alias("atlas"), F.coalesce(step.cast("int"), F.lit(0)).alias("seq")).alias("ord"), text.alias("text")).where("text is not null")
    zero = F.lit(0)
    trimmed = F.when(F.col("has_trim"), F.concat(F.lit(" "), pair("trim_left", "trim_top"), F.lit(" "), pair("trim_right", "trim_bottom"))).otherwise("")
    extra = F.concat(
        F.when(F.col("rotated"), " rotated").otherwise(""),
        F.when(F.col("dither"), " dither").otherwise(""),
        F.when(F.col("colors") > 0, F.concat(F.lit(" colors="), "colors")).otherwise(""),
        F.when(F.col("slice").isNotNull(), F.concat(F.lit(" slice="), F.concat_ws(",", "slice.left", "slice.top", "slice.right", "slice.bottom", "slice.h", "slice.v"))).otherwise(""),
    )
    parts = [
        line(header, 0, zero, zero, F.concat(F.lit("root "), quoted(F.col("root")))),
        line(header, 1, zero, zero, F.concat(F.lit("scale "), short_number(F.coalesce("scale", F.lit(1.0))))),
        line(header, 2, zero, zero, F.when(F.col("extrude") > 0, F.concat(F.lit("extrude "), "extrude"))),
        line(header, 3, zero, zero, F.when(F.col("multipack"), "multipack true")),
        line(atlas, 4, F.col("atlas_index"), F.lit(-1), F.concat(F.lit("atlas "), pair("width", "height"))),
        line(sprite, 4, F.col("atlas_index"), F.col("index"), F.concat(F.lit("sprite "), quoted(F.col("path")), F.lit(" "), pair("x", "y"), F.lit(" "), pair("w", "h"), trimmed, extra)),
        line(alias, 5, zero, F.col("seq"), F.concat(F.lit("alias "), quoted(F.col("alias_path")), F.lit(" "), quoted(F.col("canonical_path")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def short_number(v: Column) -> Column:
    """At most eight decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.8f", v), r"0+\z", ""), r"\.\z", "")


# Markers and animations.


def parse_markers(lines: DataFrame) -> DataFrame:
    """file, index, key (the path they belong to; null: none), name, type and geometry; lines that can't be read are left out."""
    # Each step is a column of its own, below the window: expressions built into one another, and those that a
    # filter is pushed through, are evaluated anew wherever they stand.
    c, head = F.col, rf"^-\s*marker\s*{QUOTED}"
    rows = lines.select(FILE, "line", F.trim("text").alias("_text"))
    rows = rows.withColumns({"_quoted": first_quoted(c("_text")), "_rest": F.when(c("_text").rlike(head), tokens(F.regexp_replace("_text", head, "")))})
    rows = rows.withColumns({"type": F.get("_rest", F.lit(0)), "_first": F.get("_rest", F.lit(1)), "_second": F.get("_rest", F.lit(2)), "_path": F.when(c("_text").startswith("path"), c("_quoted"))})
    kind = c("type")
    rows = rows.withColumns({
        "_at": F.when(kind.isin("point", "circle", "rectangle"), parse_pair(c("_first"))),
        "_size": F.when(kind == "rectangle", parse_pair(c("_second"))),
        "_radius": F.when(kind == "circle", parse_int(c("_second"), signed=False)),
        "_corners": F.when(kind == "polygon", F.transform(F.slice("_rest", 2, 1 << 20), parse_pair)),
    })
    rows = rows.select(FILE, "line", "_quoted", "type", "_at", "_size", "_radius", "_corners", carried(c("_path")).alias("key"))
    at, size, radius, corners = c("_at"), c("_size"), c("_radius"), c("_corners")
    valid = F.when(c("type") == "point", at.isNotNull()).when(c("type") == "circle", at.isNotNull() & radius.isNotNull()).when(c("type") == "rectangle", at.isNotNull() & size.isNotNull()).when(c("type") == "polygon", (F.size(corners) >= 3) & F.forall(corners, lambda v: v.isNotNull()))
    return rows.where(F.coalesce(valid, F.lit(False))).select(
        FILE,
        (F.row_number().over(W.partitionBy(FILE).orderBy("line")) - 1).cast("int").alias("index"),
        "key",
        c("_quoted").alias("name"),
        "type",
        at["a"].alias("x"),
        at["b"].alias("y"),
        radius.alias("radius"),
        size["a"].alias("w"),
        size["b"].alias("h"),
        F.transform(corners, lambda v: F.struct(v["a"].alias("x"), v["b"].alias("y"))).alias("vertices"),
    )


def parse_animations(lines: DataFrame, fps: int = 8) -> tuple[DataFrame, DataFrame]:
    """(animations: file, index, name, fps, alias_source, flip; their frames: file, index, pos, key, number)."""
    text = F.trim("text")
    head = rf"^animation\s*{QUOTED}"
    starts = text.rlike(head)
    rows = lines.withColumn("index", (before(starts.cast("int")) - 1).cast("int")).withColumn("fps", F.coalesce(carried(F.when(text.rlike("^fps[ \t]"), parse_int(F.get(tokens(text), F.lit(1))))), F.lit(fps)))
    rest = F.regexp_replace(text, head, "")
    flip = F.regexp_extract(rest, r"\bflip\s+(\S+)", 1)
    animations = rows.where(starts).select(FILE, "index", first_quoted(text).alias("name"), "fps", F.when(rest.rlike(rf"^\s*alias\s*{QUOTED}"), first_quoted(rest)).alias("alias_source"), F.when(flip != "", flip).alias("flip"))
    body = F.regexp_replace(text, r"^-\s*frame\s*", "")
    frames = rows.where(text.rlike(r"^-\s*frame\b") & (F.col("index") >= 0)).select(FILE, "index", (F.row_number().over(W.partitionBy(FILE, "index").orderBy("line")) - 1).cast("int").alias("pos"), first_quoted(body).alias("key"), parse_int(body, signed=False).alias("number"))
    return animations, frames.where("key is not null or number is not null")


# Lists of images, and frames.


def parse_lists(lines: DataFrame) -> DataFrame:
    """file, line and path of the images that lists name; a root holds for later lines, an exclusion too."""
    text = F.trim("text")
    rows = lines.where((text != "") & ~text.startswith("#"))
    root = carried(F.when(text.rlike(r'^root\s*"'), first_quoted(text)))
    rows = rows.select(FILE, "line", text.alias("text"), root.alias("root"))
    under = lambda p: F.when(p.startswith("/") | F.col("root").isNull(), p).otherwise(F.concat_ws("/", F.regexp_replace("root", "/+$", ""), p))
    out = rows.where(F.col("text").rlike(r'^exclude\s*"')).select(F.col(FILE).alias("_f"), F.col("line").alias("_l"), under(first_quoted(F.col("text"))).alias("_p"))
    entries = rows.where(~F.col("text").rlike(r'^(?:exclude|root)\s*"')).select(FILE, "line", under(F.coalesce(first_quoted(F.col("text")), F.col("text"))).alias("path"))
    return entries.join(out, (F.col(FILE) == F.col("_f")) & (F.col("path") == F.col("_p")) & (F.col("_l") < F.col("line")), "left_anti")


def excluded(images: DataFrame, ignore: DataFrame, root: str) -> DataFrame:
    """images (path) without those that ignore lines (text) name, as whole paths or below root."""
    text = F.trim("text")
    named = ignore.where((text != "") & ~text.startswith("#")).select(F.coalesce(F.when(text.rlike(r'^exclude\s*"'), first_quoted(text)), text).alias("_p"))
    keys = named.select(F.when(F.col("_p").startswith("/"), F.col("_p")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "_p")).alias("_p")).distinct()
    return images.join(keys, F.regexp_replace("path", "^file:/*", "/") == F.col("_p"), "left_anti")


def parse_frames(lines: DataFrame) -> DataFrame:
    """file, index, name, x, y, w, h, rotated of frame lists; frames without a name get one from their index."""
    text = F.trim("text")
    rest = tokens(F.regexp_replace(text, rf"^sprite\s*(?:{QUOTED})?", ""))
    at, size = parse_pair(F.get(rest, F.lit(0))), parse_pair(F.get(rest, F.lit(1)))
    rows = lines.where(text.startswith("sprite") & at.isNotNull() & size.isNotNull())
    index = (F.row_number().over(W.partitionBy(FILE).orderBy("line")) - 1).cast("int")
    found = rows.select(FILE, index.alias("index"), first_quoted(text).alias("name"), at["a"].alias("x"), at["b"].alias("y"), size["a"].alias("w"), size["b"].alias("h"), F.array_contains(rest, "rotated").alias("rotated"))
    return found.withColumn("name", F.coalesce("name", F.concat(F.lit("sprite_"), "index")))


def named_sheets(lines: DataFrame) -> DataFrame:
    """file and sheet: the image that a frame list names in its first path line, as a normal path."""
    text = F.trim("text")
    named = lines.where(text.rlike(rf"^path\s*{QUOTED}")).groupBy(FILE).agg(F.min_by(first_quoted(text), "line").alias("_p"))
    return named.select(FILE, beside(F.col(FILE), F.col("_p")).alias("sheet"))


def frames_format(path: Column, value: Column) -> Column:
    """json or text: by the file's name, or else by how its content begins or what it holds."""
    looks = F.ltrim(value).startswith("[") | value.contains('"frames":')
    return F.when(F.lower(path).endswith(".json") | looks, "json").otherwise("text")


FRAME = "struct<filename:string,frame:struct<x:int,y:int,w:int,h:int>,rotated:boolean,trimmed:boolean,spriteSourceSize:struct<x:int,y:int,w:int,h:int>,sourceSize:struct<w:int,h:int>>"


def parse_frames_json(texts: DataFrame, value: str = "value") -> DataFrame:
    """Frames of JSON sheets, whether "frames" is an object by name or a list (or the list is all)."""
    as_map = F.from_json(value, f"struct<frames:map<string,{FRAME}>>")["frames"]
    as_list = F.coalesce(F.from_json(value, f"struct<frames:array<{FRAME}>>")["frames"], F.when(F.trim(value).startswith("["), F.from_json(value, f"array<{FRAME}>")))
    entries = F.coalesce(F.transform(as_list, lambda f: F.struct(f["filename"].alias("name"), f.alias("f"))), F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("f"))))
    rows = texts.select(FILE, F.posexplode(entries).alias("index", "e"))
    f = "e.f."
    return rows.select(FILE, "index", "e.name", F.col(f + "frame.x").alias("x"), F.col(f + "frame.y").alias("y"), F.col(f + "frame.w").alias("w"), F.col(f + "frame.h").alias("h"), F.coalesce(f + "rotated", F.lit(False)).alias("rotated")).where("w > 0 and h > 0")


def frame_lines(frames: DataFrame, background: Column | None = None) -> DataFrame:
    """file, ord and text: frames in their text form."""
    heads = frames.groupBy(FILE).agg(F.lit(-2).alias("ord")).select(FILE, "ord", F.concat(F.lit('path "'), FILE, F.lit('"')).alias("text"))
    if background is not None:
        heads = heads.unionByName(frames.groupBy(FILE).agg(F.max(background).alias("_b")).where("_b is not null").select(FILE, F.lit(-1).alias("ord"), F.concat(F.lit("background "), "_b").alias("text")))
    return heads.unionByName(frames.select(FILE, F.col("index").alias("ord"), F.concat(F.lit("sprite "), F.concat_ws(",", "x", "y"), F.lit(" "), F.concat_ws(",", "w", "h")).alias("text")))


