"""Layouts joined with markers and animations into one nested document each, and its renderings.

A document is a row; renderings are expressions on it, so that any number of layouts is rendered in
one job.  Its lists are those of one layout and stay small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_size, css_name, csv_field, fnv1a, hex16, index_path, stem, unsigned, xml_text
from ..operators.relations import pivots, resolved
from ..sources.texts import short_number

FPS = 8


def named(sprites: DataFrame) -> DataFrame:
    return sprites.withColumn("name", stem(F.col("path")))


def with_sprites(markers: DataFrame, sprites: DataFrame, job: str = "job") -> DataFrame:
    """markers (index, key) with the sprite their key leads to; without one they hold for the whole layout."""
    return resolved(markers, sprites.select(job, "index", "name", "path").withColumnRenamed("index", "sprite_index"), "key", "index", job, "sprite_index")


def resolved_frames(frames: DataFrame, sprites: DataFrame, job: str = "job") -> DataFrame:
    """job, index (of the animation), pos and sprite_index of the frames that lead to a sprite; numbers are sprite indexes."""
    rows = frames.withColumn("_ref", F.struct("index", "pos"))
    keyed = resolved(rows.where("key is not null").select(job, "_ref", "key"), sprites.select(job, "index", "name", "path").withColumnRenamed("index", "sprite_index"), "key", "_ref", job, "sprite_index")
    named_ = keyed.where("sprite_index is not null").select(job, "_ref.index", "_ref.pos", "sprite_index")
    counts = sprites.groupBy(job).agg(F.count("*").alias("_n"))
    numbered = rows.where("key is null").join(counts, job).where("number >= 0 and number < _n").select(job, "index", "pos", F.col("number").alias("sprite_index"))
    return named_.unionByName(numbered)


def sprite_fields(sprites: DataFrame, atlases: DataFrame, markers: DataFrame, pattern: str = "atlas_%d.png", job: str = "job") -> DataFrame:
    """Sprites (with name) with everything that a document says of them but their markers."""
    w, h = content_size(F.col("w"), F.col("h"), F.col("rotated"))
    sizes = atlases.select(job, "atlas_index", F.col("width").alias("atlas_width"), F.col("height").alias("atlas_height"))
    last = sprites.groupBy(job, "name").agg(F.max("index").alias("_last"))
    rows = pivots(sprites, markers, job).join(sizes, [job, "atlas_index"], "left").join(last, [job, "name"])
    rows = rows.withColumns({"content_w": w, "content_h": h})
    rows = rows.withColumns({"source_w": F.col("content_w") + F.col("trim_left") + F.col("trim_right"), "source_h": F.col("content_h") + F.col("trim_top") + F.col("trim_bottom")})
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.withColumns(
        {
            "unity_y": F.coalesce(F.col("atlas_height") - F.col("y") - F.col("h"), F.lit(0)),
            "pivot_x_norm": share("pivot_x", "source_w"),
            "pivot_y_norm": F.when(F.col("source_h") > 0, 1 - F.col("pivot_y") / F.col("source_h")).otherwise(0.0),
            "pivot_y_norm_raw": share("pivot_y", "source_h"),
            "has_trim": (F.col("trim_left") != 0) | (F.col("trim_top") != 0) | (F.col("trim_right") != 0) | (F.col("trim_bottom") != 0),
            "name_css": css_name(F.col("name")),
            "name_hash": fnv1a(F.col("name")),
            "atlas_path": index_path(pattern, F.col("atlas_index")),
            "last_of_name": F.col("index") == F.col("_last"),
        }
    ).drop("_last")


def documents(header: DataFrame, atlases: DataFrame, sprites: DataFrame, markers: DataFrame, animations: DataFrame, frames: DataFrame, pattern: str = "atlas_%d.png", output_stem: str = "atlas", job: str = "job") -> DataFrame:
    """A row per layout: header fields and sorted arrays of atlases, sprites, markers and animations.

    markers have sprite_index, frames have index (of the animation), pos and sprite_index.
    """
    fields = sprite_fields(sprites, atlases, markers, pattern, job)
    names = sprites.select(job, F.col("index").alias("sprite_index"), F.col("name").alias("sprite_name"), F.col("path").alias("sprite_path"))
    marked = markers.join(names, [job, "sprite_index"], "left").withColumns({"sprite_index": F.coalesce("sprite_index", F.lit(-1)), "sprite_name": F.coalesce("sprite_name", F.lit("")), "sprite_path": F.coalesce("sprite_path", F.lit(""))})
    marker = F.struct("index", "name", "type", "x", "y", "radius", "w", "h", "vertices", "sprite_index", "sprite_name", "sprite_path")
    own = marked.where("sprite_index >= 0").groupBy(job, F.col("sprite_index").alias("index")).agg(F.array_sort(F.collect_list(marker)).alias("markers"))
    none = F.array().cast(marked.select(F.array(marker).alias("m")).schema["m"].dataType)
    full = fields.join(own, [job, "index"], "left").withColumn("markers", F.coalesce("markers", none))
    columns = [c for c in full.columns if c not in (job, "index")]
    listed = full.groupBy(job).agg(F.array_sort(F.collect_list(F.struct("index", F.struct(*columns).alias("s")))).alias("_s"))
    listed = listed.select(job, F.transform("_s", lambda e: F.struct(e["index"].alias("index"), *(e["s"][c].alias(c) for c in columns))).alias("sprites"))
    sheets = atlases.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(F.col("atlas_index").alias("index"), "width", "height", index_path(pattern, F.col("atlas_index")).alias("path")))).alias("atlases"))
    all_markers = marked.groupBy(job).agg(F.array_sort(F.collect_list(marker)).alias("markers"))
    shown = frames.join(names, [job, "sprite_index"]).groupBy(job, "index").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("sprite_index").alias("index"), F.col("sprite_name").alias("name")))).alias("frames"))
    moving = animations.join(shown, [job, "index"], "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<struct<pos:int,index:int,name:string>>")))
    moving = moving.groupBy(job).agg(F.array_sort(F.collect_list(F.struct("index", "name", F.coalesce("fps", F.lit(FPS)).alias("fps"), F.coalesce("alias_source", F.lit("")).alias("alias_source"), F.coalesce("flip", F.lit("")).alias("flip"), "frames"))).alias("animations"))
    doc = listed.join(sheets, job).join(all_markers, job, "left").join(moving, job, "left").join(header, job, "left")
    first = F.col("atlases")[0]
    return doc.withColumns(
        {
            "markers": F.coalesce("markers", none),
            "animations": F.coalesce("animations", F.array().cast(moving.schema["animations"].dataType)),
            "scale": F.coalesce("scale", F.lit(1.0)),
            "extrude": F.coalesce("extrude", F.lit(0)),
            "multipack": F.coalesce("multipack", F.lit(False)),
            "atlas_path": first["path"],
            "atlas_width": first["width"],
            "atlas_height": first["height"],
            "stem_hash_hex": hex16(fnv1a(F.lit(pattern or output_stem))),
        }
    )


# Renderings.


def lines(items: Column, each: Callable[[Column], Column], sep: str = "") -> Column:
    return F.array_join(F.transform(items, each), sep)


def glued(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def numbers(frames: Column, sep: str) -> Column:
    return F.array_join(F.transform(frames, lambda f: f["index"].cast("string")), sep)


def vertices(m: Column) -> Column:
    return F.coalesce(lines(m["vertices"], lambda v: glued(v["x"], ",", v["y"]), "|"), F.lit(""))


def turn(s: Column) -> Column:
    return F.when(s["rotated"], "90").otherwise("0")


CSV_HEAD = "index,name,path,atlas_index,atlas_path,x,y,w,h,pivot_x,pivot_y,trim_left,trim_top,trim_right,trim_bottom,marker_count,markers_json,rotation\n"


def marker_json(m: Column) -> Column:
    return F.to_json(F.struct(m["name"].alias("name"), m["type"].alias("type"), m["x"].alias("x"), m["y"].alias("y"), m["radius"].alias("radius"), m["w"].alias("w"), m["h"].alias("h"), m["vertices"].alias("vertices")))


def csv() -> Column:
    """Sprites, then markers, then animations; the list of markers is a quoted field where it needs to be."""
    text = lambda x, *names: [F.coalesce(csv_field(x[n]), F.lit("")) for n in names]
    row = lambda *fields: F.concat(F.array_join(F.array(*(F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields)), ","), F.lit("\n"))
    blank = lambda x, n: F.coalesce(x[n].cast("string"), F.lit(""))
    sprite = lambda s: row(
        s["index"], *text(s, "name", "path"), s["atlas_index"], *text(s, "atlas_path"), *(s[n] for n in ("x", "y", "w", "h", "pivot_x", "pivot_y", "trim_left", "trim_top", "trim_right", "trim_bottom")),
        F.size(s["markers"]), csv_field(glued("[", lines(s["markers"], marker_json, ","), "]")), turn(s),
    )
    marker = lambda m: row("marker", m["index"], *text(m, "name"), m["type"], *(blank(m, n) for n in ("x", "y", "radius", "w", "h")), vertices(m), m["sprite_index"], *text(m, "sprite_name", "sprite_path"))
    flip = lambda a: F.when(a["flip"] != "", glued(",", a["flip"])).otherwise("")
    moving = lambda a: F.when(
        a["alias_source"] != "", glued("animation,", a["index"], ",", csv_field(a["name"]), ",alias,", csv_field(a["alias_source"]), flip(a), "\n")
    ).otherwise(glued("animation,", a["index"], ",", csv_field(a["name"]), ",", a["fps"], ",", numbers(a["frames"], "|"), flip(a), "\n"))
    return F.concat(F.lit(CSV_HEAD), lines(F.col("sprites"), sprite), lines(F.col("markers"), marker), lines(F.col("animations"), moving))


def attributes(**values: Column) -> Column:
    return glued(*(part for name, v in values.items() for part in (f' {name}="', v, '"')))


def xml() -> Column:
    def marker(m: Column) -> Column:
        head = glued("<marker", attributes(name=xml_text(m["name"]), type=m["type"]))
        corners = glued(head, "><vertices>", vertices(m), "</vertices></marker>")
        at = glued(head, attributes(x=m["x"], y=m["y"]))
        more = F.when(m["type"] == "circle", attributes(radius=m["radius"])).when(m["type"] == "rectangle", attributes(w=m["w"], h=m["h"])).otherwise("")
        return F.when(m["type"] == "polygon", corners).otherwise(glued(at, more, " />"))

    def sprite(s: Column) -> Column:
        shown = attributes(index=s["index"], name=xml_text(s["name"]), path=xml_text(s["path"]), **{n: s[n] for n in ("x", "y", "w", "h", "pivot_x", "pivot_y", "trim_left", "trim_top", "trim_right", "trim_bottom")}, marker_count=F.size(s["markers"]), rotation=turn(s))
        inner = F.when(F.size(s["markers"]) > 0, glued("\n  <markers>\n    ", lines(s["markers"], marker, "\n    "), "\n  </markers>\n")).otherwise("")
        return glued("<sprite", shown, ">", inner, "</sprite>")

    def atlas(a: Column) -> Column:
        own = F.filter("sprites", lambda s: s["atlas_index"] == a["index"])
        return glued("    <atlas", attributes(index=a["index"], width=a["width"], height=a["height"], path=xml_text(a["path"])), ">\n      <sprites>\n        ", lines(own, sprite, "\n        "), "\n      </sprites>\n    </atlas>")

    def moving(a: Column) -> Column:
        head = glued("    <animation", attributes(index=a["index"], name=xml_text(a["name"])))
        alias = glued(head, attributes(alias=xml_text(a["alias_source"])), F.when(a["flip"] != "", attributes(flip=a["flip"])).otherwise(""), " />")
        return F.when(a["alias_source"] != "", alias).otherwise(glued(head, attributes(fps=a["fps"], sprite_indexes=numbers(a["frames"], ",")), " />"))

    motion = F.when(F.size("animations") > 0, glued("  <animations>\n", lines(F.col("animations"), moving, "\n"), "\n  </animations>\n")).otherwise("")
    head = glued('<?xml version="1.0" encoding="UTF-8"?>\n<layout', attributes(multipack=F.col("multipack"), scale=short_number(F.col("scale")), extrude=F.col("extrude")), ">\n")
    return glued(head, "  <atlases>\n", lines(F.col("atlases"), atlas, "\n"), "\n  </atlases>\n", motion, "</layout>\n")


def css(base: str = "sprite") -> Column:
    turned = "  transform: rotate(-90deg) translate(-100%, 0);\n  transform-origin: top left;\n"
    head = glued(":root {\n  --atlas-width: ", F.col("atlas_width"), "px;\n  --atlas-height: ", F.col("atlas_height"), "px;\n  --atlas-scale: ", short_number(F.col("scale")), ";\n}\n\n", f".{base}-base {{\n  background-repeat: no-repeat;\n  display: inline-block;\n}}\n")
    rule = lambda s: glued(
        f".{base}-", s["name_css"], " {\n", F.when(s["atlas_path"] != "", glued("  background-image: url('", s["atlas_path"], "');\n")).otherwise(""),
        "  background-position: -", s["x"], "px -", s["y"], "px;\n  width: ", s["w"], "px;\n  height: ", s["h"], "px;\n  /* source: ", s["path"], " */\n  /* name: ", s["name"], " */\n  /* atlas_index: ", s["atlas_index"], " */\n",
        F.when(s["rotated"], turned).otherwise(""), "}\n",
    )
    return glued(head, lines(F.col("sprites"), rule, "\n"))


def libgdx() -> Column:
    entry = lambda s: glued(s["name"], "\n  rotate: ", s["rotated"], "\n  xy: ", s["x"], ", ", s["y"], "\n  size: ", s["w"], ", ", s["h"], "\n  orig: ", s["source_w"], ", ", s["source_h"], "\n  offset: ", s["trim_left"], ", ", s["trim_bottom"], "\n  index: -1\n")
    block = lambda a: glued(a["path"], "\nsize: ", a["width"], ",", a["height"], "\nformat: RGBA8888\nfilter: Nearest,Nearest\nrepeat: none\n\n", lines(F.filter("sprites", lambda s: s["atlas_index"] == a["index"]), entry))
    return lines(F.col("atlases"), block)


def plist() -> Column:
    pair = lambda a, b: glued("{", a, ",", b, "}")
    item = lambda key, value: glued(f"\t\t\t<key>{key}</key>\n\t\t\t", value, "\n")
    string = lambda v: glued("<string>", v, "</string>")
    half = lambda a, b: F.floor((a - b) / 2)
    entry = lambda s: glued(
        "\t\t<key>", xml_text(s["name"]), "</key>\n\t\t<dict>\n",
        item("frame", string(glued(pair(s["x"], s["y"]), ",", pair(s["w"], s["h"])))), item("offset", string(pair(half(s["trim_left"], s["trim_right"]), half(s["trim_bottom"], s["trim_top"])))),
        item("rotated", F.when(s["rotated"], "<true/>").otherwise("<false/>")), item("sourceColorRect", string(glued(pair(s["trim_left"], s["trim_top"]), ",", pair(s["content_w"], s["content_h"])))),
        item("sourceSize", string(pair(s["source_w"], s["source_h"]))), "\t\t</dict>\n",
    )
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">\n<plist version="1.0">\n<dict>\n\t<key>frames</key>\n\t<dict>\n\n'
    path = glued("\t\t<string>", xml_text(F.col("atlas_path")), "</string>\n")
    tail = glued("\t</dict>\n\t<key>metadata</key>\n\t<dict>\n\t\t<key>format</key>\n\t\t<integer>2</integer>\n\t\t<key>realTextureFileName</key>\n", path, "\t\t<key>size</key>\n\t\t<string>", pair(F.col("atlas_width"), F.col("atlas_height")), "</string>\n\t\t<key>textureFileName</key>\n", path, "\t</dict>\n</dict>\n</plist>\n")
    return glued(head, lines(F.col("sprites"), entry), tail)


def record(**fields: Column) -> Column:
    """A struct with its fields by name, as the JSON renderings order them."""
    return F.struct(*(fields[n].alias(n) for n in sorted(fields)))


def box(s: Column, x: str, y: str, w: str, h: str) -> Column:
    return record(x=s[x], y=s[y], w=s[w], h=s[h])


def as_json(**fields: Column) -> Column:
    return F.to_json(record(**fields))


def frame(s: Column, pivot_y: str = "pivot_y_norm_raw", **more: Column) -> Column:
    return record(frame=box(s, "x", "y", "w", "h"), rotated=s["rotated"], trimmed=s["has_trim"], spriteSourceSize=box(s, "trim_left", "trim_top", "content_w", "content_h"), sourceSize=record(w=s["source_w"], h=s["source_h"]), **({"pivot": record(x=s["pivot_x_norm"], y=s[pivot_y])} if pivot_y else {}), **more)


def meta(**more: Column) -> Column:
    return record(image=F.col("atlas_path"), format=F.lit("RGBA8888"), size=record(w=F.col("atlas_width"), h=F.col("atlas_height")), scale=short_number(F.col("scale")), **more)


def json() -> Column:
    sprite = lambda s: record(name=s["name"], path=s["path"], atlas_index=s["atlas_index"], rect=box(s, "x", "y", "w", "h"), pivot=record(x=s["pivot_x"], y=s["pivot_y"]), trim=record(left=s["trim_left"], top=s["trim_top"], right=s["trim_right"], bottom=s["trim_bottom"]), markers=s["markers"], rotation=F.when(s["rotated"], 90).otherwise(0))
    only = lambda a, v: F.when(a["alias_source"] == "", v)
    moving = lambda a: record(name=a["name"], alias=F.when(a["alias_source"] != "", a["alias_source"]), flip=F.when(a["flip"] != "", a["flip"]), fps=only(a, a["fps"]), sprite_indexes=only(a, F.transform(a["frames"], lambda f: f["index"])), sprite_names=only(a, F.transform(a["frames"], lambda f: f["name"])))
    atlases = F.transform("atlases", lambda a: record(width=a["width"], height=a["height"], path=a["path"]))
    return as_json(multipack=F.col("multipack"), scale=F.col("scale"), extrude=F.col("extrude"), atlases=atlases, sprites=F.transform("sprites", sprite), animations=F.when(F.size("animations") > 0, F.transform("animations", moving)))


def runs(frames: Column) -> Column:
    """Frame numbers as runs (first, last) that count up by one."""
    ids = F.transform(frames, lambda f: f["index"])
    starts = F.filter(F.transform(ids, lambda v, i: F.when((i == 0) | (F.get(ids, i - 1) != v - 1), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda s, k: F.struct(F.get(ids, s).alias("first"), F.get(ids, F.coalesce(F.get(starts, k + 1), F.size(ids)) - 1).alias("last")))


def aseprite() -> Column:
    tags = F.flatten(F.transform("animations", lambda a: F.transform(runs(a["frames"]), lambda r: record(**{"name": a["name"], "from": r["first"], "to": r["last"], "direction": F.lit("forward")}))))
    empty = F.array().cast("array<string>")
    return as_json(frames=F.transform("sprites", lambda s: frame(s, "", filename=s["name"], duration=F.lit(100))), meta=meta(app=F.lit("https://www.aseprite.org/"), version=F.lit("1.3"), frameTags=tags, layers=empty, slices=empty))


def godot() -> Column:
    shown = lambda s: record(name=s["name"], region=box(s, "x", "y", "w", "h"), margin=record(left=s["trim_left"], top=s["trim_top"], right=s["trim_right"], bottom=s["trim_bottom"]), source_size=record(w=s["source_w"], h=s["source_h"]), rotated=s["rotated"], pivot_offset=record(x=s["pivot_x_norm"], y=s["pivot_y_norm_raw"]))
    at = lambda a, k: F.coalesce(F.get(a["frames"], k)["index"], F.lit(0))
    moving = lambda a: record(**{"name": a["name"], "from": at(a, F.lit(0)), "to": at(a, F.size(a["frames"]) - 1), "speed": a["fps"], "loop": F.lit(True)})
    return as_json(image=F.col("atlas_path"), size=record(w=F.col("atlas_width"), h=F.col("atlas_height")), scale=F.col("scale"), frames=F.transform("sprites", shown), animations=F.when(F.size("animations") > 0, F.transform("animations", moving)))


def by_name(pivot_y: str) -> Column:
    """Frames by sprite name; of several sprites with one name the last counts."""
    return F.map_from_entries(F.transform(F.filter("sprites", lambda s: s["last_of_name"]), lambda s: F.struct(s["name"], frame(s, pivot_y))))


def phaser_hash() -> Column:
    return as_json(frames=by_name("pivot_y_norm_raw"), meta=meta())


def phaser_array() -> Column:
    return as_json(frames=F.transform("sprites", lambda s: frame(s, filename=s["name"])), meta=meta())


def phaser_anims() -> Column:
    key = stem(F.col("atlas_path"))
    moving = lambda a: record(key=a["name"], frameRate=a["fps"], repeat=F.lit(-1), frames=F.transform(a["frames"], lambda f: record(key=key, frame=f["name"])))
    return as_json(anims=F.transform("animations", moving))


def unity_json() -> Column:
    return as_json(frames=by_name("pivot_y_norm"), meta=meta(version=F.lit("1.0")))


#: What the meta format says before and after the sprites.
META_IMPORT = """\
  mipmaps:
    mipMapMode: 0
    enableMipMap: 0
    sRGBTexture: 1
    linearTexture: 0
  isReadable: 0
  filterMode: 0
  textureType: 8
  textureShape: 1
  maxTextureSizeSet: 0
  compressionQuality: 50
  textureFormat: -1
  alphaUsage: 1
  alphaIsTransparency: 1
  spriteMode: 2
  spriteExtrude: 1
  spriteMeshType: 1
  alignment: 0
  spritePivot: {x: 0.5, y: 0.5}
  spritePixelsToUnits: 100
  spriteBorder: {x: 0, y: 0, z: 0, w: 0}
  spriteGenerateFallbackPhysicsShape: 1
"""


def unity_meta() -> Column:
    entry = lambda s: glued("    - first:\n        213: ", unsigned(s["name_hash"]), "\n      second: ", s["name"], "\n")
    rect = lambda s: glued(
        "    - serializedVersion: 2\n      name: ", s["name"], "\n      rect:\n        serializedVersion: 2\n        x: ", s["x"], "\n        y: ", s["unity_y"], "\n        width: ", s["content_w"], "\n        height: ", s["content_h"],
        "\n      alignment: 9\n      pivot: {x: ", short_number(s["pivot_x_norm"]), ", y: ", short_number(s["pivot_y_norm"]), "}\n      border: {x: 0, y: 0, z: 0, w: 0}\n      spriteID: ", hex16(s["name_hash"]), "\n      internalID: ", unsigned(s["name_hash"]), "\n",
    )
    return glued("fileFormatVersion: 2\nguid: ", F.col("stem_hash_hex"), "0000000000000000\nTextureImporter:\n  internalIDToNameTable:\n", lines(F.col("sprites"), entry), "  externalObjects: {}\n  serializedVersion: 13\n", META_IMPORT, "  spriteSheet:\n    serializedVersion: 2\n    sprites:\n", lines(F.col("sprites"), rect))


def unity_anims(docs: DataFrame, job: str = "job") -> DataFrame:
    """job, name and content of a clip per animation."""
    rows = docs.select(job, "stem_hash_hex", F.explode("animations").alias("a"), F.transform("sprites", lambda s: F.struct(s["index"], s["name_hash"])).alias("_h"))
    a = F.col("a")
    fps = F.when(a["fps"] > 0, a["fps"]).otherwise(FPS)
    key = lambda f, i: glued("    - time: ", short_number(i / fps), "\n      value: {fileID: ", unsigned(F.get(F.filter("_h", lambda h: h["index"] == f["index"]), F.lit(0))["name_hash"]), ", guid: ", F.col("stem_hash_hex"), "0000000000000000, type: 3}\n")
    head = glued("%YAML 1.1\n%TAG !u! tag:unity3d.com,2011:\n--- !u!74 &740000", a["index"], "\nAnimationClip:\n  m_Name: ", a["name"], "\n  serializedVersion: 6\n  m_Legacy: 0\n  m_PPtrCurves:\n  - curve:\n")
    tail = glued("    attribute: m_Sprite\n    path:\n    classID: 212\n    script: {fileID: 0}\n  m_AnimationClipSettings:\n    serializedVersion: 2\n    m_StartTime: 0\n    m_StopTime: ", short_number(F.size(a["frames"]) / fps), "\n    m_LoopTime: 1\n  m_Events: []\n")
    return rows.select(job, glued(a["name"], ".anim").alias("name"), glued(head, F.array_join(F.transform(a["frames"], key), ""), tail).alias("content"))


#: name: (what it is, file extension, rendering)
RENDERINGS: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "json": ("JSON metadata", ".json", json),
    "csv": ("CSV rows", ".csv", csv),
    "xml": ("XML layout", ".xml", xml),
    "css": ("CSS classes", ".css", css),
    "aseprite": ("Aseprite JSON array", ".json", aseprite),
    "libgdx": ("LibGDX atlas", ".atlas", libgdx),
    "godot": ("Godot JSON", ".json", godot),
    "phaser-hash": ("Phaser 3 atlas by name", ".json", phaser_hash),
    "phaser-array": ("Phaser 3 atlas as a list", ".json", phaser_array),
    "phaser-anims": ("Phaser 3 animations", ".json", phaser_anims),
    "plist": ("Cocos2d property list", ".plist", plist),
    "unity.json": ("Unity JSON", ".json", unity_json),
    "unity.meta": ("Unity texture import", ".meta", unity_meta),
}


def rendered(docs: DataFrame, kind: str | Callable[[], Column], job: str = "job") -> DataFrame:
    """job and content; kind is one of RENDERINGS or an expression of one's own."""
    return docs.select(job, (RENDERINGS[kind][2] if isinstance(kind, str) else kind)().alias("content"))


def listing(spark: SparkSession, more: dict[str, tuple[str, str, Callable[[], Column]]] | None = None) -> DataFrame:
    """name, description and extension of the renderings, those given included, by name."""
    known = {**RENDERINGS, "unity.anim": ("Unity clips, one for each animation", ".anim", None), **(more or {})}
    rows = [(name, what, extension) for name, (what, extension, _) in sorted(known.items())]
    return spark.createDataFrame(rows, "name string, description string, extension string").orderBy("name")


@dataclass(frozen=True)
class Rendering:
    """A rendering of one's own: its extension and either the content of one file or several files (an array of name and content)."""

    what: str
    extension: str
    content: Callable[[], Column] | None = None
    files: Callable[[], Column] | None = None

    def __post_init__(self) -> None:
        if not self.extension.startswith(".") or len(self.extension) < 2:
            raise ValueError(f"{self.extension!r} is no file extension")
        if (self.content is None) == (self.files is None):
            raise ValueError("a rendering makes one content or several files, not both and not neither")


def output_files(docs: DataFrame, kind: str | Rendering, stem: str = "atlas", job: str = "job") -> DataFrame:
    """job, name and content of the files that a rendering comes to: one with its extension, one for each animation, or those it names itself."""
    if kind == "unity.anim":
        return unity_anims(docs, job)
    if isinstance(kind, str):
        what, extension, content = RENDERINGS[kind]
        kind = Rendering(what, extension, content)
    if kind.files is not None:
        return docs.select(job, F.explode(kind.files()).alias("_f")).select(job, "_f.name", "_f.content")
    return rendered(docs, kind.content, job).select(job, F.lit(stem + kind.extension).alias("name"), "content")
