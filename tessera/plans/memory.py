"""Layouts that are remembered: outputs, seeds and image metadata, kept in stores between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import api
from ..operators import relations as r
from ..options import LayoutOptions, as_dict
from ..sources import images, sinks, texts
from ..sources.store import Store

OUTPUT = "signature string, job long, content string, cached_at timestamp"
SEED = "signature string, place string, job long, seq long, path string, atlas_index int, x int, y int, w int, h int, rotated boolean, trim_left int, trim_top int, trim_right int, trim_bottom int, cached_at timestamp"
META = images.META.removesuffix(", error string") + ", trim boolean, cached_at timestamp"
#: How long things are kept, in seconds, and how many of them.
SECONDS, OUTPUTS, SEEDS, ENTRIES = 3600, 16, 8, 10_000
#: Options that do not change which places a seed has to offer, and those that say how it looked.
LOOSE = ("padding", "deduplicate", "dedup_threshold")


def signatures(files: DataFrame, o: LayoutOptions) -> DataFrame:
    """job with three signatures: of the output (all options and sources), of a seed (not those in LOOSE), and of the place (the job's number, options, no sources)."""
    order = o.sort in ("none", "source")
    prints = r.fingerprint(files.select("job", F.row_number().over(api._by_path("job")).alias("seq"), "path", "length", F.col("modificationTime").alias("mtime")), order)
    every, loose = as_dict(o), {k: v for k, v in as_dict(o).items() if k not in LOOSE}
    signed = r.signature(prints, every).withColumnRenamed("signature", "output")
    signed = r.signature(signed, loose).withColumnRenamed("signature", "seed")
    place = F.sha2(F.concat_ws("|", F.lit("place"), F.col("job").cast("string"), F.lit(";".join(f"{k}={every[k]}" for k in sorted(every)))), 256)
    return signed.select("job", "output", "seed", place.alias("place"))


def sound(meta: DataFrame) -> DataFrame:
    """Entries of a metadata store that can be true: sides within the limits and trims that are not negative."""
    side = lambda c: F.col(c).between(1, images.LONGEST_SIDE)
    return meta.where(side("w") & side("h") & (F.least(*(F.coalesce(F.col(c), F.lit(0)) for c in r.TRIMS)) >= 0))


def seen_again(meta: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Entries with the time of their last use: those of the paths in `used` (path, trim) are as new."""
    hit = used.select("path", "trim", F.lit(True).alias("_hit")).distinct()
    return meta.join(hit, ["path", "trim"], "left").withColumn("cached_at", F.when(F.col("_hit"), now).otherwise(F.col("cached_at"))).drop("_hit")


def as_text(found: dict[str, DataFrame]) -> DataFrame:
    """job and content: each layout in its text form."""
    named = lambda df: df.withColumn("file", F.col("job").cast("string"))
    header = named(found["header"]).withColumn("root", F.lit(None).cast("string"))
    rows = named(found["sprite"]).withColumns({"index": F.col("seq").cast("int"), "has_trim": F.greatest(*(F.col(c) for c in r.TRIMS)) > 0, "dither": F.lit(False), "colors": F.lit(0), "slice": F.lit(None).cast("struct<left:int,top:int,right:int,bottom:int,h:string,v:string>")})
    lines = texts.layout_lines(header, named(found["atlas"]), rows, named(found["alias"]))
    return sinks.as_texts(lines).select(F.col("file").cast("long").alias("job"), F.col("value").alias("content"))


def remembered(files: DataFrame, o: LayoutOptions, folder: str, now: Column | None = None) -> dict[str, DataFrame]:
    """text (job, content, hit), error (job, message) and skipped (job, path, error) of the layouts of image files (job, path, modificationTime, length, content).

    A job whose files and options are those of an earlier run is answered from the store; its images are
    not opened.  The others take sizes and hashes of unchanged images from the store, are laid out from
    earlier places (o.incremental: of the same job, whatever its images; otherwise of the same images) and are
    written for the next run.  What is not used for SECONDS is forgotten.
    """
    spark = files.sparkSession
    now = F.current_timestamp() if now is None else now
    outputs, seeds, metas = (Store(spark, f"{folder}/{name}", schema) for name, schema in (("outputs", OUTPUT), ("seeds", SEED), ("metadata", META)))
    fresh = lambda store: store.where(F.col("cached_at") >= now - F.expr(f"INTERVAL {SECONDS} SECONDS"))
    signed = r.materialised(signatures(files, o))
    known = r.stored_outputs(signed.select("job", F.col("output").alias("signature")), fresh(outputs.read()).drop("job"))
    known = r.materialised(known.where("hit").select("job", "content"))
    left = files.join(known.select("job"), "job", "left_anti")

    cache = r.materialised(sound(fresh(metas.read())))
    sprites, skipped = api.read_sprites(left, o, cache)
    kept = fresh(seeds.read())
    mine = signed.select("job", F.col("place" if o.incremental else "seed").alias("_s"))
    earlier = r.materialised(kept.join(mine, (kept["job"] == mine["job"]) & (kept["place" if o.incremental else "signature"] == mine["_s"])).drop(mine["job"]).drop("_s"))
    found = api.layout(sprites, o, previous=earlier if o.incremental else None, seeds=None if o.incremental else earlier)
    made = r.materialised(as_text(found))

    if not made.isEmpty():
        new = made.join(signed, "job").select(F.col("output").alias("signature"), "job", "content", now.alias("cached_at"))
        outputs.update(lambda old: r.pruned(old.join(new.select("signature"), "signature", "left_anti").unionByName(new), now, SECONDS, OUTPUTS * max(1, made.count()), name="signature"))
        if not o.multipack:
            rows = found["sprite"].join(signed.select("job", F.col("seed").alias("signature"), "place"), "job").withColumn("cached_at", now)
            columns = [c.split()[0] for c in SEED.split(", ")]
            rows = r.materialised(rows.select(*columns))

            def change(old: DataFrame) -> DataFrame:
                both = old.join(rows.select("signature").distinct(), "signature", "left_anti").unionByName(rows)
                last = r.pruned(both.groupBy("signature").agg(F.max("cached_at").alias("cached_at")), now, SECONDS, SEEDS * made.count(), name="signature")
                return both.join(last.select("signature"), "signature", "left_semi")

            seeds.update(change)
        read = r.materialised(images.metadata(left.join(cache.select("path", "length", F.col("mtime").alias("modificationTime")), ["path", "length", "modificationTime"], "left_anti"), o.trim_transparent, o.deduplicate == "exact", o.deduplicate == "perceptual").where("error is null").drop("error").withColumn("trim", F.lit(o.trim_transparent)))
        used = left.select("path", F.lit(o.trim_transparent).alias("trim"))
        metas.update(lambda old: r.pruned(seen_again(r.merged_cache(old, read, now), used, now), now, SECONDS, ENTRIES))
    text = known.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False)))
    return {"text": text, "error": found["error"], "skipped": skipped}
