"""Relational operators: orders, checks, duplicates, lookups, reductions and caches.

Sprites come in jobs: every operator works on all jobs of a table at once and takes `job`, the
column that tells them apart.  `seq` is a sprite's place in its job's source order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.scalars import animation_base, hamming, natural_key

# Orders.

#: The columns that each order compares, largest first; ties go to the natural path order or to seq.
ORDERS = {
    "height": ("h", "w"),
    "width": ("w", "h"),
    "area": ("w * h", "h", "w"),
    "maxside": ("greatest(w, h)", "w * h"),
    "perimeter": ("2 * (w + h)", "w * h"),
}


def order_keys(order: str, stable: bool = False) -> list[Column]:
    """Sort keys of `name`, `none` or one of ORDERS; with stable, ties are in natural path order."""
    if order == "none":
        return [F.col("seq")]
    natural = [natural_key(F.col("path")), F.col("path"), F.col("seq")]
    if order == "name":
        return natural
    return [F.desc_nulls_last(F.expr(e)) for e in ORDERS[order]] + (natural if stable else [F.col("seq")])


def ranked(sprites: DataFrame, order: str, stable: bool = False, job: str = "job") -> DataFrame:
    """sprites with `rank`, the place (from 1) in the order within the job."""
    return sprites.withColumn("rank", F.row_number().over(W.partitionBy(job).orderBy(*order_keys(order, stable))))


def natural_order(images: DataFrame, job: str = "job") -> DataFrame:
    """Images by natural path order, then size and time of change; the place is `seq`."""
    keys = [natural_key(F.col("path")), F.col("length"), F.col("modificationTime"), F.col("path")]
    return images.withColumn("seq", F.row_number().over(W.partitionBy(job).orderBy(*keys)) - 1)


# Statistics and checks.


def layout_stats(sprites: DataFrame, padding: int = 0, job: str = "job") -> DataFrame:
    w, h = F.col("w").cast("long") + padding, F.col("h").cast("long") + padding
    return sprites.groupBy(job).agg(F.count("*").alias("n"), F.max(w).alias("max_w"), F.max(h).alias("max_h"), F.sum(w).alias("sum_w"), F.sum(h).alias("sum_h"), F.sum(w * h).alias("area"))


def over_limits(sprites: DataFrame, max_w: int, max_h: int, padding: int = 0, rotate: bool = False) -> DataFrame:
    """Sprites that no atlas within the limits can hold."""
    w, h = F.col("w") + padding, F.col("h") + padding
    fits = (w <= max_w) & (h <= max_h)
    return sprites.where(~(fits | ((h <= max_w) & (w <= max_h))) if rotate else ~fits)


def odd_sizes(sprites: DataFrame, job: str = "job") -> DataFrame:
    """Per job, the first sprite whose size differs from the first one's: a grid needs equal sizes."""
    first = sprites.groupBy(job).agg(F.min_by(F.struct("w", "h"), "seq").alias("_first"))
    odd = sprites.join(first, job).where((F.col("w") != F.col("_first.w")) | (F.col("h") != F.col("_first.h")))
    return odd.groupBy(job).agg(F.min_by(F.struct("path", "w", "h"), "seq").alias("_odd")).select(job, "_odd.*")


def out_of_bounds(placed: DataFrame, atlases: DataFrame, keys: tuple[str, ...] = ("job", "atlas_index")) -> DataFrame:
    joined = placed.join(atlases, list(keys))
    return joined.where((F.least("x", "y", "w", "h") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))).select(*placed.columns)


def overlaps(placed: DataFrame, tile: int = 64, keys: tuple[str, ...] = ("job", "atlas_index"), name: str = "seq") -> DataFrame:
    """Pairs (a < b) of sprites of an atlas that overlap.

    Rectangles are dealt to tiles and meet by an equi-join there.  Tiles come in levels, each twice as
    large as the one below; a rectangle stands on the level whose tiles are not smaller than it, so it
    touches four of them at most, and asks on its own and on all higher levels of its atlas.  A pair counts in
    the tile that holds the upper left corner of the overlap, so it appears once.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("w", "h") / tile))).cast("int")
    rows = placed.where("w > 0 and h > 0").select(*keys, F.col(name).alias("id"), "x", "y", "w", "h", level.alias("level"))
    rows = rows.withColumn("_top", F.max("level").over(W.partitionBy(*keys)))
    across = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / F.col("side")), F.floor((F.col(at) + F.col(size) - 1) / F.col("side"))))
    tiled = lambda df: df.withColumn("side", F.lit(tile) * F.pow(F.lit(2), F.col("on")).cast("long")).withColumn("tx", across("x", "w")).withColumn("ty", across("y", "h"))
    a, b = tiled(rows.withColumn("on", F.col("level"))).alias("a"), tiled(rows.withColumn("on", F.explode(F.sequence("level", "_top")))).alias("b")
    c = F.col
    left, top = F.greatest("a.x", "b.x"), F.greatest("a.y", "b.y")
    same = reduce(lambda p, q: p & q, [c(f"a.{k}") == c(f"b.{k}") for k in (*keys, "on", "tx", "ty")])
    meet = (left < F.least(c("a.x") + c("a.w"), c("b.x") + c("b.w"))) & (top < F.least(c("a.y") + c("a.h"), c("b.y") + c("b.h")))
    once = (F.floor(left / c("a.side")) == c("a.tx")) & (F.floor(top / c("a.side")) == c("a.ty"))
    other = (c("a.level") > c("b.level")) | (c("a.id") < c("b.id"))
    return a.join(b, same & other & meet & once).select(*(c(f"a.{k}").alias(k) for k in keys), F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def tight_bounds(placed: DataFrame, keys: tuple[str, ...] = ("job", "atlas_index"), padding: int = 0) -> DataFrame:
    return placed.groupBy(*keys).agg((F.max(F.col("x") + F.col("w")) + padding).alias("width"), (F.max(F.col("y") + F.col("h")) + padding).alias("height"))


def exclude(images: DataFrame, names: DataFrame) -> DataFrame:
    """images (path) without those in names (path)."""
    return images.join(names.select("path").distinct(), "path", "left_anti")


# Duplicates.


def exact_duplicates(sprites: DataFrame, job: str = "job") -> DataFrame:
    """sprites with canonical_path: the first of the job with the same content and size; content 0 is never a duplicate."""
    same = [job, "content_hash", "w", "h"]
    first = sprites.where(F.col("content_hash").cast("string") != "0").groupBy(*same).agg(F.min(F.struct("seq", "path")).alias("_first"))
    return sprites.join(first, same, "left").withColumn("canonical_path", F.coalesce("_first.path", "path")).drop("_first")


class Bands:
    """The 64 bits of a hash cut into bands, each with the distance within which two similar hashes agree in one of them at least.

    Of two hashes that differ in at most `threshold` bits, one of the first r + 1 of m bands differs in
    at most q bits or one of the others in fewer than q, where threshold = q m + r.
    """

    def __init__(self, threshold: int, m: int) -> None:
        q, r = divmod(threshold, m)
        cuts = [64 * k // m for k in range(m + 1)]
        self.m = m
        self.spans = [(cuts[k], cuts[k + 1]) for k in range(m) if q or k <= r]
        self.within = [q if k <= r else q - 1 for k in range(len(self.spans))]

    def keys(self, k: int) -> int:
        """How many values a band has within its distance of a given one."""
        low, high = self.spans[k]
        return sum(comb(high - low, d) for d in range(self.within[k] + 1))

    def cost(self, n: Column | float) -> Column | float:
        """Rows that n hashes give, and pairs that meet if their bits are even."""
        rows = len(self.spans) + sum(map(self.keys, range(len(self.spans))))
        meet = sum(self.keys(k) / 2.0 ** (high - low) for k, (low, high) in enumerate(self.spans))
        return n * rows + n * n * (meet / 2)

    def part(self, h: Column, k: int) -> Column:
        low, high = self.spans[k]
        return F.shiftrightunsigned(F.shiftleft(h, 64 - high), 64 - high + low)

    def own(self, h: Column) -> Column:
        return F.array(*(F.struct(F.lit(self.m).alias("bands"), F.lit(k).alias("band"), self.part(h, k).alias("bits")) for k in range(len(self.spans))))

    def near(self, h: Column) -> Column:
        """Each band's values within its distance."""
        parts = []
        for k, (low, high) in enumerate(self.spans):
            masks = [sum(1 << b if b < 63 else -(1 << 63) for b in bits) for d in range(self.within[k] + 1) for bits in combinations(range(high - low), d)]
            near = lambda mask: F.struct(F.lit(self.m).alias("bands"), F.lit(k).alias("band"), self.part(h, k).bitwiseXOR(mask.cast("long")).alias("bits"))  # noqa: B023, E731
            parts.append(F.transform(F.array(*map(F.lit, masks)), near))
        return F.concat(*parts)

    def earlier(self, a: Column, b: Column, band: Column) -> Column:
        """Whether a and b meet in a band before that one too."""
        meets = [(band > k) & (F.bit_count(self.part(a, k).bitwiseXOR(self.part(b, k))) <= self.within[k]) for k in range(len(self.spans) - 1)]
        return reduce(lambda p, q: p | q, meets, F.lit(False))


MOST_KEYS = 4096  #: rows that one hash gives at most


def band_choices(threshold: int) -> list[Bands]:
    """The numbers of bands that are the cheapest for some number of hashes: more hashes want fewer, wider bands."""
    every = [b for m in range(1, min(threshold, 63) + 2) if sum(map((b := Bands(threshold, m)).keys, range(len(b.spans)))) <= MOST_KEYS]
    return list({min(every, key=lambda b: b.cost(2.0**k)).m: min(every, key=lambda b: b.cost(2.0**k)) for k in range(50)}.values())


def meeting_pairs(sprites: DataFrame, threshold: int = 5, job: str = "job", choices: list[Bands] | None = None) -> DataFrame:
    """Pairs (a < b, with hashes ha and hb) of a job with equal size that meet in a band: candidates for similar_pairs, once for each band.

    Hashes are looked up in bands of bits by all values within the band's distance.  How many bands
    there are is chosen for each job and size by the number of its hashes.
    """
    choices = choices or band_choices(threshold)
    h, group = F.col("perceptual_hash"), [job, "w", "h"]
    rows = sprites.where("perceptual_hash <> 0").select(*group, "seq", "perceptual_hash")
    sizes = rows.groupBy(*group).agg(F.count("*").cast("double").alias("_n"))
    best = F.array_min(F.array(*(F.struct(b.cost(F.col("_n")).alias("cost"), F.lit(b.m).alias("m")) for b in choices)))["m"]
    rows = rows.join(sizes.select(*group, best.alias("_m")), group)
    pick = lambda make: reduce(lambda e, b: e.when(F.col("_m") == b.m, make(b)), choices[1:], F.when(F.col("_m") == choices[0].m, make(choices[0])))
    asked = rows.select(*group, F.col("seq").alias("a"), h.alias("ha"), F.explode(pick(lambda b: b.near(h))).alias("_k")).select(*group, "a", "ha", "_k.*")
    told = rows.select(*group, F.col("seq").alias("b"), h.alias("hb"), F.explode(pick(lambda b: b.own(h))).alias("_k")).select(*group, "b", "hb", "_k.*")
    return asked.join(told, [*group, "bands", "band", "bits"]).where("a < b")


def similar_pairs(sprites: DataFrame, threshold: int = 5, job: str = "job", choices: list[Bands] | None = None) -> DataFrame:
    """Pairs (a < b) of a job with equal size whose 64-bit hashes differ in at most threshold bits; hash 0 has no partners.

    A pair counts in the first band in which it meets.
    """
    choices = choices or band_choices(threshold)
    c = F.col
    again = reduce(lambda p, q: p | q, [(c("bands") == b.m) & b.earlier(c("ha"), c("hb"), c("band")) for b in choices])
    near = hamming(c("ha"), c("hb"))
    return meeting_pairs(sprites, threshold, job, choices).where((near <= threshold) & ~again).select(job, "a", "b", near.alias("distance"))


def connected(edges: DataFrame, keys: tuple[str, ...] = ("job",)) -> DataFrame:
    """keys, node and component (the smallest node reachable) of the nodes of edges (keys, a, b).

    In each round a node takes the smallest label among its neighbours' and its own label's, until nothing
    changes; each round is one join and one sum, written as a table in the checkpoint folder.  Labels are
    shuffled and never broadcast: their files are small for what they hold, and the driver would gather them in each round.
    """
    k = list(keys)
    _use_checkpoints(edges)
    spark = edges.sparkSession
    folder, turn = f"{spark.sparkContext.getCheckpointDir()}/connected-{uuid.uuid4().hex}", 0
    ends = lambda x, y: edges.select(*k, F.col(x).alias("node"), F.col(y).alias("near"))
    near = written(ends("a", "b").unionByName(ends("b", "a")).unionByName(ends("a", "a")).unionByName(ends("b", "b")).distinct(), f"{folder}/near")
    labels = written(near.groupBy(*k, "node").agg(F.min("near").alias("component")), f"{folder}/0")
    while True:
        asked = near.unionByName(labels.where("component <> node").select(*k, "node", F.col("component").alias("near")))
        told = asked.hint("merge").join(labels.select(*k, F.col("node").alias("near"), F.col("component").alias("_label")), [*k, "near"])
        own = F.max(F.when(F.col("near") == F.col("node"), F.col("_label")))
        turn += 1
        moved = written(told.groupBy(*k, "node").agg(F.min("_label").alias("component"), own.alias("_was")), f"{folder}/{turn}")
        labels = moved.select(*k, "node", "component")
        if moved.where("component <> _was").isEmpty():
            return labels


def written(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder and read again.

    Loops over joins need this: a checkpoint keeps the size that Spark has estimated, which is the
    product of the joined ones and so squares in each round.
    """
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _use_checkpoints(df: DataFrame) -> None:
    """Keep the session's checkpoint folder; without one, only a local session may use its warehouse."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def materialised(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, so that what is made of it several times is computed once."""
    _use_checkpoints(df)
    return df.checkpoint()


BLOCK = 32_768  #: hashes of a block: every two blocks of a group are compared by one task
_GROUP = ("w", "h")


def hash_classes(sprites: DataFrame, job: str = "job") -> DataFrame:
    """job, w, h, perceptual_hash, first (the smallest seq) and n of the sprites that share a hash; hash 0 has no class."""
    return sprites.where("perceptual_hash <> 0").groupBy(job, *_GROUP, "perceptual_hash").agg(F.min(F.col("seq").cast("long")).alias("first"), F.count("*").alias("n"))


def hash_blocks(classes: DataFrame, job: str = "job", block: int = BLOCK) -> DataFrame:
    """classes (with any further columns) in rows of about `block` each, as arrays: job, w, h, _at (the row's number), _of (how many the group has) and one array per column."""
    keys = [job, *_GROUP]
    rest = [c for c in classes.columns if c not in keys]
    sizes = classes.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_of"))
    rows = classes.join(sizes, keys).withColumn("_at", F.pmod(F.xxhash64("perceptual_hash"), F.col("_of")).cast("int"))
    packed = rows.groupBy(*keys, "_of", "_at").agg(F.array_sort(F.collect_list(F.struct("first", *(c for c in rest if c != "first")))).alias("_c"))
    return packed.select(*keys, "_of", "_at", *(F.col(f"_c.{c}").alias(c) for c in rest))


def block_pairs(blocks: DataFrame, job: str = "job", once: bool = False) -> DataFrame:
    """Every block of a group beside every one (columns with _b; once: those of larger number only), dealt over all tasks."""
    keys = [job, *_GROUP]
    rest = [c for c in blocks.columns if c not in (*keys, "_of", "_at")]
    every = F.sequence(F.lit(0), F.col("_of") - 1)
    above, below = (F.filter(every, lambda k: k > F.col("_at")), F.filter(every, lambda k: k < F.col("_at"))) if once else (every, every)
    a = blocks.select(*keys, F.col("_at").alias("_i"), F.explode(above).alias("_j"), *rest)
    b = blocks.select(*keys, F.explode(below).alias("_i"), F.col("_at").alias("_j"), *(F.col(c).alias(f"{c}_b") for c in rest))
    return a.hint("merge").join(b, [*keys, "_i", "_j"])


def _bits(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).view(np.uint64)


def similar_counts(sprites: DataFrame, threshold: int = 5, job: str = "job") -> DataFrame:
    """sprites with class_seq, the first with the same hash, and links: how many others of the job with equal size have a hash that differs in at most threshold bits.

    Copies are counted without being listed, and no pair leaves its task: hashes are compared in blocks,
    a task for any two of a group's, each of which gives one number for each of its hashes.  Hash 0 has no links.
    """
    keys = [job, *_GROUP]
    classes = materialised(hash_classes(sprites, job))
    shape = sprites.select(job, *_GROUP).schema
    out = StructType([*shape.fields, StructField("perceptual_hash", ArrayType(LongType())), StructField("links", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ours, theirs = _bits(batch["perceptual_hash"][row]), _bits(batch["perceptual_hash_b"][row])
                copies = batch["n_b"][row].values.to_numpy(zero_copy_only=False)
                several = np.flatnonzero(copies > 1)
                more = copies[several] - 1
                links = np.empty(len(ours), np.int64)
                for k, h in enumerate(ours):
                    near = np.bitwise_count(theirs ^ h) <= threshold
                    links[k] = np.count_nonzero(near) + (int(more[near[several]].sum()) if len(several) else 0)
                arrays = [batch[c].slice(row, 1) for c in (*keys, "perceptual_hash")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([links], pa.list_(pa.int64()))], out.names)

    found = block_pairs(hash_blocks(classes.select(*keys, "perceptual_hash", "first", "n"), job), job).select(*keys, "perceptual_hash", "perceptual_hash_b", "n_b").mapInArrow(run, out)
    each = found.select(*keys, F.explode(F.arrays_zip("perceptual_hash", "links")).alias("_l")).select(*keys, "_l.*")
    counts = each.groupBy(*keys, "perceptual_hash").agg((F.sum("links") - 1).alias("links"))  # less the sprite itself
    led = classes.drop("n").join(counts, [*keys, "perceptual_hash"])
    joined = sprites.join(led, [*keys, "perceptual_hash"], "left")
    return joined.withColumns({"class_seq": F.coalesce("first", F.col("seq").cast("long")), "links": F.coalesce("links", F.lit(0).cast("long"))}).drop("first")


def chained(h: np.ndarray, threshold: int) -> np.ndarray:
    """For each of a list of hashes the place of the first one that a chain of similar ones leads to; what is reached is not looked at again."""
    label, places, rest = np.zeros(len(h), np.int64), np.arange(len(h)), h
    while len(places):
        start, stack = places[0], [rest[0]]
        label[start] = start
        places, rest = places[1:], rest[1:]
        while stack and len(places):
            near = np.bitwise_count(rest ^ stack.pop()) <= threshold
            if near.any():
                label[places[near]] = start
                stack.extend(rest[near])
                places, rest = places[~near], rest[~near]
    return label


def chains_between(a: np.ndarray, chain_a: np.ndarray, b: np.ndarray, chain_b: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Chains of one block and of another that similar hashes join, as few pairs as say it."""
    sides = [[a, chain_a], [b, chain_b]]  # what is not reached yet
    members = []
    for h, chain in sides:
        order = np.argsort(chain, kind="stable")
        names, first = np.unique(chain[order], return_index=True)
        members.append({int(n): part for n, part in zip(names, np.split(h[order], first[1:]), strict=True)})
    out = []
    while len(sides[0][0]) and len(sides[1][0]):
        stack = [(0, int(sides[0][1][0]))]
        keep = sides[0][1] != stack[0][1]
        sides[0] = [sides[0][0][keep], sides[0][1][keep]]
        while stack:
            side, name = stack.pop()
            other = 1 - side
            for h in members[side][name]:
                rest, chain = sides[other]
                if not len(rest):
                    break
                near = np.bitwise_count(rest ^ h) <= threshold
                if near.any():
                    reached = np.unique(chain[near])
                    out += [(name, int(r)) for r in reached]
                    stack += [(other, int(r)) for r in reached]
                    keep = ~np.isin(chain, reached)
                    sides[other] = [rest[keep], chain[keep]]
    return out


def perceptual_duplicates(sprites: DataFrame, threshold: int = 5, job: str = "job") -> DataFrame:
    """sprites with canonical_seq: the first sprite that a chain of similar ones leads to.

    Sprites with one hash are one.  Chains are found within blocks of hashes first; any two blocks of a
    group then tell which of their chains belong together, so what is joined over all of
    them grows with the hashes and not with their pairs.
    """
    keys = [job, *_GROUP]
    classes = hash_classes(sprites, job).select(*keys, "perceptual_hash", "first")
    shape = StructType(sprites.select(job, *_GROUP).schema.fields)
    longs = lambda *names: [StructField(n, ArrayType(LongType())) for n in names]
    blocked = StructType([*shape.fields, StructField("_of", IntegerType()), StructField("_at", IntegerType()), *longs("first", "perceptual_hash", "chain")])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = []
            for row in range(batch.num_rows):
                first = batch["first"][row].values.to_numpy(zero_copy_only=False)
                chains.append(first[chained(_bits(batch["perceptual_hash"][row]), threshold)])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in blocked.names[:-1]), pa.array(chains, pa.list_(pa.int64()))], blocked.names)

    edge = StructType([*sprites.select(job).schema.fields, StructField("a", LongType()), StructField("b", LongType())])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                side = lambda end: (_bits(batch[f"perceptual_hash{end}"][row]), batch[f"chain{end}"][row].values.to_numpy(zero_copy_only=False))  # noqa: B023, E731
                pairs = chains_between(*side(""), *side("_b"), threshold)
                own = pa.array([batch[job][row].as_py()] * len(pairs), batch[job].type)
                yield pa.RecordBatch.from_arrays([own, pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], edge.names)

    blocks = materialised(hash_blocks(classes, job).select(*keys, "_of", "_at", "first", "perceptual_hash").mapInArrow(within, blocked))
    edges = block_pairs(blocks.where("_of > 1"), job, once=True).select(job, "perceptual_hash", "chain", "perceptual_hash_b", "chain_b").mapInArrow(between, edge)
    found = connected(edges, (job,)).select(job, F.col("node").alias("chain"), "component")
    chains = blocks.select(*keys, F.explode(F.arrays_zip("perceptual_hash", "chain")).alias("_c")).select(*keys, "_c.*")
    led = chains.join(found, [job, "chain"], "left").select(*keys, "perceptual_hash", F.coalesce("component", "chain").alias("_first"))
    return sprites.join(led, [*keys, "perceptual_hash"], "left").withColumn("canonical_seq", F.coalesce("_first", F.col("seq").cast("long"))).drop("_first")


# Lookups.


def suffixes(path: Column) -> Column:
    """The path's endings after each slash, longest first, as struct(at, key); at is how many parts were left out."""
    parts = F.split(path, "/", -1)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("at"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("key")))
    return F.filter(cut, lambda s: s["key"] != "")


def path_keys(sprites: DataFrame, job: str = "job", index: str = "index") -> DataFrame:
    """job, key and index that a path key leads to.

    Whole paths and file names belong to the last sprite that has them; other endings to the first,
    and only where no path or file name claims them.
    """
    path = F.col("path")
    whole = sprites.select(job, index, F.explode(F.array(path, F.element_at(F.split(path, "/", -1), -1))).alias("key"), F.lit(True).alias("own"))
    ends = sprites.select(job, index, F.explode(F.transform(suffixes(path), lambda s: s["key"])).alias("key"), F.lit(False).alias("own"))
    own = F.col("own")
    return whole.unionByName(ends).groupBy(job, "key").agg(F.coalesce(F.max(F.when(own, F.col(index))), F.min(F.when(~own, F.col(index)))).alias(index))


def name_keys(sprites: DataFrame, job: str = "job", index: str = "index") -> DataFrame:
    return sprites.groupBy(job, F.col("name").alias("key")).agg(F.max(index).alias(index))


def resolved(refs: DataFrame, sprites: DataFrame, key: str = "key", ref: str = "ref", job: str = "job", index: str = "index") -> DataFrame:
    """refs (job, ref, key) with the sprite index its key leads to, or null.

    Tried in turn: the key as a path key, its endings from the longest, the key as a name.
    """
    tries = refs.select(job, ref, F.explode(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col(key).alias("key"))), suffixes(F.col(key)))).alias("_t")).select(job, ref, "_t.*")
    hits = tries.join(path_keys(sprites, job, index), [job, "key"]).select(job, ref, "at", index)
    names = refs.select(job, ref, F.col(key).alias("key"), F.lit(1 << 30).alias("at")).join(name_keys(sprites, job, index), [job, "key"]).select(job, ref, "at", index)
    best = hits.unionByName(names).groupBy(job, ref).agg(F.min_by(index, "at").alias(index))
    return refs.join(best, [job, ref], "left")


# Animations and pivots.


def auto_animations(sprites: DataFrame, job: str = "job") -> DataFrame:
    """job, name and frames of the names that differ in their ending number only; single sprites make none."""
    base = animation_base(F.col("name"))
    groups = sprites.where(base != "").groupBy(job, base.alias("name")).agg(F.sort_array(F.collect_list("index")).alias("frames"))
    return groups.where(F.size("frames") > 1)


def consecutive_runs(frames: DataFrame, keys: tuple[str, ...] = ("job", "anim")) -> DataFrame:
    """keys, run, first and last of each run of frames (keys, pos, frame) that count up by one."""
    w = W.partitionBy(*keys).orderBy("pos")
    breaks = F.coalesce((F.col("frame") != F.lag("frame").over(w) + 1).cast("int"), F.lit(0))
    rows = frames.withColumn("_new", breaks).withColumn("run", F.sum("_new").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def pivots(sprites: DataFrame, markers: DataFrame, job: str = "job") -> DataFrame:
    """sprites with pivot_x and pivot_y: their own first point named pivot, else the job's first global one, else 0, 0."""
    points = markers.where("name = 'pivot' and type = 'point'")
    first = F.min(F.struct("index", "x", "y")).alias("_p")
    own = points.where("sprite_index is not null").groupBy(job, F.col("sprite_index").alias("index")).agg(first)
    everywhere = points.where("sprite_index is null").groupBy(job).agg(first).withColumnRenamed("_p", "_g")
    joined = sprites.join(own, [job, "index"], "left").join(everywhere, job, "left")
    return joined.withColumns({f"pivot_{c}": F.coalesce(f"_p.{c}", f"_g.{c}", F.lit(0)) for c in "xy"}).drop("_p", "_g")


# Reductions of candidates.

GOALS = {
    "gpu": ("greatest(width, height)", "area", "abs(width - height)", "width"),
    "space": ("area", "greatest(width, height)", "abs(width - height)", "width"),
    "multipack_gpu": ("-packed", "-packed_area", "greatest(width, height)", "area", "abs(width - height)", "width"),
    "multipack_space": ("-packed_area", "-packed", "area", "greatest(width, height)", "abs(width - height)", "width"),
}


def best_candidates(candidates: DataFrame, goal: str = "gpu", keys: tuple[str, ...] = ("job",), seq: str = "cand") -> DataFrame:
    """The best valid candidate (width, height and area) of each key; ties go to the first tried."""
    order = F.struct(*(F.expr(e).cast("double").alias(f"k{n}") for n, e in enumerate(GOALS[goal])), F.col(seq).alias("seq"))
    rows = candidates.where("width > 0 and height > 0").withColumn("area", F.col("width").cast("long") * F.col("height"))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*keys, "_best.*")


# Caches.


def cache_hits(images: DataFrame, cache: DataFrame, need_content: bool = False, need_perceptual: bool = False) -> DataFrame:
    """images (path, trim, length, mtime) with the cached columns and `hit`: unchanged, and with the hashes that are needed."""
    kept = cache.select("path", "trim", F.col("length").alias("_length"), F.col("mtime").alias("_mtime"), *(c for c in cache.columns if c not in ("path", "trim", "length", "mtime")))
    joined = images.join(kept, ["path", "trim"], "left")
    fresh = (F.col("length") == F.col("_length")) & (F.col("mtime") == F.col("_mtime"))
    for need, c in ((need_content, "content_hash"), (need_perceptual, "perceptual_hash")):
        fresh = fresh & (F.coalesce(c, F.lit(0)) != 0) if need else fresh
    return joined.withColumn("hit", F.coalesce(fresh, F.lit(False))).drop("_length", "_mtime")


def merged_cache(cache: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """The cache with fresh rows in place of old ones of the same path and trim."""
    stamped = fresh.withColumn("cached_at", now).select(*cache.columns)
    return cache.join(stamped.select("path", "trim"), ["path", "trim"], "left_anti").select(*cache.columns).unionByName(stamped)


def pruned(entries: DataFrame, now: Column, seconds: int = 3600, most: int = 10_000, at: str = "cached_at", name: str = "path") -> DataFrame:
    """Entries no older than seconds, and of those the newest `most` (ties: smaller name first)."""
    return entries.where(F.col(at) >= now - F.expr(f"INTERVAL {seconds} SECONDS")).orderBy(F.desc(at), name).limit(most)


def fingerprint(images: DataFrame, ordered: bool = False, job: str = "job") -> DataFrame:
    """job and the digest of its images' paths, lengths and times; their order counts only if ordered."""
    part = F.concat_ws("|", "path", "length", "mtime")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))), lambda s: s["p"]) if ordered else F.sort_array(F.collect_list(part))
    return images.groupBy(job).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("fingerprint"))


def signature(fingerprints: DataFrame, options: dict) -> DataFrame:
    """fingerprints with a signature that every option takes part in."""
    said = ";".join(f"{k}={options[k]}" for k in sorted(options))
    return fingerprints.withColumn("signature", F.sha2(F.concat_ws("|", "fingerprint", F.lit(said)), 256))


TRIMS = ("trim_left", "trim_top", "trim_right", "trim_bottom")


def reusable_seeds(sprites: DataFrame, seeds: DataFrame, padding: int = 0, job: str = "job") -> DataFrame:
    """Jobs whose stored layout fits their sprites exactly.

    That is: the same paths once each, equal sizes (turned, if rotated) and trims (0 where a table has
    none), and places at or right of and below 0 that do not overlap, padding included, if places are stored.
    """
    trim = lambda df, c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    own = sprites.select(job, "path", "w", "h", *(trim(sprites, c).alias(c) for c in TRIMS))
    turned_w, turned_h = (F.when(F.col("rotated"), F.col(b)).otherwise(F.col(a)) for a, b in (("w", "h"), ("h", "w")))
    stored = seeds.select(job, "path", turned_w.alias("_w"), turned_h.alias("_h"), *(trim(seeds, c).alias(f"_{c}") for c in TRIMS))
    both = own.join(stored, [job, "path"], "full_outer")
    fits = F.coalesce(reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_{c}") for c in ("w", "h", *TRIMS)]), F.lit(False))
    same = both.groupBy(job).agg(F.min(fits).alias("_all"), F.count("*").alias("_n"), F.count_distinct("path").alias("_d")).where("_all and _n = _d").select(job)
    if "x" not in seeds.columns:
        return same
    atlas = "atlas_index" if "atlas_index" in seeds.columns else F.lit(0).alias("atlas_index")
    places = seeds.select(job, atlas, "path", "x", "y", (F.col("w") + padding).alias("w"), (F.col("h") + padding).alias("h"))
    wrong = overlaps(places, keys=(job, "atlas_index"), name="path").select(job).unionByName(places.where("x < 0 or y < 0").select(job))
    return same.join(wrong.distinct(), job, "left_anti")


def stored_outputs(signed: DataFrame, stored: DataFrame, job: str = "job") -> DataFrame:
    """signed (job, signature) with `content` and `hit`: what an earlier run stored (signature, content, cached_at) under the signature, the newest."""
    newest = stored.groupBy("signature").agg(F.max_by("content", "cached_at").alias("content"))
    return signed.join(newest, "signature", "left").withColumn("hit", F.col("content").isNotNull())
