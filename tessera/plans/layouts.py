"""Layout search over many jobs at once.

A job is a list of sprites that go into one layout, and there may be any number of jobs.  Candidates (a
width, an order, a method) are rows; they are packed in groups spread over all tasks, report only
their size, and Spark reduces them to the best of each job, whose placements alone are then made.  A
first pass gives each job a bound that the others must better.  Layouts of several atlases go by
rounds, an atlas of every job in each.  Grids need no search and are arithmetic on ranks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import next_power_of_two
from ..operators.kernels import HEURISTICS, Beyond, extent, guillotine, maxrects, shelf
from ..operators.relations import ORDERS, TRIMS, best_candidates, layout_stats, materialised, overlaps, ranked, written

#: Fixed values of the guided search: multiples of the step that are tried around each anchor.
OFFSETS = (0, -1, 1, -2, 2, -4, 4, -8, 8, -12, 12, -16, 16, -20, 20)
STEPS, LEAST_STEP = 24, 8
FIRST_PASS = 64  #: candidates with lower numbers are tried first; their best one bounds the rest
GUIDED_ORDERS = ("height", "area", "maxside", "none")
PLACED = "job long, seq long, atlas_index int, x int, y int, w int, h int, rotated boolean"


@dataclass(frozen=True)
class Limits:
    max_width: int = 4096
    max_height: int = 4096
    padding: int = 0
    extrude: int = 0
    rotate: bool = False
    order: str | None = None  #: name, none or one of ORDERS where the order is enforced
    stable: bool = False

    @property
    def gap(self) -> int:
        return max(self.padding, 2 * self.extrude)


def jobs(sprites: DataFrame) -> DataFrame:
    """A row per job: its sprites by seq, as arrays, with their ranks in natural path order."""
    rows = ranked(sprites.select("job", "seq", "path", "w", "h"), "name")
    return rows.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.col("rank").cast("int").alias("rank")))).alias("sprites"))


def in_order(sprites: list, order: str, stable: bool = False) -> list:
    """Sprites (seq, w, h, rank) in one of the orders."""
    size: dict[str, Callable] = {
        "height": lambda s: (-s["h"], -s["w"]),
        "width": lambda s: (-s["w"], -s["h"]),
        "area": lambda s: (-s["w"] * s["h"], -s["h"], -s["w"]),
        "maxside": lambda s: (-max(s["w"], s["h"]), -s["w"] * s["h"]),
        "perimeter": lambda s: (-s["w"] - s["h"], -s["w"] * s["h"]),
    }
    if order == "name":
        return sorted(sprites, key=lambda s: s["rank"])
    if order == "none":
        return sorted(sprites, key=lambda s: s["seq"])
    return sorted(sprites, key=lambda s: (*size[order](s), s["rank"] if stable else s["seq"]))


# Grids.


def grid(sprites: DataFrame, limits: Limits = Limits(), multipack: bool = False) -> DataFrame:  # noqa: B008
    """Placements of jobs whose sprites have one size: as square as the limits allow, or full atlases one after another.

    Jobs with several sizes, or without room, give no rows.
    """
    cells = sprites.groupBy("job").agg(F.count("*").alias("n"), F.min("w").alias("_w0"), F.max("w").alias("_w1"), F.min("h").alias("_h0"), F.max("h").alias("_h1")).where("_w0 = _w1 and _h0 = _h1")
    cells = cells.select("job", "n", (F.col("_w0") + limits.gap).alias("cw"), (F.col("_h0") + limits.gap).alias("ch"))
    cells = cells.where(F.col("cw").between(1, limits.max_width) & F.col("ch").between(1, limits.max_height))
    most, deep = F.floor(limits.max_width / F.col("cw")), F.floor(limits.max_height / F.col("ch"))
    if multipack:
        cells = cells.select("job", "cw", "ch", most.alias("cols"), (most * deep).alias("_each"))
    else:
        square = F.ceil(F.sqrt(F.col("n").cast("double")))
        # Widened until the rows fit: the least number of columns for the greatest number of rows.
        cols = F.least(F.greatest(F.least(square, most), F.ceil(F.col("n") / deep)), most)
        cells = cells.select("job", "cw", "ch", cols.alias("cols"), F.col("n").alias("_each"), deep.alias("_deep")).where(F.ceil(F.col("_each") / F.col("cols")) <= F.col("_deep")).drop("_deep")
    order = limits.order or "none"
    rows = ranked(sprites, order, limits.stable).join(cells, "job").withColumn("_k", F.col("rank") - 1).withColumn("_at", F.col("_k") % F.col("_each"))
    return rows.select("job", "seq", F.floor(F.col("_k") / F.col("_each")).cast("int").alias("atlas_index"), (F.col("_at") % F.col("cols") * F.col("cw")).cast("int").alias("x"), (F.floor(F.col("_at") / F.col("cols")) * F.col("ch")).cast("int").alias("y"), "w", "h", F.lit(False).alias("rotated"))


# Candidates.


def bounds(sprites: DataFrame, limits: Limits) -> DataFrame:
    """job, least (the widest sprite), most and root (the side of a square of the sprites' area, between them)."""
    stats = layout_stats(sprites, limits.gap)
    most = F.least(F.col("sum_w"), F.lit(limits.max_width))
    least = F.col("max_w")
    root = F.greatest(F.least(F.ceil(F.sqrt(F.col("area").cast("double"))), most), least)
    return stats.where(least <= most).select("job", "n", "area", least.alias("least"), most.alias("most"), root.alias("root"))


def seed_width(hint: Column | None = None) -> Column:
    """The width of the first pass: that of an earlier layout, if there is one between the least and the most, or else the square root."""
    root = F.col("root")
    return root if hint is None else F.coalesce(F.when(hint.between(F.col("least"), F.col("most")), hint), root)


def guided_widths(hint: Column | None = None) -> Column:
    """The widths worth a try, ascending: around the first pass's width, the square root, the least and the most."""
    least, most, root, seed = F.col("least"), F.col("most"), F.col("root"), seed_width(hint)
    step = F.greatest(F.lit(LEAST_STEP), F.floor((most - root) / STEPS))
    tried = F.array(seed, root, *(a + step * m for a in (seed, root, least, most) for m in OFFSETS))
    return F.array_sort(F.array_distinct(F.filter(tried, lambda w: (w >= least) & (w <= most))))


def compact_candidates(sized: DataFrame, limits: Limits, hints: DataFrame | None = None) -> DataFrame:
    """job, cand, width, order, method: all orders at the seed width, then the guided ones and a shelf at every width.

    hints (job, hint) are widths of earlier layouts, which come first and around which is tried too.
    cand is the order in which one thread would try them, which settles ties; those below FIRST_PASS
    are the first pass.
    """
    orders = (*ORDERS, "none") if limits.order is None else (limits.order,)
    guided = GUIDED_ORDERS if limits.order is None else (limits.order,)
    tries = lambda names, methods: F.array(*(F.struct(F.lit(o).alias("order"), F.lit(m).alias("method")) for o in names for m in methods))
    rows, hint = (sized, None) if hints is None else (sized.join(hints, "job", "left"), F.col("hint"))
    rows = rows.withColumns({"_widths": guided_widths(hint), "_seed": seed_width(hint)})
    first = rows.select("job", F.lit(0).alias("_at"), F.col("_seed").alias("width"), F.posexplode(tries(orders, HEURISTICS)).alias("_k", "_t"))
    rest = rows.select("job", F.posexplode("_widths").alias("_at", "width")).select("job", F.col("_at") + 1, "width", F.posexplode(tries(guided, (*HEURISTICS, "shelf"))).alias("_k", "_t"))
    return first.union(rest).select("job", (F.col("_at") * FIRST_PASS + F.col("_k")).cast("long").alias("cand"), F.col("width").cast("int").alias("width"), "_t.order", "_t.method")


def pot_candidates(sized: DataFrame, limits: Limits) -> DataFrame:
    """Powers of two for both sides within the limits, in all orders, guillotine cuts; smallest areas first."""
    sides = [1 << k for k in range(31)]
    widths = [s for s in sides if s <= limits.max_width]
    heights = [s for s in sides if s <= limits.max_height]
    orders = (*ORDERS, "none") if limits.order is None else (limits.order,)
    shapes = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in sorted(((w, h) for w in widths for h in heights), key=lambda s: (s[0] * s[1], s))))
    # Nothing above four times the area's square can be the smallest that fits.
    enough = lambda s: (s["width"].cast("long") * s["height"] >= F.col("area")) & (s["width"] >= F.col("least"))
    rows = sized.select("job", F.posexplode(F.filter(shapes, enough)).alias("_at", "_s"))
    tries = F.array(*(F.lit(o) for o in orders))
    return rows.select("job", "_at", "_s.*", F.posexplode(tries).alias("_k", "order")).select("job", (F.col("_at") * 8 + F.col("_k")).cast("long").alias("cand"), "width", "height", "order", F.lit("guillotine").alias("method"))


def pack_one(ordered: list, boxes: list, cand: dict, limits: Limits, beyond: Beyond | None = None) -> list | None:
    """The places that one candidate gives the boxes of ordered sprites; None if they don't fit, or go beyond what is wanted."""
    if cand["method"] == "shelf":
        return shelf(boxes, cand["width"], limits.rotate, beyond)
    if cand["method"] == "guillotine":
        return guillotine(boxes, cand["width"], cand["height"], limits.rotate)
    return maxrects(boxes, cand["width"], limits.max_height, cand["method"], limits.rotate, beyond=beyond)


def boxed(sprites: list, order: str, limits: Limits) -> tuple[list, list]:
    ordered = in_order(sprites, order, limits.stable)
    return ordered, [(s["w"] + limits.gap, s["h"] + limits.gap) for s in ordered]


#: What a finished or growing atlas is judged by, smallest first; the first two never fall while boxes are placed.
JUDGED: dict[str, Callable[[int, int], tuple]] = {
    "gpu": lambda w, h: (max(w, h), w * h, abs(w - h), w),
    "space": lambda w, h: (w * h, max(w, h), abs(w - h), w),
}


TRIED = "job long, cand long, at_width int, at_height int, order string, method string, width int, height int, packings int, given_up int"


def tried(job_rows: DataFrame, candidates: DataFrame, limits: Limits, goal: str, bound: DataFrame | None = None, each: int = 1 << 14) -> DataFrame:
    """The best of each chunk of candidates, with the width and height it came to, and how many packings were begun and given up.

    A candidate is given up once its atlas is no better than one of the chunk before it or than the job's
    bound (job, bound_width, bound_height), if there is one; only what is better than the bound is told.
    A chunk without a better one has nulls.  A chunk places about `each` sprites in all, 64 candidates at least; its
    rows are made Python's one by one, so that a task holds one chunk however many come in a batch.
    """
    fields = ["cand", "width", *(["height"] if "height" in candidates.columns else []), "order", "method"]
    listed = candidates.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all"))
    known = job_rows if bound is None else job_rows.join(bound, "job", "left")
    sides = [F.coalesce(F.col(c), F.lit(0)).alias(c) if bound is not None else F.lit(0).alias(c) for c in ("bound_width", "bound_height")]
    many = F.greatest(F.lit(64), F.floor(F.lit(each) / F.size("sprites"))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / F.col("_many")).cast("int")), lambda k: F.slice("_all", k * F.col("_many") + 1, F.col("_many")))
    work = spread(known.join(listed, "job").withColumn("_many", many).select("job", "sprites", *sides, F.explode(chunks).alias("cands")))
    judged = JUDGED[goal]

    def best_of(sprites: list, cands: list, wide: int, tall: int) -> tuple:
        best, rank, orders, begun, ended = None, judged(wide, tall) if wide else None, {}, 0, 0
        # Sides only grow: a growing atlas as good as the best one is it, or gets worse.
        beyond = lambda w, h: rank is not None and judged(w, h) >= rank
        for cand in cands:
            if cand["order"] not in orders:
                orders[cand["order"]] = boxed(sprites, cand["order"], limits)[1]
            boxes = orders[cand["order"]]
            begun += 1
            spots = pack_one(sprites, boxes, cand, limits, beyond)
            if spots:
                ended += 1
                w, h = (cand["width"], cand["height"]) if cand["method"] == "guillotine" else extent(boxes, spots)
                if h <= limits.max_height and (rank is None or judged(w, h) < rank):
                    rank, best = judged(w, h), (cand["cand"], cand["width"], cand["height"] if "height" in fields else None, cand["order"], cand["method"], w, h)
        return (*(best or [None] * 7), begun, begun - ended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                job, sprites, wide, tall, cands = (batch[c][k].as_py() for c in ("job", "sprites", "bound_width", "bound_height", "cands"))
                out.append((job, *best_of(sprites, cands, wide, tall)))
            yield as_batch(out, TRIED)

    return work.mapInArrow(run, TRIED)


def spread(work: DataFrame) -> DataFrame:
    """Rows of much work each, dealt to tasks by their number: AQE would put few small rows into one."""
    return work.repartition(work.sparkSession.sparkContext.defaultParallelism * 4)


def placed(job_rows: DataFrame, best: DataFrame, limits: Limits) -> DataFrame:
    """The placements of each job's best candidate; one job at a time is made Python's."""
    fields = ("job", "sprites", "at_width", "at_height", "order", "method")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                job, sprites, width, height, order, method = (batch[c][k].as_py() for c in fields)
                ordered, boxes = boxed(sprites, order, limits)
                spots = pack_one(ordered, boxes, {"width": width, "height": height, "method": method}, limits)
                rows = [(job, s["seq"], 0, x, y, *((s["h"], s["w"]) if turned else (s["w"], s["h"])), turned) for s, (x, y, turned) in zip(ordered, spots, strict=True)]
                yield as_batch(rows, PLACED)

    return job_rows.join(best, "job").select(*fields).mapInArrow(run, PLACED)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of a schema in Spark's notation."""
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def hopeful(candidates: DataFrame, bound: DataFrame, sized: DataFrame, goal: str) -> DataFrame:
    """The candidates that may still come to less than the job's bound.

    An atlas is at least as wide as the widest sprite and, with all sprites in it, as high as their area
    over the candidate's width; where a power of two is asked for, its sides are known beforehand.
    """
    c = F.col
    rows = candidates.join(sized.select("job", "area", "least"), "job").join(bound, "job", "left")
    wide, tall = (c("width"), c("height")) if "height" in candidates.columns else (F.least(c("least"), c("width")), F.ceil(c("area") / c("width")))
    side, area = F.greatest(wide, tall), F.greatest(wide.cast("long") * tall, c("area"))
    most_side, most_area = F.greatest(c("bound_width"), c("bound_height")), c("bound_width").cast("long") * c("bound_height")
    first, most = ((side, area), (most_side, most_area)) if goal == "gpu" else ((area, side), (most_area, most_side))
    worse = (first[0] > most[0]) | ((first[0] == most[0]) & (first[1] > most[1]))
    return rows.where(~F.coalesce(worse, F.lit(False))).select(*candidates.columns)


def searched(sprites: DataFrame, candidates: Callable[[DataFrame, Limits], DataFrame], limits: Limits, goal: str) -> tuple[DataFrame, DataFrame]:
    """The placements of each job's best candidate, and what the search took: job, candidates, packings and given_up.

    The first pass is reduced to one bound for each job before the rest is tried; the rest leaves out
    what can't be smaller, and stops where it no longer can be.
    """
    rows, sized = materialised(jobs(sprites)), materialised(bounds(sprites, limits))
    every = candidates(sized, limits)
    first = materialised(tried(rows, every.where(F.col("cand") < FIRST_PASS), limits, goal))
    bound = best_candidates(first, goal).select("job", F.col("width").alias("bound_width"), F.col("height").alias("bound_height"))
    rest = materialised(tried(rows, hopeful(every.where(F.col("cand") >= FIRST_PASS), bound, sized, goal), limits, goal, bound))
    both = first.unionByName(rest)
    effort = every.groupBy("job").agg(F.count("*").alias("candidates")).join(both.groupBy("job").agg(F.sum("packings").alias("packings"), F.sum("given_up").alias("given_up")), "job")
    return placed(rows, best_candidates(both, goal), limits), effort


def compact(sprites: DataFrame, limits: Limits = Limits(), goal: str = "gpu", hints: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """The best of many packings into one atlas per job."""
    return searched(sprites, lambda sized, own: compact_candidates(sized, own, hints), limits, goal)[0]


def power_of_two(sprites: DataFrame, limits: Limits = Limits(), goal: str = "gpu") -> DataFrame:  # noqa: B008
    """The best atlas per job whose sides are powers of two."""
    return searched(sprites, pot_candidates, limits, goal)[0]


def each_job(sprites: DataFrame, place: Callable[[list], list[tuple]], extra: DataFrame | None = None) -> DataFrame:
    """Placements (seq, atlas_index, x, y, w, h, rotated) that `place` makes of each job's sprites (and its extra column)."""
    rows = jobs(sprites)
    more = extra is not None
    rows = rows.join(extra, "job", "left") if more else rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                out += [(row["job"], *p) for p in place(list(row["sprites"]), *((row["extra"],) if more else ()))]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PLACED.split(", ")])

    return rows.mapInPandas(run, PLACED)


def laid(ordered: list, spots: list, atlas: int = 0) -> list[tuple]:
    return [(s["seq"], atlas, p[0], p[1], *((s["h"], s["w"]) if p[2] else (s["w"], s["h"])), p[2]) for s, p in zip(ordered, spots, strict=True) if p]


def fast(sprites: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Shelves at the least width, from the square root up, whose rows fit the height."""

    def place(found: list) -> list[tuple]:
        ordered = in_order(found, limits.order or "height", limits.stable)
        boxes = [(s["w"] + limits.gap, s["h"] + limits.gap) for s in ordered]
        most, least = min(sum(w for w, _ in boxes), limits.max_width), max(w for w, _ in boxes)
        root = _root(sum(w * h for w, h in boxes))
        for width in range(min(max(root, least), most), most + 1):
            spots = shelf(boxes, width, limits.rotate)
            if spots and extent(boxes, spots)[1] <= limits.max_height:
                return laid(ordered, spots)
        return []

    return each_job(sprites, place)


def _root(area: int) -> int:
    from math import isqrt

    return isqrt(area - 1) + 1 if area > 0 else 0


def around(limits: Limits, pot: bool) -> Column:
    """The widths that are tried for the sprites left (an array column), ascending."""
    least = F.array_min(F.transform("sprites", lambda s: F.least(s["w"], s["h"]) if limits.rotate else s["w"])) + limits.gap
    area = F.aggregate("sprites", F.lit(0).cast("long"), lambda n, s: n + s["w"].cast("long") * s["h"])
    step = F.greatest(F.lit(LEAST_STEP), F.floor((limits.max_width - least) / STEPS).cast("int"))
    tries = F.array(least, F.lit(limits.max_width), F.ceil(F.sqrt(area.cast("double"))).cast("int"), *(least + m * step for m in OFFSETS))
    widths = F.filter(tries, lambda w: (w >= least) & (w <= limits.max_width))
    if pot:
        widths = F.filter(F.transform(widths, lambda w: next_power_of_two(w).cast("int")), lambda w: w <= limits.max_width)
    return F.array_sort(F.array_distinct(widths))


PARTIAL = "job long, cand long, order string, at_width int, method string, width int, height int, packed int, packed_area long"
STATE = "job long, atlas_index int, placed array<struct<seq:long,x:int,y:int,w:int,h:int,rotated:boolean>>, sprites array<struct<seq:long,w:int,h:int,rank:int>>"


def fullest(open_jobs: DataFrame, limits: Limits, goal: str, pot: bool) -> DataFrame:
    """The best partial packing of each chunk of candidates of each open job; a chunk has fewer of them the more sprites there are."""
    orders = F.array(*map(F.lit, (*ORDERS, "none") if limits.order is None else (limits.order,)))
    tries = F.flatten(F.transform(orders, lambda o: F.flatten(F.transform("_widths", lambda w: F.array(*(F.struct(o.alias("order"), w.alias("width"), F.lit(m).alias("method")) for m in HEURISTICS))))))
    rows = open_jobs.withColumn("_widths", around(limits, pot)).withColumns({"_all": tries, "_each": F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.lit(1 << 14) / F.size("sprites")))).cast("int")}).where(F.size("_all") > 0)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / F.col("_each")).cast("int")), lambda k: F.slice("_all", k * F.col("_each") + 1, F.col("_each")))
    work = spread(rows.select("job", "sprites", "_each", F.posexplode(chunks).alias("_chunk", "cands")))

    def best_of(sprites: list, cands: list, first: int) -> tuple | None:
        best, orders, total = None, {}, sum(s["w"] * s["h"] for s in sprites)
        sign = 1 if goal == "gpu" else -1
        for k, cand in enumerate(cands):
            if cand["order"] not in orders:
                orders[cand["order"]] = boxed(sprites, cand["order"], limits)
            ordered, boxes = orders[cand["order"]]
            areas = [s["w"] * s["h"] for s in ordered]
            # Whether too much has found no room for the rest to make up for it.
            lost = (lambda n, area: (len(sprites) - n, total - area)[::sign] < best[0][:2]) if best else None  # noqa: B023
            spots = maxrects(boxes, cand["width"], limits.max_height, cand["method"], limits.rotate, partial=True, lost=lost, worth=areas)
            if spots is None:
                continue
            n, area = sum(p is not None for p in spots), sum(a for a, p in zip(areas, spots, strict=True) if p)
            w, h = extent(boxes, spots)
            rank = (*(n, area)[::sign], *(-x for x in JUDGED[goal](w, h)))
            if n and (best is None or rank > best[0]):
                best = rank, (first + k, cand["order"], cand["width"], cand["method"], w, h, n, area)
        return best and best[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(job, best_of(list(sprites), cands, chunk * each)) for job, sprites, each, chunk, cands in zip(*(frame[c] for c in ("job", "sprites", "_each", "_chunk", "cands")), strict=True)]
            yield pd.DataFrame([(job, *best) for job, best in found if best], columns=[f.split()[0] for f in PARTIAL.split(", ")])

    return work.mapInPandas(run, PARTIAL)


def filled(open_jobs: DataFrame, best: DataFrame, limits: Limits, atlas: int) -> DataFrame:
    """What the best packing places of each open job, and the sprites it leaves; both null where there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                sprites = list(row["sprites"])
                if row["order"] is None:
                    out.append((row["job"], atlas, None, None))
                    continue
                ordered, boxes = boxed(sprites, row["order"], limits)
                spots = maxrects(boxes, int(row["at_width"]), limits.max_height, row["method"], limits.rotate, partial=True)
                places = [dict(zip(("seq", "x", "y", "w", "h", "rotated"), (p[0], *p[2:]), strict=True)) for p in laid(ordered, spots)]
                done = {p["seq"] for p in places}
                out.append((row["job"], atlas, places, [s for s in sprites if s["seq"] not in done]))
            yield pd.DataFrame(out, columns=["job", "atlas_index", "placed", "sprites"])

    return spread(open_jobs.join(best.select("job", "order", "at_width", "method"), "job", "left")).mapInPandas(run, STATE)


def multipack(sprites: DataFrame, limits: Limits = Limits(), goal: str = "gpu", pot: bool = False) -> DataFrame:  # noqa: B008
    """As many atlases per job as it takes; each is the best of partial packings of what is left.

    Best for gpu: most sprites, then most of their area, then the smaller atlas; for space the area comes
    first.  A round fills one atlas of every job that has sprites left: its candidates are rows, spread
    over all tasks however large a job is, and what is left is written for the next round.
    """
    left, out, atlas = materialised(jobs(sprites)), [], 0
    folder = f"{sprites.sparkSession.sparkContext.getCheckpointDir()}/multipack-{uuid.uuid4().hex}"
    while not left.isEmpty():
        best = best_candidates(fullest(left, limits, goal, pot), f"multipack_{goal}")
        state = written(filled(left, best, limits, atlas), f"{folder}/{atlas}")
        out.append(state)
        left, atlas = state.where(F.size("sprites") > 0).select("job", "sprites"), atlas + 1
    if not out:
        return each_job(sprites, lambda found: [])
    every = reduce(DataFrame.unionByName, out)
    failed = every.where("placed is null").select("job").distinct()  # a sprite fits no atlas: the job has no layout
    rows = every.where("placed is not null").join(failed, "job", "left_anti").select("job", "atlas_index", F.explode("placed").alias("_p"))
    return rows.select("job", "_p.seq", "atlas_index", "_p.x", "_p.y", "_p.w", "_p.h", "_p.rotated")


def incremental(sprites: DataFrame, previous: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Sprites with an earlier place (previous: job, path, x, y, w, h, rotated) stay there; the rest goes into the room left.

    They are matched by path; a place counts if it is not left of or above 0 and size and trims (0 where a
    table has none) are as before.  A job of which nothing stays, whose places overlap or go beyond the limits, or whose
    other sprites find no room, gives no rows: it needs a fresh search.
    """
    trim = lambda df, c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    known = F.struct(*("x", "y", "w", "h", "rotated"), *(trim(previous, c).alias(c) for c in TRIMS))
    by = F.min_by(known, "seq") if "seq" in previous.columns else F.first(known)
    old = previous.groupBy("job", "path").agg(by.alias("_p"))
    own = sprites.select("job", F.col("seq").cast("long").alias("seq"), "path", "w", "h", *(trim(sprites, c).alias(c) for c in TRIMS))
    turned_w, turned_h = (F.when(F.col("_p.rotated"), F.col(f"_p.{b}")).otherwise(F.col(f"_p.{a}")) for a, b in (("w", "h"), ("h", "w")))
    same = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_p.{c}") for c in TRIMS], (F.col("w") == turned_w) & (F.col("h") == turned_h))
    fits = F.col("_p").isNotNull() & (F.col("_p.x") >= 0) & (F.col("_p.y") >= 0)
    pinned = materialised(own.join(old, ["job", "path"]).where(fits & same).select("job", "seq", "_p.x", "_p.y", "_p.w", "_p.h", "_p.rotated"))
    padded = pinned.withColumns({c: F.col(c) + limits.gap for c in "wh"})
    outside = padded.where((F.col("x") + F.col("w") > limits.max_width) | (F.col("y") + F.col("h") > limits.max_height))
    wrong = overlaps(padded, keys=("job",)).select("job").unionByName(outside.select("job")).distinct()
    kept = pinned.join(wrong, "job", "left_anti").groupBy("job").agg(F.collect_list(F.struct("seq", "x", "y", "w", "h", "rotated")).alias("extra"))

    def place(found: list, earlier: list) -> list[tuple]:
        pinned = {p["seq"] for p in earlier}
        fresh = in_order([s for s in found if s["seq"] not in pinned], "area")
        taken = [(p["x"], p["y"], p["w"] + limits.gap, p["h"] + limits.gap) for p in earlier]
        spots = maxrects([(s["w"] + limits.gap, s["h"] + limits.gap) for s in fresh], limits.max_width, limits.max_height, "short_side", limits.rotate, taken=taken)
        if spots is None:
            return []
        return [(p["seq"], 0, p["x"], p["y"], p["w"], p["h"], bool(p["rotated"])) for p in earlier] + laid(fresh, spots)

    return each_job(sprites.join(kept.select("job"), "job", "left_semi"), place, kept)
