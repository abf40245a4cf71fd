"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Within a shard every vector gets one more coordinate that makes all lengths equal, so that the
largest inner product is the smallest Euclidean distance and the triangle inequality can prune.  A
branch is left out when the least distance it can hold, times `factor`, exceeds the distance of the
k-th best so far: factor one is exact search, larger ones look at less.

Rows are dealt to shards of `shard_rows` by their number, so that no frequent id or vector makes one
large, and each moves once.  Queries alone are replicated, to every shard.  A task reads a shard's
vectors, which sort first, builds its tree once and then answers the queries as they stream past, a
block at a time; of the best k of each shard Spark keeps the best k before it shuffles them.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part, and vectors of other lengths than the query's are not compared with
it; rows that share an id are candidates each, answered together as queries, and never each other's
neighbours; ties go to the smaller id; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table, trim

LEAF = 256
NOTHING = np.iinfo(np.int64).max


class Tree:
    """Vantage-point tree of the rows of x; searched for many queries at once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.leaf = ids[order], x[order], leaf
        norms = np.einsum("nd,nd->n", self.x, self.x)
        self.most = float(norms.max())
        self.lifted = np.column_stack((self.x, np.sqrt(np.maximum(self.most - norms, 0))))
        self.root = self.grow(np.arange(len(self.x)))

    def grow(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        y = self.lifted[rows]
        vantage = rows[np.argmax(((y - y.mean(axis=0)) ** 2).sum(axis=1))]  # far out, so that distances to it differ
        far = np.sqrt(((y - self.lifted[vantage]) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        bounds = far[inner[0]], far[inner[-1]], far[outer[0]], far[outer[-1]]
        return vantage, bounds, self.grow(np.sort(rows[inner])), self.grow(np.sort(rows[outer]))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for each query but its own; the places left over hold -inf."""
        self.own, self.q, self.k, self.factor = own, queries, k, factor
        self.base = np.einsum("nd,nd->n", queries, queries) + self.most  # a squared distance is this less twice the inner product
        self.size = 1 + float(np.abs(self.base).max())
        self.best = np.full((len(queries), k), -np.inf)
        self.names = np.full((len(queries), k), NOTHING)
        self.visit(self.root, np.arange(len(queries)))
        return self.best, self.names

    def visit(self, node: tuple, at: np.ndarray) -> None:
        if not len(at):
            return
        if len(node) == 1:
            self.scan(node[0], at)
            return
        vantage, (inner_low, inner_high, outer_low, outer_high), inner, outer = node
        far = np.sqrt(np.maximum(self.base[at] - 2 * (self.q[at] @ self.x[vantage]), 0))
        near_inner = far <= (inner_high + outer_low) / 2
        sides = ((inner, inner_low, inner_high), (outer, outer_low, outer_high))
        for first, second, chosen in ((0, 1, near_inner), (1, 0, ~near_inner)):
            if chosen.any():
                for side in (first, second):
                    branch, low, high = sides[side]
                    least = np.maximum(np.maximum(far[chosen] - high, low - far[chosen]), 0)
                    with np.errstate(invalid="ignore"):
                        reach = np.sqrt(np.maximum(self.base[at[chosen]] - 2 * self.best[at[chosen], -1], 0))
                    self.visit(branch, at[chosen][least * self.factor <= reach + 1e-9])

    def scan(self, rows: np.ndarray, at: np.ndarray) -> None:
        """Look at a leaf's rows for some queries.

        A fast product says, but for rounding, which rows can be among a query's best; only these
        are scored exactly.
        """
        rough, near = self.q[at] @ self.x[rows].T, 1e-9 * self.size
        rough[self.own[at][:, None] == self.ids[rows][None, :]] = -np.inf
        least = self.best[at, -1]
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(rough, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
        many = (rough >= (least - near)[:, None]).sum(axis=1)
        # Many may tie for the last places, as copies do; such queries look at the whole leaf.
        crowded = many > 2 * self.k
        for group, width in ((~crowded & (many > 0), int(many[~crowded].max(initial=0))), (crowded, len(rows))):
            if group.any():
                chosen = np.argpartition(-rough[group], width - 1, axis=1)[:, :width]
                self.merge(at[group], rows[chosen])

    def merge(self, at: np.ndarray, rows: np.ndarray) -> None:
        # Components are added one after another, wherever a pair stands, so that equal vectors tie exactly.
        scores = np.add.accumulate(self.q[at][:, None] * self.x[rows], axis=2)[:, :, -1]
        ids = self.ids[rows]
        scores[self.own[at][:, None] == ids] = -np.inf
        scores, ids = np.hstack((self.best[at], scores)), np.hstack((self.names[at], ids))
        ids[np.isneginf(scores)] = NOTHING
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.best[at] = np.take_along_axis(scores, order, axis=1)
        self.names[at] = np.take_along_axis(ids, order, axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("vector"))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, bool], np.ndarray, np.ndarray]]:
    """(dim, shard, asked), ids and vectors of each stretch of equal keys in a batch of (dim, shard, asked, vec_id, vector)."""
    dim, shard, asked = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    edges = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (asked[1:] != asked[:-1])) + 1
    for a, b in zip([0, *edges], [*edges, len(dim)], strict=True):
        ids = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)
        yield (int(dim[a]), int(shard[a]), bool(asked[a])), ids, batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 4.0, shard_rows: int = 16384, block_rows: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose id is divisible by `every`."""
    rows = usable(small_batches(vectors), id_col, vector_col)
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    there = rows.select("dim", shard.alias("shard"), F.lit(False).alias("asked"), "vec_id", "vector")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"), "vec_id", "vector")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree = None, [], None
        for batch in batches:
            for (dim, number, is_query), ids, x in runs(batch) if batch.num_rows else ():
                if key != (dim, number):
                    key, parts, tree = (dim, number), [], None
                if not is_query:
                    parts.append((ids, x))
                    continue
                if tree is None and parts:
                    tree, parts = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), []
                for at in range(0, len(ids) if tree else 0, block_rows):
                    own = ids[at : at + block_rows]
                    best, names = tree.search(own, x[at : at + block_rows], k, factor)
                    found = names != NOTHING
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, found.sum(axis=1))), pa.array(names[found]), pa.array(best[found])], schema=FOUND)
        del parts, tree
        trim()

    dealt = there.unionByName(asked).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asked")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: Exact search.  The relaxed one is to find all of it on tables of a few thousand vectors, where its trees are small.
OP6_SQL = """
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), usable AS (
  SELECT * FROM vectors
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
