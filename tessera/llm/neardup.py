"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's set is its distinct shingles of five words.  Equal sets are one class, so that exact
copies never meet in pairs.  A class's sketch is a HyperMinHash: shingle hashes are dealt to 256
buckets, and a bucket stores the leading zeros of its least hash and the ten bits after them; a
bucket that stays empty borrows from a filled one chosen by fixed priorities.  Bands of six
registers make LSH buckets (a pair at similarity 0.85 shares one of the 42 but for 3 in 10^9).

In each LSH bucket members are first held against the first one, the hub, only.  Pairs whose
Jaccard estimate, corrected for registers that agree by chance, leaves the wanted similarity possible
are confirmed on their full sets, and confirmed links are joined into components.  In buckets that
still hold several components, the members of different ones are then held against each other in the
same way, in blocks of bounded size; so no link between different sets is lost, and copies of one
text never expand into all pairs.

Classes have numbers of their own, so that ids which are repeated with different texts stay apart.
A hub with many candidates meets them in salted parts, and what is summed up by a key is written
before it is joined by that key, so that Spark can split whatever key is frequent.

Defined results: a text without words (null, empty or blank) has an empty set and links with nothing;
with fewer than five words the whole sequence is one shingle; repeated rows fall into one class and
each returns the same; each text of a repeated id has its own links, and its row names its own
component; rows without an id are linked, but name a component only where nothing else does (the
component's id is null then); other columns are ignored (`deduplicated` keeps them); an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, release, remove, stored, table, text_frame, use_checkpoint_dir

WORDS = 5
REGISTERS, MANTISSA, EMPTY = 256, 10, 0xFFFF
HELD = 1024  #: bits of the map of hashes in the marks
BANDS, ROWS = 42, 6
CACHED = 150_000
#: A side with at most so many rows of three longs is broadcast (about 50 MB); beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
PER_HUB = 256  #: candidates that meet a hub in one part
BLOCK = 1024  #: members of an LSH bucket that meet in one part

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PRIORITY = _rng.random((REGISTERS, REGISTERS), dtype=np.float32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    found = text.lower().split()  # on bytes: A-Z only, and the ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += mixed(h[k : k + n] * _FACTORS[k])
    return np.unique(mixed(total))


def sketch(found: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set of hashes: leading zeros and mantissa of the least hash in each bucket."""
    least = np.full(REGISTERS, 1 << 53, np.uint64)
    np.minimum.at(least, (found & np.uint64(REGISTERS - 1)).astype(np.int64), found >> np.uint64(11))
    filled = least < (1 << 53)
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # exact below 2^53
    zeros = 53 - exponent
    mantissa = (least.astype(np.int64) << zeros.clip(min=0)) >> (52 - MANTISSA) & (1 << MANTISSA) - 1
    registers = np.where(filled, zeros << MANTISSA | mantissa, EMPTY).astype(np.uint16)
    if not filled.all() and filled.any():
        own = np.flatnonzero(filled)
        registers[~filled] = registers[own[_PRIORITY[~filled][:, own].argmin(axis=1)]]
    return registers


def marks(found: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """Longs: four say which buckets are filled, four have the last bit of their registers, the rest a bit for each value of some bits of the hashes."""
    filled, held = np.zeros(REGISTERS, np.uint8), np.zeros(HELD, np.uint8)
    filled[(found & np.uint64(REGISTERS - 1)).astype(np.int64)] = 1
    held[(found >> np.uint64(40)).astype(np.int64) % HELD] = 1
    return np.packbits(np.concatenate((filled, (registers & 1).astype(np.uint8) & filled, held))).view(np.int64)


def band_keys(registers: np.ndarray) -> np.ndarray:
    rows = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    total = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None, :].repeat(len(rows), axis=0)
    for k in range(ROWS):
        total = mixed(total + rows[:, :, k] * _FACTORS[8 + k])
    return total.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches.

    Different minima still agree when both fall into one cell of the register; with exponential
    minima of rates p and q that has the probability 2^-mantissa / (2 ln 2) * pq / (p + q)^2.
    """
    agree = (a == b).mean(axis=1)
    chance = 2.0**-MANTISSA / (2 * np.log(2)) * size_a * size_b / (size_a + size_b) ** 2
    return (agree - chance) / (1 - chance)


KEY, KEY_SQL = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64())]), "struct<doc_id:long,text_hash:long>"


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text) of a text_frame; the key also holds the text's hash, for ids may be repeated."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (128 bits that name the set), registers and marks of every row of a text_frame."""

    def each(keys: list, texts: list[bytes], hashes: WordHashes) -> dict:
        out: dict = {k: [] for k in ("n_shingles", "set_a", "set_b", "registers", "marks")}
        for text in texts:
            found = shingles(text, hashes)
            name = xxhash.xxh3_128_intdigest(found.tobytes())
            out["n_shingles"].append(len(found))
            out["set_a"].append((name >> 64) - (1 << 63))
            out["set_b"].append((name & (1 << 64) - 1) - (1 << 63))
            registers = sketch(found) if len(found) else None
            out["registers"].append(None if registers is None else registers.tobytes())
            out["marks"].append(None if registers is None else marks(found, registers))
        return {"key": keys, **out}

    fields = [("key", KEY), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("registers", pa.binary()), ("marks", pa.list_(pa.int64()))]
    made = map_texts(keyed(docs), each, f"key {KEY_SQL}, n_shingles long, set_a long, set_b long, registers binary, marks array<long>", pa.schema(fields), WordHashes)
    return made.select("key.*", *(name for name, _ in fields[1:]))


def bands():  # noqa: ANN201
    """The LSH buckets of a sketch."""

    @F.pandas_udf("array<long>")
    def keys(registers: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(np.frombuffer(b"".join(registers), np.uint16).reshape(-1, REGISTERS))))

    return keys


def possible(percent: int):  # noqa: ANN201
    """Whether a pair may reach the similarity, by its sketches: five standard deviations are allowed for."""

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        m, n = size_a.to_numpy(np.float64), size_b.to_numpy(np.float64)
        t = percent / 100
        slack = 5 * np.sqrt(t * (1 - t) * (1 / REGISTERS + 1 / np.maximum(m, n)))
        return pd.Series(estimate(x, y, m, n) >= t - slack)

    return test


def alike(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether two rows of marks leave the similarity possible; part of the join, so that pairs that can't be similar are never made.

    Each bit in which the maps of hashes differ stands for a shingle of one set only, and similar
    sets have at most (1 - t) / (1 + t) of their sizes' sum of these; this never fails.  Of the
    buckets filled in either, those filled in one only differ, and of those filled in both a
    differing register shows in its last bit half of the time, so those count twice; here five
    standard deviations are allowed for.
    """
    total = lambda f, words: reduce(lambda p, q: p + q, [F.bit_count(f(k)) for k in words])
    either = total(lambda k: a[k].bitwiseOR(b[k]), range(4))
    one = total(lambda k: a[k].bitwiseXOR(b[k]), range(4))
    both = total(lambda k: a[k].bitwiseXOR(b[k]).bitwiseAND(a[k - 4].bitwiseAND(b[k - 4])), range(4, 8))
    apart = total(lambda k: a[k].bitwiseXOR(b[k]), range(8, 8 + HELD // 64))
    t = percent / 100
    return (apart * (100 + percent) <= (size_a + size_b) * (100 - percent)) & (one + 2 * both <= (1 - t) * either + 5 * F.sqrt(either * (t * (1 - t) + 1 - t)))


def confirmed(percent: int):  # noqa: ANN201
    """Whether 100 * intersection >= percent * union on the full sets; rows come sorted by the second text."""

    @F.pandas_udf("boolean")
    def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes, last, other = WordHashes(), None, None
        for first, second in batches:
            out = []
            for a, b in zip(first, second, strict=True):
                if b != last:
                    last, other = b, shingles(b.encode(), hashes)
                mine = shingles(a.encode(), hashes)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                out.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pd.Series(out, dtype=bool)

    return test


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node of the edges.

    In each round a node takes the smallest label among its neighbours' and its own label's; it is one
    join and one sum, written to the checkpoint folder.  It ends when a round changes nothing.
    """
    spark = edges.sparkSession
    use_checkpoint_dir(spark)
    folder, turn = f"{spark.sparkContext.getCheckpointDir()}/components-{uuid.uuid4().hex}", 0
    ends = lambda x, y: edges.select(F.col(x).alias("node"), F.col(y).alias("near"))
    near = stored(ends(a, b).unionByName(ends(b, a)).unionByName(ends(a, a)).unionByName(ends(b, b)).distinct(), f"{folder}/near")
    labels = stored(near.groupBy("node").agg(F.min("near").alias("component")), f"{folder}/0")
    while True:
        asked = near.unionByName(labels.where("component <> node").select("node", F.col("component").alias("near")))
        told = asked.join(labels.select(F.col("node").alias("near"), F.col("component").alias("_label")), "near")
        own = F.max(F.when(F.col("near") == F.col("node"), F.col("_label")))
        moved = stored(told.groupBy("node").agg(F.min("_label").alias("component"), own.alias("_was")), f"{folder}/{turn + 1}")
        labels = moved.select("node", "component")
        remove(spark, f"{folder}/{turn}")
        turn += 1
        release(spark)
        if moved.where("component <> _was").isEmpty():
            return labels


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """class and text, once for each of the classes in ids."""
    wanted = cut(ids.distinct().join(classes.select("class", "first"), "class").select("class", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = docs.join(wanted, (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return cut(found.groupBy("class").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those whose full sets are similar enough; b may be a hub of any number of pairs."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"_n{x}"), F.col("registers").alias(f"_r{x}"))
    sized = F.expr(f"100 * least(_na, _nb) >= {percent} * greatest(_na, _nb)")
    likely = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(sized).where(possible(percent)("_ra", "_rb", "_na", "_nb")).select("a", "b"))
    texts = texts_of(likely.select(F.col("a").alias("class")).unionByName(likely.select(F.col("b").alias("class"))), classes, docs)
    crowded = cut(likely.groupBy("b").agg(F.count("*").alias("_n")).where(F.col("_n") > PER_HUB).select("b", F.ceil(F.col("_n") / PER_HUB).alias("_parts")))
    dealt = cut(likely.join(crowded, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("_parts", F.lit(1))).alias("part")))
    with_a = dealt.join(texts.select(F.col("class").alias("a"), F.col("text").alias("_ta")), "a")
    hubs = dealt.select("b", "part").distinct().join(texts.select(F.col("class").alias("b"), F.col("text").alias("_tb")), "b")
    found = cut(with_a.join(hubs, ["b", "part"]).where(confirmed(percent)("_ta", "_tb")).select("a", "b"))
    release(docs.sparkSession)
    return found


def apart(shared: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes that share an LSH bucket, lie in different components and may be similar."""
    placed = shared.join(labels.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", F.coalesce("component", "class").alias("component"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n")).where("_low < _high")
    mixed_buckets = cut(mixed_buckets.select("bucket", F.ceil(F.col("_n") / BLOCK).alias("_parts")))
    members = placed.join(mixed_buckets, "bucket").withColumn("part", F.pmod(F.xxhash64("class"), "_parts")).withColumn("_other", F.explode(F.expr("sequence(0L, _parts - 1)")))
    members = members.select("bucket", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "part", "class", "component")
    members = cut(members.join(classes.select("class", "n_shingles", "marks"), "class"))
    x, y = members.alias("x"), members.alias("y")
    met = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("bucket", "low", "high")])
    once = (F.col("x.class") > F.col("y.class")) & ((F.col("x.low") == F.col("x.high")) | (F.col("x.part") != F.col("y.part")))
    sized = F.expr(f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)")
    may = alike(F.col("x.marks"), F.col("y.marks"), F.col("x.n_shingles"), F.col("y.n_shingles"), percent)
    return x.join(y, met & once & (F.col("x.component") != F.col("y.component")) & sized & may).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles and head of every row of a text_frame.

    head (no_id, doc_id, text_hash) is the first text of the row's component by id; null for an empty set.
    """
    release(docs.sparkSession)
    made, name = cut(sketches(docs)), ["set_a", "set_b"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = made.where("n_shingles > 0").groupBy(*name).agg(first.alias("first"), *(F.first(c).alias(c) for c in ("n_shingles", "registers", "marks")))
    # Numbers follow the ids: copies tend to come after what they were made of, so the first class of a
    # bucket, its hub, is likely to be near most of it, and labels that fall to the smallest soon settle.
    classes = cut(classes.orderBy("first").withColumn("class", F.monotonically_increasing_id()))

    banded = classes.select("class", F.explode(bands()("registers")).alias("bucket"))
    hubs = cut(banded.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("_most")).where("hub < _most").select("bucket", "hub"))
    shared = cut(banded.join(hubs, "bucket"))
    tried = cut(shared.where("class > hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct())
    release(docs.sparkSession)
    links = verified(tried, classes, docs, percent)
    labels = components(links)
    # Buckets that still hold several components: their members across components, once each.
    rest = cut(apart(shared.select("bucket", "class"), classes, labels, percent).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = verified(rest, classes, docs, percent)
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    led = labels.join(classes.select(F.col("class").alias("node"), "first"), "node")
    heads = cut(led.groupBy("component").agg(F.min("first").alias("head")))
    release(docs.sparkSession)
    led = labels.join(heads, "component").select(F.col("node").alias("class"), "head")
    of_set = classes.select(*name, "class", "first").join(led, "class", "left").select(*name, F.coalesce("head", "first").alias("head"))
    return made.select("doc_id", "text_hash", "n_shingles", *name).join(of_set, name, "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("head")).alias("head"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept for every row."""
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    rows = grouped(text_frame(docs, id_col, text_col), percent)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one is left for each component: the first text of its smallest id.

    Of rows that repeat both id and text one is left; rows with an empty set all stay.
    """
    rows = cut(grouped(text_frame(docs, id_col, text_col), percent).where("head is not null").withColumn("_kept", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))))
    gone = cut(rows.where("not _kept").select("doc_id", "text_hash").distinct())
    again = cut(rows.where("_kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    own = lambda listed: (F.col("_hash") == listed["text_hash"]) & F.col("_id").eqNullSafe(listed["doc_id"])
    small = lambda listed: F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed
    kept = every.join(small(gone), own(gone), "left_anti")
    if not again.isEmpty():
        single = kept.join(small(again), own(again), "left_semi").dropDuplicates(["_id", "_hash"])
        kept = kept.join(small(again), own(again), "left_anti").unionByName(single)
    return kept.select("_row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words
  FROM documents
), words AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed
), runs AS (
  SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS shingle
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), filled AS (
  SELECT doc_id, list(DISTINCT shingle ORDER BY shingle) AS held FROM runs WHERE i <= greatest(n - 4, 1) GROUP BY doc_id
), sets AS (
  SELECT doc_id, coalesce(held, []) AS held FROM documents LEFT JOIN filled USING (doc_id)
), classes AS (
  SELECT held, min(doc_id) AS class, len(held) AS size FROM sets WHERE len(held) > 0 GROUP BY held
), shingles AS (
  SELECT class, size, unnest(held) AS shingle FROM classes
), pairs AS (
  SELECT a.class AS a, b.class AS b, any_value(a.size + b.size) AS total, count(*) AS both
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class < b.class AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.size + b.size) - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT class AS node, class AS seen FROM classes
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.seen = l.a
), components AS (
  SELECT node, min(seen) AS component FROM reached GROUP BY node
)
SELECT s.doc_id, len(s.held) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON s.held = c.held LEFT JOIN components k ON c.class = k.node
"""
