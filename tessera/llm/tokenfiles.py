"""Token ids in files, coded by a static range asymmetric numeral system (rANS).

Ids are counted over the whole corpus; the counts are scaled to a frequency table of 2^20 slots that
all blocks share.  Texts are put in order of their ids and become token ids, each with an end id; the
stream of ids is cut into blocks that are coded independently of each other.  In a block id number i
belongs to lane i mod 512; each lane is a coder with a 64-bit state that gives off 32-bit words, and
the words of all lanes stand interleaved in the order in which a decoder asks for them.  Every 131072
ids a checkpoint notes the states and the place in the words, so that a decoder runs the parts between
them side by side, or starts at the one before the id it wants.  A block has a checksum of its bytes
and one of its ids; both are tested when it is read.

A file set is a folder of three tables, written by Spark's own writer, so that it lies in any store
and survives lost tasks: `frequencies` (id, frequency), `blocks` (first, n, data, and which documents
have ids in it: doc_ids, starts and lengths) and `format`.  A block says all that is needed to give its
documents back.

Data of a block, little-endian: the magic `rANS`, version, lanes, ids between checkpoints, ids, words,
checksum of the ids and checksum of all that follows (4 bytes each); for each checkpoint the place in
the words (4 bytes) and a state for each lane (8 bytes each); the words (4 bytes each).

Shuffles: one sort of the texts.  What the driver gets is a count for each id of the vocabulary and a
sum for each partition.

Defined results: a null or empty text is the end id alone; rows with the same id follow one another in
the order of their texts' hashes; rows without an id come last; an empty table gives no blocks and no
rows; other columns are ignored; a document of any length goes over as many blocks as it takes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, small_batches, table, text_frame, trim, use_checkpoint_dir
from .packing import word_ids

END_ID = 2
SLOT_BITS = 20
LANES, ROWS, BLOCK = 512, 256, 1 << 19  #: lanes of a block, ids of each between checkpoints, ids of a block
LEAST = np.uint64(1 << 31)  #: states are at least this and below 2^63
MAGIC, VERSION = b"rANS", 1
HEAD = struct.Struct("<4s7I")


class Damaged(ValueError):
    """A block that does not hold what its checksums say."""


def frequencies(counts: dict[int, int], bits: int = SLOT_BITS) -> dict[int, int]:
    """Frequencies of at least 1 whose sum is 2^bits, in proportion to the counts as nearly as that allows."""
    ids = sorted(i for i, n in counts.items() if n > 0)
    room, total = 1 << bits, sum(counts[i] for i in ids)
    if len(ids) > room:
        raise ValueError(f"{len(ids)} different ids need more than 2^{bits} slots")
    if not ids:
        return {}
    out = {i: max(1, counts[i] * room // total) for i in ids}
    over = sum(out.values()) - room
    by_size = sorted(ids, key=lambda i: (-out[i], i))
    while over > 0:  # rare ids took more than their share; the frequent ones give it back, each in proportion
        spare = sum(out[i] - 1 for i in by_size)
        for i in by_size:
            give = min(over, -(-(out[i] - 1) * over // spare))
            out[i] -= give
            over -= give
            if not over:
                break
    out[by_size[0]] -= over
    return out


class Coder:
    """The coder of one frequency table."""

    def __init__(self, table: dict[int, int], bits: int = SLOT_BITS) -> None:
        self.bits = np.uint64(bits)
        self.ids = np.array(sorted(table), dtype=np.int64)
        sizes = np.array([table[i] for i in self.ids.tolist()], dtype=np.int64)
        self.size, self.first = sizes.astype(np.uint64), (np.cumsum(sizes) - sizes).astype(np.uint64)
        self.symbol_at = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int32), sizes)
        self.rank = np.full(int(self.ids.max(initial=-1)) + 1, -1, np.int64)
        self.rank[self.ids] = np.arange(len(sizes))

    def encode(self, ids: np.ndarray) -> bytes:
        """A block of at least one id."""
        symbols = self.rank[ids]
        if (symbols < 0).any():
            raise ValueError("an id is not in the frequency table")
        n, bits = len(ids), self.bits
        size, first = self.size[symbols], self.first[symbols]
        most, rest = size << (np.uint64(63) - bits), np.uint64(1 << int(bits)) - size
        state, given, kept = np.full(LANES, LEAST), [], []
        for row in range(-(-n // LANES) - 1, -1, -1):
            a, b = row * LANES, min(n, (row + 1) * LANES)
            x = state[: b - a]
            full = np.flatnonzero(x >= most[a:b])
            over = x[full]
            given.append(over.astype("<u4"))  # the low 32 bits
            x[full] = over >> np.uint64(32)
            x += x // size[a:b] * rest[a:b] + first[a:b]  # whole * 2^bits + remainder + first
            if row % ROWS == 0:
                kept.append((row, state.copy()))
        given.reverse()
        before = np.concatenate(([0], np.cumsum([len(g) for g in given])))
        words = np.concatenate(given)
        marks = b"".join(struct.pack("<I", before[row]) + states.astype("<u8").tobytes() for row, states in reversed(kept))
        body = marks + words.tobytes()
        return HEAD.pack(MAGIC, VERSION, LANES, LANES * ROWS, n, len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of a block, or those from start to stop, decoded from the checkpoint before."""
        if len(data) < HEAD.size:
            raise Damaged("a block is too short")
        magic, version, lanes, apart, n, n_words, ids_crc, rest_crc = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise Damaged("not a block of this format")
        rest = memoryview(data)[HEAD.size :]
        parts = -(-n // apart)
        if len(rest) != parts * (4 + 8 * lanes) + 4 * n_words or zlib.crc32(rest) != rest_crc:
            raise Damaged("a block's bytes are not those that were written")
        marks = np.frombuffer(rest, np.uint8, parts * (4 + 8 * lanes)).reshape(parts, -1)
        words = np.frombuffer(rest, "<u4", n_words, marks.size).astype(np.uint64) if n_words else np.zeros(1, np.uint64)
        stop = n if stop is None else min(stop, n)
        a, b = start // apart, -(-stop // apart)
        if start >= stop:
            return np.zeros(0, np.uint32)
        at = np.ascontiguousarray(marks[a:b, :4]).view("<u4").astype(np.int64).reshape(-1)
        state = np.ascontiguousarray(marks[a:b, 4:]).view("<u8").astype(np.uint64).reshape(-1)
        out = np.zeros((b - a, apart // lanes, lanes), self.symbol_at.dtype)
        low, ends = np.uint64((1 << int(self.bits)) - 1), np.arange(1, b - a + 1) * lanes
        for row in range(apart // lanes):  # all parts side by side
            slot = state & low
            symbol = self.symbol_at[slot]
            out[:, row] = symbol.reshape(b - a, lanes)
            state >>= self.bits
            state *= self.size[symbol]
            state += slot - self.first[symbol]
            empty = np.flatnonzero(state < LEAST)
            upto = np.searchsorted(empty, ends)  # how many words the parts before and this one take
            taken = np.diff(upto, prepend=0)
            place = np.arange(len(empty)) + np.repeat(at - upto + taken, taken)
            state[empty] = state[empty] << np.uint64(32) | words.take(place, mode="clip")
            at += taken
        ids = self.ids[out.reshape(-1)[: min(b * apart, n) - a * apart]].astype(np.uint32)
        if (a, min(b * apart, n)) == (0, n) and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise Damaged("a block's ids are not those that were written")
        return ids[start - a * apart : stop - a * apart]


def ordered_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian 32-bit) and part of every row of a text_frame, in order of the ids: parts follow one another."""
    end = np.array([end_id], dtype="<u4").tobytes()
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    made = map_texts(ordered, lambda ids, texts, words: {"doc_id": ids, "ids": [x + end for x in words.ids(texts)]}, "doc_id long, ids binary", pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), lambda: word_ids(tokenizer_path))
    return cut(made.withColumn("part", F.spark_partition_id()))


def id_counts(rows: DataFrame) -> dict[int, int]:
    """How often each id occurs; one row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"))
            if len(found) > len(total):
                found, total = total, found.astype(np.int64)
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counted = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


BLOCK_FIELDS = [("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())]
BLOCK_SQL = "first long, n long, doc_ids array<long>, starts array<long>, lengths array<long>, data binary"


def encoded_blocks(rows: DataFrame, table: dict[int, int], before: dict[int, int], block: int = BLOCK) -> DataFrame:
    """The blocks of ordered_ids; before[part] is how many ids all earlier parts have."""
    shared = rows.sparkSession.sparkContext.broadcast((table, before))  # a vocabulary and a number for each partition
    out = pa.schema(BLOCK_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shared.value
        coder, at, done, waiting, held, docs = Coder(table), None, 0, [], 0, []

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal done, held, docs, waiting
            if held < least:
                return
            ids = np.concatenate(waiting)
            while len(ids) >= least and len(ids):
                piece, ids = ids[:block], ids[block:]
                stop = done + len(piece)
                here = [d for d in docs if d[1] < stop]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([done, len(piece), *(list(c) for c in zip(*here, strict=True)), coder.encode(piece)], out, strict=True)], schema=out)
                docs = [d for d in docs if d[1] + d[2] > stop]
                done = stop
            waiting, held = [ids], len(ids)

        for batch in batches:
            for doc_id, data, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None:
                    at = done = before[part]
                ids = np.frombuffer(data, "<u4")
                docs.append((doc_id, at, len(ids)))
                waiting.append(ids)
                at += len(ids)
                held += len(ids)
                if held >= block:
                    yield from blocks(block)
        yield from blocks(1)
        trim()

    return small_batches(rows).select("doc_id", "ids", "part").mapInArrow(run, BLOCK_SQL)


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The token ids of all texts, in order of their ids, as a file set in a new folder."""
    rows = ordered_ids(text_frame(docs, id_col, text_col), tokenizer_path, end_id)
    sums, before, total = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum(F.length("ids") / 4).cast("long").alias("n")).collect()}, {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    table = frequencies(id_counts(rows))
    spark = docs.sparkSession
    spark.createDataFrame(list(table.items()), "id long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    spark.createDataFrame([(VERSION, SLOT_BITS, end_id, total)], "version int, slot_bits int, end_id int, n_ids long").coalesce(1).write.parquet(f"{folder}/format")
    encoded_blocks(rows, table, before, block).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_pieces(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, at, n, ids_crc32 and, with keep_ids, ids of every document's piece in every block of a file set."""
    kind = spark.read.parquet(f"{folder}/format").first()
    if kind["version"] != VERSION:
        raise ValueError(f"{folder} has version {kind['version']} of the format")
    table = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{folder}/frequencies").collect()}  # at most 2^slot_bits rows
    shared, bits = spark.sparkContext.broadcast(table), kind["slot_bits"]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, start long, n_tokens long, at long, n long, ids_crc32 long"
    if keep_ids:
        fields.append(("ids", pa.binary()))
        schema += ", ids binary"
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, bits)
        for batch in batches:
            for first, n, doc_ids, starts, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = coder.decode(data)
                if len(ids) != n:
                    raise Damaged(f"the block at {first} has {len(ids)} of {n} ids")
                view, rows = memoryview(ids.astype("<u4").tobytes()), []
                for doc_id, start, length in zip(doc_ids, starts, lengths, strict=True):
                    a, b = max(start, first), min(start + length, first + n)
                    piece = view[4 * (a - first) : 4 * (b - first)]
                    rows.append((doc_id, start, length, a, b - a, zlib.crc32(piece), *([bytes(piece)] if keep_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        trim()

    blocks = small_batches(spark.read.parquet(f"{folder}/blocks")).select("first", "n", "doc_ids", "starts", "lengths", "data")
    return blocks.mapInArrow(run, schema)


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two strings one after the other, from theirs and the second one's size.

    The first is carried over size zero bytes: a linear map over bits, taken as a product of squares.
    """
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    times = lambda m, x: _xor(m[k] for k in range(32) if x >> k & 1)
    n = 8 * size
    while n:
        if n & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        n >>= 1
    return first ^ second


def _xor(values) -> int:  # noqa: ANN001
    out = 0
    for v in values:
        out ^= v
    return out


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a file set; a document that lacks ids raises Damaged."""
    pieces = cut(read_pieces(spark, folder))  # decoded once; some numbers for each document
    whole = F.col("n") == F.col("n_tokens")
    parts = pieces.where(~whole).groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "n", "ids_crc32"))).alias("parts"))

    @F.pandas_udf("long")
    def together(starts: pd.Series, sizes: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for start, size, listed in zip(starts, sizes, parts, strict=True):
            at, crc = start, 0
            for part in listed:
                if part["at"] != at:
                    raise Damaged(f"ids from {at} on are missing")
                crc = joined_crc(crc, part["ids_crc32"], 4 * part["n"])
                at += part["n"]
            if at != start + size:
                raise Damaged(f"ids from {at} on are missing")
            out.append(crc)
        return pd.Series(out, dtype="int64")

    long = parts.select("doc_id", "start", "n_tokens", together("start", "n_tokens", "parts").alias("ids_crc32"))
    return pieces.where(whole).select(long.columns).unionByName(long)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)
