"""Phrase collocations by position bitmaps that are shifted, intersected and counted.

Texts are dealt to shards of about two million places.  In a shard every word has a bitmap of its
places, of which only the blocks of 16 places that hold a bit are kept; between pieces stands an empty place, so
that no phrase reaches over it.  A phrase's bitmap has its last places: shifted by one and
intersected with a word's bitmap it is that of the phrase one word longer, and the number of its bits
is the phrase's count in the shard.  Within a shard phrases are extended depth-first, the subtrees of
one lot of first words after the other, so only the bitmaps on the way down are held.

A phrase can only be frequent if its first and its last part are.  So the counts of each length are
summed over the shards before the next length is counted: words that are too rare in all shards
together leave no bits, a shard goes down only those phrases that are frequent in all, and extends
them only where the end of the longer phrase is frequent too.  No threshold is applied to a shard's own counts.

Shards stay where they are: they are a table in buckets, with which what is frequent in each of them is
joined.  What is shuffled is words, and a shard's phrases with their counts, packed into one row for each
bucket of phrases, whose rows meet in one task.  Pairs of words are far more than frequent ones, so at first only
KEY_BITS bits of a hash of each pair are summed, as gaps of about 12 bits; then the pairs whose key comes up often
enough are counted exactly, and the few rare ones among them drop out.  A word's id is a hash of ID_BITS bits, so no shard is joined
with a vocabulary; should two words of the texts have one id, all are hashed anew.
A shard's bitmaps and its frequent phrases meet in one task; both are bounded by its places.  What is
collected and broadcast is 2 MB of bits that tell most rare words, whatever the size of the vocabulary.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows all count;
an empty table gives no rows; other columns and missing ids are ignored; a piece is never cut, however long.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, remove, small_batches, table, trim, use_checkpoint_dir

ENDS = b".,;:!?\x0a\x0b\x0c\x0d"  #: characters that part pieces
LONGEST, LEAST, TOP = 5, 100, 2000
SHARD = 1 << 21  #: places of a shard, beyond which it is closed at the end of a lot of texts
TEXT_LOT = 1 << 21  #: bytes of texts whose words are told apart together
BITS = 16  #: places of a block
LOT = 1 << 15  #: blocks that are extended together
UNKNOWN = "und"
MARKS = 1 << 24  #: bits that tell rare words before the shuffle
ID_BITS = 56
KEY_BITS = 32  #: of a pair, by which likely ones are told
SEEDS = 64  #: tries to give all words different ids

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TO_BREAK = bytes.maketrans(_UPPER + ENDS, _LOWER + b"\xff" * len(ENDS))  # no UTF-8 text has this byte
_TO_SPACE = bytes.maketrans(_UPPER + ENDS, _LOWER + b" " * len(ENDS))


def distinct_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The different words between white space, and which of them stands at each place."""
    data = data.strip()
    if not data:
        return [], np.zeros(0, np.int32)
    found = pc.ascii_split_whitespace(pa.array([data], pa.large_binary()).view(pa.large_string())).flatten().dictionary_encode()
    _, ends, held = found.dictionary.buffers()
    ends, held = np.frombuffer(ends, np.int64, len(found.dictionary) + 1).tolist(), held.to_pybytes()
    return [held[a:b] for a, b in pairwise(ends)], found.indices.to_numpy()


def by_lang(batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language of a batch (lang, text), in lots that are closed at the end of a text."""
    lots: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        texts, size = lots.setdefault(lang, ([], [0]))
        texts.append(text)
        size[0] += len(text)
        if size[0] >= at_once:
            yield lang, lots.pop(lang)[0]
    yield from ((lang, texts) for lang, (texts, _) in lots.items())


class Numbers(dict):
    """Words of a language and their places in the list of a shard's words, where new ones are put."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]) -> None:
        super().__init__({b"\xff": -1})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return n


class Shard:
    """The places of the words of some texts; -1 between pieces."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bytes]] = []
        self.places = array("q")
        self.known: dict[str, Numbers] = {}

    def add(self, lang: str, *texts: bytes) -> None:
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = Numbers(lang, self.names)
        # Space and tab are the only white space left.
        words, at = distinct_words(b"\xff".join([*texts, b""]).translate(_TO_BREAK).replace(b"\xff", b" \xff "))
        self.places.frombytes(np.fromiter(map(known.__getitem__, words), np.int64, len(words))[at].tobytes())

    def row(self, shard: int, marks: np.ndarray | None = None, seed: int = 0) -> pa.RecordBatch:
        """One row, SHARD_SQL: the bitmaps of all words, or of those that marks (mark_bits) have."""
        of, ids = np.array(self.places, dtype=np.int64), word_ids(self.names, seed)
        if marks is not None:
            at = ids % (64 * len(marks))
            held = (marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ids = ids[held]
            number = np.append(np.where(held, np.cumsum(held) - 1, -1), -1)  # the last is for places without a word
            of = number[of]
        at = np.flatnonzero(of >= 0)
        of = of[at]
        order = np.argsort(of, kind="stable")
        of, at = of[order], at[order]
        block, bit = at // BITS, np.uint16(1) << (at % BITS).astype(np.uint16)
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])))) if len(of) else at
        bits = np.bitwise_or.reduceat(bit, new) if len(new) else bit
        block, of = block[new], of[new]
        gap = np.diff(block, prepend=0)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        gap[first] = block[first]
        sizes = np.bincount(of, minlength=len(ids)).astype("<u4")
        columns = [[shard], [ids.astype("<i8").tobytes()], [sizes.tobytes()], [packed(gap.astype("<u4"))], [packed(bits.astype("<u2"))]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SHARD_FIELDS, strict=True)], schema=SHARD_FIELDS)


SHARD_FIELDS = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("gaps", pa.binary()), ("bits", pa.binary())])
SHARD_SQL = "shard long, ids binary, sizes binary, gaps binary, bits binary"


def packed(values: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane: most high bytes are 0."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def word_ids(names: list[tuple[str, bytes]], seed: int = 0) -> np.ndarray:
    """Ids of words (lang, word): hashes of ID_BITS bits."""
    seeds = {lang: zlib.crc32(lang.encode()) | seed << 32 for lang in {lang for lang, _ in names}}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(word, seed=seeds[lang]) for lang, word in names), np.uint64, len(names))
    return (hashes >> np.uint64(64 - ID_BITS)).astype(np.int64)


def mark_bits(words: DataFrame) -> np.ndarray:
    """MARKS bits, of which the id of each of the words sets one; at most MARKS / 64 rows come to the driver.

    They tell most of the rare words, whose bitmaps then need not be kept; phrases with the others are
    too rare to be frequent.
    """
    at = F.pmod(F.col("id"), F.lit(MARKS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    found = words.groupBy(F.floor(at / 64).alias("at")).agg(F.bit_or(one).alias("bits")).toPandas()
    marks = np.zeros(MARKS // 64, np.uint64)
    marks[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return marks


def shard_rows(docs: DataFrame, lang_col: str, text_col: str, marks: np.ndarray, shard_places: int = SHARD, seed: int = 0) -> DataFrame:
    """A row, SHARD_SQL, for each shard: its marked words and, for each of them in turn, its blocks (as gaps) and their bits."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # MARKS bits, however many words there are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, texts in by_lang(batch, min(TEXT_LOT, 4 * shard_places)):
                shard.add(lang, *texts)
                if len(shard.places) >= shard_places:
                    yield shard.row(number, shared.value, seed)
                    shard, number = Shard(), number + 1
        if shard.names:
            yield shard.row(number, shared.value, seed)
        del shard
        trim()

    rows = small_batches(docs).select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SHARD_SQL)


class Bitmaps:
    """The bitmaps of a shard's frequent words, sorted by block; words are numbered within the shard."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray, gaps: np.ndarray, bits: np.ndarray) -> None:
        number = np.full(len(sizes), -1)
        order = np.argsort(ids)
        self.words = ids[order]
        number[at[order]] = np.arange(len(order))
        word, total = np.repeat(number, sizes), np.cumsum(gaps, dtype=np.int64)
        first = (np.cumsum(sizes, dtype=np.int64) - sizes)[sizes > 0]
        block = total - np.repeat(total[first] - gaps[first], sizes[sizes > 0])
        mine = np.flatnonzero(word >= 0)
        mine = mine[np.argsort(word[mine], kind="stable")]
        #: By word: for the first word of a phrase.
        self.of, self.block, self.bit = word[mine], block[mine], bits[mine]
        #: By block: for the next one.
        by_block = np.argsort(self.block, kind="stable")
        self.next_word, self.next_bit = self.of[by_block], self.bit[by_block]
        self.start = np.searchsorted(self.block[by_block], np.arange(self.block.max(initial=-1) + 3))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shift the bitmaps of some phrases by one place and intersect them with those of all words: phrase, word, block and bits that remain."""
        over = bit >> np.uint16(BITS - 1) > 0
        phrase, block, bit = np.concatenate((phrase, phrase[over])), np.concatenate((block, block[over] + 1)), np.concatenate((bit << np.uint16(1), np.ones(int(over.sum()), np.uint16)))
        count = self.start[block + 1] - self.start[block]
        each = np.repeat(np.arange(len(block)), count)
        other = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[block], count)
        both = bit[each] & self.next_bit[other]
        kept = np.flatnonzero(both)
        each, other = each[kept], other[kept]
        return phrase[each], self.next_word[other], block[each], both[kept]


class Likely:
    """A set of keys (phrase_keys)."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.marks = np.sort(keys), np.zeros(1 << 22, bool)
        self.marks[self.keys >> np.uint32(10)] = True  # tells most others at once

    def holds(self, keys: np.ndarray) -> np.ndarray:
        ok = self.marks[keys >> np.uint32(10)]
        at = np.flatnonzero(ok)
        ok[at] = self.keys[np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)] == keys[at]
        return ok


class Search:
    """Counts of the phrases of `size` words of a shard, given the frequent ones of one word less."""

    def __init__(self, maps: Bitmaps, size: int, known: np.ndarray, likely: Likely | None = None) -> None:
        """known: rows of size - 1 numbers of the shard's words, sorted; likely: keys of the phrases that count, if only some do."""
        self.maps, self.size, self.likely = maps, size, likely
        self.known, self.width = known, len(maps.words)
        #: For each depth the keys (number of the phrase before, word) of the frequent phrases; a key's place is its phrase's number.
        self.keys: list[np.ndarray] = []
        if size > 2:
            number = known[:, 0]
            for depth in range(1, size - 1):
                keys, number = np.unique(number * self.width + known[:, depth], return_inverse=True)
                self.keys.append(keys)

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases (rows of numbers of words) and their counts, lot by lot."""
        m = self.maps
        of, block, bit = m.of, m.block, m.bit
        if self.size > 2:
            led = np.isin(of, np.unique(self.known[:, 0]))
            of, block, bit = of[led], block[led], bit[led]
        cuts = [0]
        while cuts[-1] < len(of):
            stop = min(cuts[-1] + LOT, len(of))
            cuts.append(int(np.searchsorted(of, of[stop - 1], side="right")))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self.below(1, of[a:b], of[a:b][:, None], block[a:b], bit[a:b])

    def below(self, depth: int, number: np.ndarray, path: np.ndarray, block: np.ndarray, bit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Go down from phrases of `depth` words, of which each bitmap's block has the number and the words."""
        at = np.arange(len(block))
        each, word, block, bit = self.maps.extend(at, block, bit)
        if depth == self.size - 1 and self.likely is not None:
            ids = self.maps.words
            ok = np.flatnonzero(self.likely.holds(phrase_keys([*(ids[path[each, k]] for k in range(depth)), ids[word]])))
            each, word, block, bit = each[ok], word[ok], block[ok], bit[ok]
        key = number[each] * self.width + word
        if depth == self.size - 1:
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(order) else order
            if not len(new):
                return
            n = np.add.reduceat(np.bitwise_count(bit[order]).astype(np.int64), new)
            first = order[new]
            phrases = np.concatenate((path[each[first]], word[first][:, None]), axis=1)
            ok = self.end_is_frequent(phrases)
            yield phrases[ok], n[ok]
            return
        keys = self.keys[depth - 1]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = np.flatnonzero(keys[found] == key) if len(keys) else np.zeros(0, np.int64)
        if not len(ok):
            return
        order = ok[np.argsort(found[ok], kind="stable")]
        number, path, block, bit = found[order], np.concatenate((path[each[order]], word[order][:, None]), axis=1), block[order], bit[order]
        start = 0
        while start < len(number):
            stop = min(start + LOT, len(number))
            stop = int(np.searchsorted(number, number[stop - 1], side="right"))
            yield from self.below(depth + 1, number[start:stop], path[start:stop], block[start:stop], bit[start:stop])
            start = stop

    def end_is_frequent(self, phrases: np.ndarray) -> np.ndarray:
        """Whether all words but the first are a frequent phrase."""
        number, ok = phrases[:, 1], np.ones(len(phrases), bool)
        for depth, keys in enumerate(self.keys):
            key = number * self.width + phrases[:, depth + 2]
            number = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok &= keys[number] == key
        return ok


def packed_phrases(phrases: np.ndarray) -> bytes:
    """Rows of ids, compressed by column; rows that lie near each other begin alike."""
    return packed(np.concatenate((np.diff(phrases[:, 0], prepend=0), phrases[:, 1:].T.ravel())).astype("<i8"))


def unpacked_phrases(data: bytes, size: int) -> np.ndarray:
    columns = unpacked(data, "<i8").reshape(size, -1).T.copy()
    columns[:, 0] = np.cumsum(columns[:, 0])
    return columns


def phrase_hashes(columns: Iterable[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, of which the ids are given column by column."""
    h = np.zeros(1, np.uint64)
    for column in columns:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def phrase_keys(columns: Iterable[np.ndarray]) -> np.ndarray:
    return (phrase_hashes(columns) >> np.uint64(64 - KEY_BITS)).astype(np.uint32)


def bucket_of(phrases: np.ndarray, buckets: int) -> np.ndarray:
    return (phrase_hashes(phrases.T) % np.uint64(buckets)).astype(np.int32)


def gaps_of(keys: np.ndarray) -> bytes:
    """Keys, sorted, packed."""
    return packed(np.diff(keys, prepend=np.uint32(0)).astype("<u4"))


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u4"), dtype=np.uint32)


def opened(ids: bytes, sizes: bytes, gaps: bytes, bits: bytes) -> Bitmaps:
    """The bitmaps of a row of SHARD_SQL."""
    ids, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64)
    return Bitmaps(np.arange(len(ids)), ids, sizes, unpacked(gaps, "<u4"), unpacked(bits, "<u2"))


def key_counts(shards: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard, keys of the pairs of words and their counts, packed; a bucket has a range of the keys."""
    out = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 32) - 1)
        for batch in batches:
            for k in range(batch.num_rows):
                shard, *maps = (c[k].as_py() for c in batch.columns)
                maps, each = opened(*maps), []
                for phrases, n in Search(maps, 2, np.zeros((0, 1), np.int64)).counts():
                    each.append(phrase_keys(maps.words[phrases].T).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64))
                del maps
                if not sum(map(len, each)):
                    continue
                each = np.sort(np.concatenate(each))
                keys, n = (each >> np.uint64(32)).astype(np.uint32), each & low
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                keys, n = keys[first], np.add.reduceat(n, first).astype("<u4")
                del each
                bucket = (keys.astype(np.uint64) * np.uint64(buckets) >> np.uint64(KEY_BITS)).astype(np.int64)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket[start], shard, gaps_of(keys[start:stop]), packed(n[start:stop])), out, strict=True)], schema=out)
        trim()

    return small_batches(shards).select("shard", "ids", "sizes", "gaps", "bits").mapInArrow(run, "bucket int, shard long, keys binary, counts binary")


def likely_keys(counts: DataFrame, least: int, buckets: int) -> DataFrame:
    """shard and known: of the keys of each shard those that come up `least` times in all, packed."""
    out = pa.schema([("shard", pa.int64()), ("known", pa.binary())])

    def added(pieces: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys = [keys_of(k) for _, k, _ in pieces]
        every, number = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.bincount(number, np.concatenate([unpacked(c, "<u4") for _, _, c in pieces]), len(every)) >= least  # sums are exact below 2^53
        del number
        often = every[often]
        for (shard, _, _), own in zip(pieces, keys, strict=True):
            kept = np.intersect1d(own, often, assume_unique=True)
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([gaps_of(kept)], pa.binary())], schema=out)

    return cut(by_bucket(counts, buckets, added, "shard long, known binary"))


def by_bucket(counts: DataFrame, buckets: int, added: Callable, schema: str) -> DataFrame:
    """What added makes of the rows of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pieces = None, []
        for batch in batches:
            for own, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket and pieces:
                    yield from added(pieces)
                    pieces = []
                bucket = own
                pieces.append(tuple(piece))
        if pieces:
            yield from added(pieces)
        trim()

    dealt = counts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return small_batches(dealt).mapInArrow(run, schema)


def shard_counts(shards: DataFrame, size: int, known: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard, phrases (of `size` words) and their counts, packed; known has the frequent phrases of one word less in each shard, or the likely keys of pairs."""
    out = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, *maps, told = (c[k].as_py() for c in batch.columns)
                maps, likely, rows = opened(*maps), None, np.zeros((0, size - 1), np.int64)
                if size > 2:
                    rows = np.searchsorted(maps.words, np.concatenate([unpacked_phrases(x, size - 1) for x in told]))
                else:
                    likely = Likely(np.concatenate([keys_of(x) for x in told]))
                found = [x for x in Search(maps, size, rows, likely).counts() if len(x[1])]
                if found:
                    phrases, n = maps.words[np.concatenate([p for p, _ in found])], np.concatenate([c for _, c in found]).astype("<u4")
                    del found
                    bucket = bucket_of(phrases, buckets)
                    order = np.argsort(bucket, kind="stable")
                    phrases, n, upto = phrases[order], n[order], np.cumsum(np.bincount(bucket))
                    for b, (start, stop) in enumerate(zip([0, *upto[:-1]], upto, strict=True)):
                        if start < stop:
                            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((b, shard, packed_phrases(phrases[start:stop]), packed(n[start:stop])), out, strict=True)], schema=out)
                    del phrases, n
                del maps
        trim()

    told = shards.join(known.groupBy("shard").agg(F.collect_list("known").alias("known")), "shard")
    rows = small_batches(told).select("shard", "ids", "sizes", "gaps", "bits", "known")
    return rows.mapInArrow(run, "bucket int, shard long, phrases binary, counts binary")


def summed(counts: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """Frequent phrases: phrase (ids, 64 bits each) and f; and rows of shard and known, its frequent phrases, packed."""
    out = pa.schema([("shard", pa.int64()), ("known", pa.binary()), ("phrase", pa.binary()), ("f", pa.int64())])

    def added(pieces: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        phrases, n = [unpacked_phrases(p, size) for _, p, _ in pieces], np.concatenate([unpacked(c, "<u4") for _, _, c in pieces])
        every = np.concatenate(phrases)
        number = np.zeros(len(every), np.int64)
        for column in every.T:
            distinct, own = np.unique(column, return_inverse=True)
            _, first, number = np.unique(number * len(distinct) + own, return_index=True, return_inverse=True)
        f = np.zeros(len(first), np.int64)
        np.add.at(f, number, n.astype(np.int64))
        often, at = f >= least, 0
        for (shard, _, _), own in zip(pieces, phrases, strict=True):
            kept = own[often[number[at : at + len(own)]]]
            at += len(own)
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([x], g.type) for x, g in zip((shard, packed_phrases(kept), None, None), out, strict=True)], schema=out)
        data, k = every[first[often]].astype(">i8").tobytes(), int(often.sum())
        ends = np.arange(k + 1, dtype="<i4") * (8 * size)
        phrase = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), phrase, pa.array(f[often])], schema=out)

    return cut(by_bucket(counts, buckets, added, "shard long, known binary, phrase binary, f long"))


def word_counts(docs: DataFrame, lang_col: str, text_col: str, at_once: int = 300_000, seed: int = 0) -> DataFrame:
    """lang, word (binary), id and f of every word."""
    out = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counted in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()), pa.array(word_ids([(lang, word) for word in counted], seed)), pa.array(list(counted.values()), pa.int64())], schema=out)
            counts.clear()

        for batch in batches:
            for lang, texts in by_lang(batch, TEXT_LOT):
                words, at = distinct_words(b" ".join(texts).translate(_TO_SPACE))
                counts.setdefault(lang, Counter()).update(dict(zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True)))
            if sum(map(len, counts.values())) > at_once:
                yield from rows()
        yield from rows()
        trim()

    rows = small_batches(docs).select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, word binary, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", shard_places: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frequent words (lang, word, id, phrase, f), the frequent phrases of 2 to `longest` words (phrase, size, f) and the languages (lang, n)."""
    spark = docs.sparkSession
    for seed in range(SEEDS):
        every = cut(word_counts(docs, lang_col, text_col, seed=seed))
        if every.groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError(f"words share ids of {ID_BITS} bits whatever their seed")
    langs = cut(every.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut(every.where(F.col("f") >= least).withColumn("phrase", F.unhex(F.lpad(F.hex("id"), 16, "0"))))
    del every
    release(spark)  # the counts of all words, most of them rare
    use_checkpoint_dir(spark)
    name = f"shards_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    made = shard_rows(docs, lang_col, text_col, mark_bits(words), shard_places, seed)
    # With fewer buckets than this Spark shuffles both sides of a join.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    made.write.bucketBy(parts, "shard").sortBy("shard").option("path", folder).saveAsTable(name)
    shards = spark.table(name)
    buckets = max(1, shards.count())
    found, known = [], likely_keys(key_counts(shards, buckets), least, buckets)
    release(spark)
    for size in range(2, longest + 1):
        rows = summed(shard_counts(shards, size, known, buckets), size, least, buckets)
        known = rows.where("shard IS NOT NULL").select("shard", "known")
        found.append(rows.where("shard IS NULL").select("phrase", F.lit(size).alias("size"), "f"))
        release(spark)
        if known.isEmpty():
            break
    phrases = cut(reduce(DataFrame.unionByName, found))
    spark.sql(f"DROP TABLE {name}")
    remove(spark, folder)
    return words, phrases, langs


def part(phrase: str, start: str, size: str) -> Column:
    """Words of a phrase, from `start` (counted from 0) on."""
    return F.expr(f"substring({phrase}, 8 * ({start}) + 1, 8 * ({size}))")


def scored(words: DataFrame, phrases: DataFrame, langs: DataFrame) -> DataFrame:
    """phrase, size, lang, a, l, r, n and score, that of the cut with the lowest one, of every phrase."""
    f = cut(words.select("phrase", "f").unionByName(phrases.select("phrase", "f")))
    cuts = phrases.select("phrase", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumns({"_left": part("phrase", "0", "k"), "_right": part("phrase", "k", "size - k"), "_word": part("phrase", "0", "1")})
    cuts = cuts.join(f.select(F.col("phrase").alias("_left"), F.col("f").alias("l")), "_left").join(f.select(F.col("phrase").alias("_right"), F.col("f").alias("r")), "_right")
    cuts = cuts.join(words.select(F.col("phrase").alias("_word"), "lang"), "_word").join(langs, "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).cast("decimal(38,0)")
    score = F.expr("_top div _low")
    cuts = cuts.withColumns({"_top": product, "_low": (exact("l") * exact("r")).cast("decimal(38,0)")}).withColumn("score", score)
    best = cuts.groupBy("phrase", "size", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    return best.select("phrase", "size", "lang", "a", "_best.l", "_best.r", "n", "_best.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", shard_places: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases, those left out that only stand inside a longer one."""
    words, phrases, langs = frequent_phrases(docs, longest, least, lang_col, text_col, shard_places)
    longer = phrases.where("size > 2")
    # A phrase that always stands in some longer one always stands in one of a word more.
    inside = longer.select(part("phrase", "0", "size - 1").alias("phrase"), F.col("f").alias("a")).unionByName(longer.select(part("phrase", "1", "size - 1").alias("phrase"), F.col("f").alias("a")))
    kept = cut(scored(words, phrases, langs).join(inside.distinct(), ["phrase", "a"], "left_anti"))
    spelled = kept.select("phrase", F.explode(F.expr("sequence(0, size - 1)")).alias("at")).withColumn("_word", part("phrase", "at", "1"))
    spelled = spelled.join(words.select(F.col("phrase").alias("_word"), F.col("word").cast("string").alias("word")), "_word")
    texts = spelled.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("_words")).select("phrase", F.array_join(F.transform("_words", lambda w: w["word"]), " ").alias("text"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    ranked = kept.join(texts, "phrase").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(parts) AS piece, generate_subscripts(parts, 1) AS part FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, '{UNKNOWN}') AS lang,
      string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS parts
    FROM documents)
), listed AS (
  SELECT doc_id, lang, part, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS words FROM pieces
), words AS (
  SELECT doc_id, part, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed
), sizes AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), ahead AS (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY doc_id, part ORDER BY i)
), grams AS (
  SELECT lang, [w] AS p, count(*) AS f FROM ahead GROUP BY ALL
  UNION ALL SELECT lang, [w, w2], count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w, w2, w3], count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w, w2, w3, w4], count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w, w2, w3, w4, w5], count(*) FROM ahead WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM grams WHERE len(p) > 1
), scores AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, s.n, (1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.p = c.p[:c.k] JOIN grams y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN sizes s ON s.lang = c.lang
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, p[:len(p) - 1] AS p, f AS a FROM grams WHERE len(p) > 2 UNION SELECT lang, p[2:], f FROM grams WHERE len(p) > 2
), kept AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.p = b.p AND i.a = b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
