"""Best-fit packing of token sequences by minimum bin slack.

Every document becomes token ids (plus an end id), cut into pieces only where it is longer than a
sequence.  How many pieces there are of each length is one aggregate of at most `capacity` rows, so
the packing is planned on that histogram whatever the size of the corpus: minimum bin slack fills
one bin at a time, finding with a bitset subset-sum dynamic programme the fullest feasible
combination of the available lengths, and removes it.  A combination is taken as often as its
lengths last, so the plan has a bounded number of patterns.  Pieces are then ranked within their
length (salted, since a length may hold a third of all rows) and find their bin and offset from
their rank alone.

Defined results: a null or empty text is the single end id; equal rows are packed separately; an
empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_texts, table, text_frame

CAPACITY = 4096
END_ID = 1
CACHED = 50_000
LOT = 4 << 20  #: bytes of text that are tokenised together
FEW = 4096  #: bytes of a lot below which its chunks are looked up one by one
PUNCTUATION = b".,;:!?*#%&$"
LOWER = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower())
#: A chunk that is a word of lower-case letters and punctuation; any other has empty groups.
PLAIN = re.compile(f"^(?:([{LOWER}]+)([{re.escape(PUNCTUATION.decode())}]*)|.*)$", re.MULTILINE)
PLAIN_PARTS = f"^(?P<word>[{LOWER}]+)(?P<tail>[{re.escape(PUNCTUATION.decode())}]*)$"


def word_merges(tokenizer) -> tuple:  # noqa: ANN001
    """The tokenizer's merges as a rank file of bytes, for words of letters, and which ids end a word.

    Ids are in the order of the merges, so they are the ranks; the end of a word is byte 1, which
    merges first.  tiktoken runs such merges several times as fast as the tokenizer itself; tests
    hold the ids to the tokenizer's.
    """
    import tiktoken

    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    # Bytes without a printable character stand at 256 and after, in their order.
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks, ends = {}, np.zeros(tokenizer.get_vocab_size(), bool)
    for token, rank in sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda t: t[1]):
        last = token.endswith("</w>") and len(token) > 4
        if not token.startswith("<|"):
            ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + b"\1" * last] = rank
            ends[rank] = last
    return tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}), ends


class WordIds(dict):
    """Ids, as little-endian 32-bit bytes, of the chunks between ASCII white space.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    chunks.  A chunk that is a word with ASCII punctuation after it is put together from both, for the
    tokenizer parts them and folds case.  Texts go in lots: a lot's distinct chunks are found, told
    apart, encoded and put together by Arrow, and nothing of them is kept, for most distinct chunks are rare
    and a worker's memory is not.  Only chunks that aren't plain, and those of very small lots, stay known. When too
    many are known those that came first stay, for frequent ones come early.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.mark, self.mark_id = "<|startoftext|>", self.tokenizer.token_to_id("<|startoftext|>")
        self.words: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.merges, self.ends = word_merges(self.tokenizer)

    def learn(self, new: set[bytes]) -> None:
        listed = list(new)
        found = PLAIN.findall(b"\n".join(listed).lower().decode())
        words = list(filterfalse(self.plain.__contains__, {w for w, _ in found if w}))
        for at in range(0, len(words), 8192):
            self.encode_plain(words[at : at + 8192])
        ends = {t for _, t in found if t}
        self.learn_odd([*(c for c, (w, _) in zip(listed, found, strict=True) if not w), *filterfalse(self.__contains__, (t.encode() for t in ends))])
        plain, tails = self.plain, {t: self[t.encode()] for t in ends} | {"": b""}
        self.update([(c, plain[w] + tails[t]) for c, (w, t) in zip(listed, found, strict=True) if w])

    def encode_plain(self, words: list[str]) -> None:
        ids = self.merges.encode_to_numpy("\1".join([*words, ""]))
        data, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        self.plain.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def forget(self) -> None:
        """Keep a third of what may be known, once it is more."""
        if len(self) > CACHED:
            kept = list(islice(self.items(), CACHED // 3))
            self.clear()
            self.update(kept)
            self.plain.clear()
            self.words.clear()

    def learn_odd(self, new: list[bytes]) -> None:
        known, parts = self.words, {}
        for c in new:
            word = c.rstrip(PUNCTUATION)
            if len(word) == len(c):
                parts[c] = c.lower() if c.isascii() else c
            elif word and self.closed(word):
                parts[c] = word.lower()
            else:
                parts[c] = c
        wanted = set(parts.values())
        wanted.update([c[len(w) :] for c, w in parts.items() if len(w) < len(c)])
        unknown = list(wanted.difference(known))
        for at in range(0, len(unknown), 1024):
            self.encode_all(unknown[at : at + 1024])
        for c, w in parts.items():
            self[c] = known[w] + known[c[len(w) :]] if len(w) < len(c) else known[w]

    @staticmethod
    def closed(word: bytes) -> bool:
        """Whether punctuation after the word is sure to be parted from it, and its case to be folded bytewise."""
        last = word[-1]
        if b"<|" in word:
            return False
        if last < 128:
            return chr(last).isalnum()
        c = word[-2:].decode("utf-8", "replace")
        return len(c) == len(c.lower()) == 1 and c.isalpha() and ord(c) < 0x180

    def encode_all(self, words: list[bytes]) -> None:
        plain = [w for w in words if self.letters(w)]
        if plain:
            ids = np.array(self.merges.encode_ordinary(b"\1".join([*plain, b""]).decode()), dtype="<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1).tolist()
            for w, start, end in zip(plain, [0, *ends], ends, strict=False):
                self.words[w] = data[4 * start : 4 * end]
        odd = set(words).difference(plain)
        marked = [w for w in odd if b"<|" in w]
        odd = list(odd.difference(marked))
        if odd:
            ids = np.array(self.encode([self.mark.join([w.decode() for w in odd])], add_special_tokens=False)[0].ids, dtype="<u4")
            data, cuts = ids.tobytes(), np.flatnonzero(ids == self.mark_id).tolist()
            for w, start, end in zip(odd, [-1, *cuts], [*cuts, len(ids)], strict=True):
                self.words[w] = data[4 * start + 4 : 4 * end]
        for w in marked:
            self.words[w] = np.array(self.encode([w.decode()], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    @staticmethod
    def letters(word: bytes) -> bool:
        """Whether it is one run of lower-case Latin letters, which the tokenizer neither parts nor changes."""
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode()
        return text.isalpha() and max(text) < "\u0180" and text == text.lower()

    def encoded_words(self, words: pa.StringArray, at_once: int = 8192) -> pa.LargeBinaryArray:
        """The ids of words of lower-case letters."""
        out = []
        for at in range(0, len(words), at_once):
            part = words[at : at + at_once]
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), pa.scalar("\1", part.type))[0].as_py()
            ids = self.merges.encode_to_numpy(joined + "\1").astype("<u4", copy=False)
            ends = np.concatenate(([0], 4 * np.flatnonzero(self.ends[ids]) + 4))
            out.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def encoded_chunks(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each of the chunks; none for an empty one."""
        parts = pc.extract_regex(pc.ascii_lower(chunks), PLAIN_PARTS)
        odd = parts.is_null()
        words, tails = (c.filter(parts.is_valid()).dictionary_encode() for c in parts.flatten())
        listed = [c.encode() for c in chunks.filter(odd).to_pylist()]
        ends = [t.encode() for t in tails.dictionary.to_pylist()]
        self[b""] = b""
        self.learn_odd(list(filterfalse(self.__contains__, dict.fromkeys([*listed, *ends]))))
        ends = pa.array(map(self.__getitem__, ends), pa.large_binary()).take(tails.indices)
        joined = pc.binary_join_element_wise(self.encoded_words(words.dictionary).take(words.indices), ends, pa.scalar(b"", pa.large_binary()))
        every = pa.concat_arrays([joined, pa.array(map(self.__getitem__, listed), pa.large_binary())])
        is_odd = odd.to_numpy(zero_copy_only=False)
        return every.take(pa.array(np.where(is_odd, len(joined) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)))

    def lot(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        ids = self.encoded_chunks(chunks.dictionary).take(chunks.indices)
        cuts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def few(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new = set(filterfalse(self.__contains__, chain.from_iterable(split)))
        if new:
            self.learn(new)
        return [b"".join(map(self.__getitem__, chunks)) for chunks in split]

    def ids(self, texts: list[bytes], at_once: int = LOT) -> list[bytes]:
        out, start = [], 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= at_once):
                size += len(texts[stop])
                stop += 1
            self.forget()
            out += (self.lot if size > FEW else self.few)(texts[start:stop])
            start = stop
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The one of this process: a Python worker takes many tasks, and loading takes most of a second."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids of every piece of every document."""
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def each(ids: list, texts: list[bytes], words: WordIds) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, encoded in zip(ids, words.ids(texts), strict=True):
            encoded += end
            for k, at in enumerate(range(0, len(encoded), width)):
                part = encoded[at : at + width]
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                if keep_ids:
                    out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
        return out

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    return map_texts(docs, each, schema, pa.schema(fields), lambda: word_ids(tokenizer_path))


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """Of the available lengths (ascending), the combination whose sum comes closest to room from below.

    Bit s of `reach` says that s can be filled exactly; the bitset before every item is kept, to
    walk back to the items.  Copies of a length are taken in powers of two.
    """
    reach, mask, before = 1, (1 << (room + 1)) - 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        copies, step = min(left[length], room // length), 1
        while copies:
            take = min(step, copies)
            before.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            copies, step = copies - take, 2 * step
        if reach >> room:
            break
    filled, used = reach.bit_length() - 1, {}
    for was, length, take in reversed(before):
        if not was >> filled & 1:
            used[length] = used.get(length, 0) + take
            filled -= length * take
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY, fill: Callable = fullest) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) patterns that pack all pieces; the longest piece left opens each bin."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, patterns = sorted(left), []
    while lengths:
        first = lengths[-1]
        left[first] -= 1
        pattern = fill(lengths, left, capacity - first) if first < capacity else {}
        left[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[n] // c for n, c in pattern.items())
        patterns.append((times, pattern))
        for n, c in pattern.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]] if any(not left[n] for n in pattern) else lengths
    return patterns


def intervals(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length << 40 | first rank) and, for each, that rank, first bin, copies in a bin and first offset."""
    rows, taken, first_bin = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies, rank = pattern[length], taken.get(length, 0)
            rows.append((length << 40 | rank, rank, first_bin, copies, offset))
            taken[length] = rank + times * copies
            offset += copies * length
        first_bin += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))


def pack(parts: DataFrame, capacity: int = CAPACITY, per_salt: int = 50_000) -> DataFrame:
    """parts (doc_id, piece, length and others) with sequence_id and offset; parts should be materialised."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(16, -(-sum(counts.values()) // per_salt))
    plan = parts.sparkSession.sparkContext.broadcast(intervals(minimum_bin_slack(counts, capacity)))  # bounded by the number of lengths
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    ranked = salted.withColumn("_in_salt", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    by_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_salt.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in_salt")).drop("_salt", "_in_salt", "_before")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        keys, ranks, bins, copies, offsets = plan.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(keys, n << 40 | r, side="right") - 1
        r = r - ranks[k]
        return pd.DataFrame({"sequence_id": bins[k] + r // copies[k], "offset": offsets[k] + r % copies[k] * n})

    return ranked.withColumn("_place", place("length", "_rank")).withColumns({"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")}).drop("_place", "_rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece."""
    return pack(cut(pieces(text_frame(docs, id_col, text_col), tokenizer_path, capacity, end_id, keep_ids)), capacity)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(*COLUMNS)
