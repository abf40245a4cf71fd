"""Periodic runs of words by a suffix automaton whose states keep ordered sets of end positions.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
keeping period q; it counts from a least length and from a least number of periods on.  The
automaton's states stand for the distinct stretches of words; a state's end positions are the union
of those of the states that link to it, merged from the smaller into the larger set.  Where the
merge makes i < j new neighbours in the state of length n, n words end alike at both places and one
more does not; if the distance q = j - i does not exceed n, the words from i - n + 1 to j have period
q: a square, and more if n is larger.  The state's length already extends it as far to the left as
it goes, so the run is whole as soon as the words after i and j differ, and each run has exactly one
such pair of neighbours.  Merging a third set may later part two neighbours; such a stretch has a
smaller period, and only its smallest is kept.

With four periods and six words at least, every three neighbouring words of a run stand in the text
three times or more.  So an automaton is built for each stretch of words of which that holds and for
no others; a run lies in one such stretch, and no word beside the stretch extends it.  Work and memory of a
document are in proportion to its words but for a logarithm; documents are independent of each other,
so there is no shuffle.

Defined results: a null or empty text has no words and no runs; repeated rows each return the same;
a null id stays null; other columns are ignored; an empty table gives no rows.  One very long text is
one task's work, with some hundred bytes for each word of its periodic stretches.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, text_frame
from .neardup import WordHashes, mixed

LEAST, PERIODS = 6, 4  #: words and periods that a run has at least
CHUNK = 512

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Places:
    """An ordered set of end positions, in chunks, so that an insertion moves a bounded number of them."""

    __slots__ = ("chunks", "last", "size")

    def __init__(self, first: int) -> None:
        self.chunks, self.last, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put x in; the places before and after it, or -1."""
        chunks, last = self.chunks, self.last
        k = bisect_left(last, x)
        if k == len(last):
            k -= 1
        chunk = chunks[k]
        at = bisect_left(chunk, x)
        before = chunk[at - 1] if at else last[k - 1] if k else -1
        after = chunk[at] if at < len(chunk) else -1
        chunk.insert(at, x)
        last[k] = chunk[-1]
        self.size += 1
        if len(chunk) > CHUNK:
            half = len(chunk) // 2
            chunks[k : k + 1] = [chunk[:half], chunk[half:]]
            last[k : k + 1] = [chunk[half - 1], chunk[-1]]
        return before, after

    def __iter__(self):  # noqa: ANN204
        for chunk in self.chunks:
            yield from chunk


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Length, link and first end position (-1 for copies of states) of the states of the words' suffix automaton."""
    length, link, ends, moves = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        ends.append(i)
        moves.append({})
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(-1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, ends


def stretch_runs(words: list, least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """(start, length, period) of the runs of a stretch of words."""
    length, link, ends = automaton(words)
    n, best = len(words), {}
    sets: list[Places | None] = [Places(e) if e >= 0 else None for e in ends]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, own = link[state], sets[state]
        sets[state] = None
        if not up:
            continue  # the words of these stretches end alike nowhere else
        other = sets[up]
        if other is None or own is None:
            sets[up] = own or other
            continue
        if other.size < own.size:
            own, other = other, own
        common, own_before = length[up], -1
        for x in own:
            before, after = other.add(x)
            if before == own_before:
                before = -1  # these two were neighbours already
            own_before = x
            for i, j in ((before, x), (x, after)):
                q = j - i
                if i < 0 or j < 0 or q > common or common + q < least or common + q < periods * q:
                    continue
                if j + 1 < n and words[i + 1] == words[j + 1]:
                    continue  # it goes on: its last pair tells
                at = i - common + 1, common + q
                if best.get(at, q) >= q:
                    best[at] = q
        sets[up] = other
    return sorted((start, size, q) for (start, size), q in best.items())


def stretches(words: list[bytes], hashes: WordHashes) -> list[tuple[int, int]]:
    """(start, stop) of the stretches whose three-word windows all stand in the text three times or more; nothing else can hold a run."""
    if len(words) < LEAST:
        return []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    windows = h[:-2] + mixed(h[1:-1] * np.uint64(3)) + mixed(h[2:] * np.uint64(5))  # equal hashes of different windows only add work
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    first = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]))
    held = np.empty(len(s), bool)
    held[order] = np.repeat(np.diff(first) >= PERIODS - 1, np.diff(first))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], held.view(np.int8), [0]))))
    return [(a, b + 2) for a, b in edges.reshape(-1, 2).tolist() if b + 2 - a >= LEAST]


def runs(words: list[bytes], hashes: WordHashes) -> list[Run]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    found = []
    for a, b in stretches(words, hashes):
        found += [(a + start, size, q) for start, size, q in stretch_runs(words[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    if found:
        step = np.zeros(len(words) + 1, np.int64)
        for start, size, q in found:
            step[start + q] += 1
            step[start + size] -= 1
        words = [w for w, gone in zip(words, np.cumsum(step).tolist(), strict=False) if not gone]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text with each run cut to its first period.

    rewrite, if given, changes the words of a document (by id) beforehand.
    """

    def each(ids: list, texts: list[bytes], hashes: WordHashes) -> dict:
        out: dict = {k: [] for k in ("n_words", "runs", "collapsed")}
        for doc_id, text in zip(ids, texts, strict=True):
            words = text.split()  # bytes: the ASCII white space only
            if rewrite:
                words = rewrite(doc_id, words)
            found = runs(words, hashes)
            out["n_words"].append(len(words))
            out["runs"].append([{"start": s, "length": size, "period": q} for s, size, q in found])
            out["collapsed"].append(collapsed(words, found))
        return {"doc_id": ids, **out}

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())]
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    made = map_texts(text_frame(docs, id_col, text_col), each, schema, pa.schema(fields), WordHashes)
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in one document of ten, as the id's checksum says; a row without an id is left as it is."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs: n_runs, the longest run (then the first, then that of the smallest period), and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.array_join(told, "").alias("_runs"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2("_runs", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), planted))
