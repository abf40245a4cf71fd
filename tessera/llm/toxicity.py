"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed vectors of the word and of its character n-grams; a long
run without spaces (a clause, in some scripts) is a row of overlapping pieces that count as words, so
that all of it is seen.  Filters
of several widths run over the words, each keeps its maximum, and a logistic layer scores them.
Training starts on the driver from a sample of labelled rows, bounded in rows and bytes (`sample_rows`,
`sample_bytes`), and goes on over all of them in shards, whose models are averaged; scoring covers every whole text in Arrow batches and shuffles nothing.
Texts meet their labels and their shard in one shuffle, before which LABEL_BITS bits leave out most texts without a label.  Thresholds are calibrated on
held-back training rows for each language, which is guessed from the text's function words: labels,
lang, source and id never enter a score.  The calibrated score is 0.7 at a language's threshold.

Defined results: a null or empty text is scored as one blank word; documents with several labels
count as toxic if one says so, labels that are null do not count; without labels of both classes
every score is 0; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_texts, release, small_batches, table, text_frame, trim

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
GRAMS = (3, 4, 5, 6, 7)  #: bytes
LONGEST, STEP = 24, 12  #: bytes of a word; longer runs are split into pieces of that size that begin every STEP bytes
CUT = 0.7
DROPPED = 0.5  #: share of words blanked in a training step
INITIAL = 0.2  #: spread of the untrained table; small, so that words never trained on hardly count
#: Function words by which the language of a text is guessed.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with"),
    "de": ("der", "die", "und", "das", "ist", "mit", "ein", "eine", "zu", "auf"),
    "fr": ("le", "la", "les", "et", "des", "est", "que", "pour", "dans", "une"),
    "es": ("el", "los", "las", "y", "que", "una", "por", "con", "para", "del"),
}

#: Lower-case letter, digit or part of a character beyond ASCII, for each byte; 0 parts words.
_FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


TILE = 4096


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base up to n, as factors: of the multiples of TILE, and of what is left."""
    low = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(TILE - 1, base))), dtype=np.uint64)
    step = low[-1:] * base
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.repeat(step, max(0, -(-n // TILE) - 1)))), dtype=np.uint64), low


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where words, and the pieces of longer runs, start and end, and whether they begin and end their runs."""
    many = 1 + np.maximum(-(-(end - start - LONGEST) // STEP), 0)
    run = np.repeat(np.arange(len(start)), many)
    place = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    begin = start[run] + STEP * place
    return begin, np.minimum(begin + LONGEST, end[run]), place == 0, place == many[run] - 1


class Words:
    """The words of a block of UTF-8 texts: ids into its distinct words, and the hashed features of those.

    A substring's hash is a difference of prefix sums of a polynomial, so words and n-grams are
    hashed for the whole block at once.  Word 0 is blank: it pads every text and stands for one
    without words.
    """

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        folded = _FOLD[joined]
        edge = np.zeros(1, np.int8)
        inside = np.concatenate((edge, (folded > 0).view(np.int8), edge))
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        n = len(joined)
        self.back = powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        high, low = powers(_BASE, n)
        for k in range(0, n, 64 * TILE):  # some tiles at a time, for the sake of memory
            part = folded[k : k + 64 * TILE].astype(np.uint64)
            part += np.uint64(1)
            part *= np.multiply.outer(high[k // TILE : k // TILE + 64], low).reshape(-1)[: len(part)]
            np.cumsum(part, out=self.sums[k + 1 : k + 1 + len(part)])
            self.sums[k + 1 : k + 1 + len(part)] += self.sums[k]
        start, end, left, right = pieces(start, end)
        hashes = self.between(start, end)
        part = np.flatnonzero(~(left & right))
        hashes[part] = mixed(hashes[part] + (1 + left[part] + 2 * right[part]).astype(np.uint64) * _BASE)
        self.hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
        self.ids, self.real, self.begin = self.laid_out(inverse + 1)
        self.features, self.starts = self.featured(start[first], end[first], left[first], right[first])
        del self.back, self.sums

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.back
        return mixed((self.sums[end] - self.sums[start]) * high[start // TILE] * low[start % TILE])

    def laid_out(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids with padding after each text, which of the places are words, and where texts begin."""
        sizes = np.maximum(self.counts, 1) + PAD
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ids, real = np.zeros(sizes.sum(), np.int64), np.zeros(sizes.sum(), bool)
        before = np.cumsum(self.counts) - self.counts
        at = np.arange(len(found)) + np.repeat(begin - before, self.counts)
        ids[at] = found
        real[at] = True
        real[begin[self.counts == 0]] = True
        return ids, real, begin

    def featured(self, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of each distinct word and where they start: the word itself, and n-grams, which know whether they begin or end it (a piece of a run: the run, as left and right say)."""
        parts, counts = [np.zeros(1, np.int32)], [np.ones(1, np.int64)]
        for k in range(0, len(start), at_once):
            begin, stop = start[k : k + at_once], end[k : k + at_once]
            first, last = left[k : k + at_once], right[k : k + at_once]
            size = stop - begin
            owners, buckets = [np.arange(len(begin))], [mixed(self.hashes[k : k + at_once] + np.uint64(1))]
            for n in GRAMS:
                many = np.maximum(size - n + 1, 0)
                owner = np.repeat(np.arange(len(begin)), many)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[owner]
                kind = 4 * n + 2 * (first[owner] & (at == begin[owner])) + (last[owner] & (at + n == stop[owner]))
                owners.append(owner)
                buckets.append(mixed(self.between(at, at + n) + kind.astype(np.uint64)))
            owner = np.concatenate(owners)
            parts.append((np.concatenate(buckets)[np.argsort(owner, kind="stable")] % np.uint64(BUCKETS)).astype(np.int32))
            counts.append(np.bincount(owner, minlength=len(begin)))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


PAD = max(WIDTHS) - 1


def in_blocks(texts: list[bytes], at_once: int) -> Iterator[list[bytes]]:
    """The texts in runs of about at_once bytes."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > at_once:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


@dataclass
class Sample:
    """The words of many texts, put together from blocks so that only one block's working memory is needed at a time."""

    ids: np.ndarray
    real: np.ndarray
    begin: np.ndarray
    features: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], at_once: int = 1 << 18) -> Sample:
        blocks = [Words(part) for part in in_blocks(texts, at_once)]
        distinct, first, inverse = np.unique(np.concatenate([b.hashes for b in blocks]), return_index=True, return_inverse=True)
        # A word's id is its place among first places, for in that order its features are gathered.
        named = 1 + np.argsort(np.argsort(first, kind="stable"), kind="stable")[inverse]
        ids, begin, lists, sizes, at, place = [], [], [blocks[0].features[:1]], [np.ones(1, np.int64)], 0, 0
        for b in blocks:
            n = len(b.hashes)
            ids.append(np.concatenate((np.zeros(1, np.int64), named[at : at + n]))[b.ids].astype(np.int32))
            begin.append(b.begin + place)
            # Of words that several blocks have, the first one's features serve.
            mine = np.zeros(n + 1, bool)
            mine[1 + first[(first >= at) & (first < at + n)] - at] = True
            many = np.diff(b.starts)
            lists.append(b.features[np.repeat(mine, many)])
            sizes.append(many[mine])
            at, place = at + n, place + len(b.ids)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return cls(np.concatenate(ids), np.concatenate([b.real for b in blocks]), np.concatenate(begin), np.concatenate(lists), starts)


@dataclass
class Model:
    table: np.ndarray  #: BUCKETS x SIZE
    filters: list[np.ndarray]  #: for each width, width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)  #: of the raw logit, by guessed language; "" for others

    def words(self, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.table[feats], starts[:-1], axis=0) / np.diff(starts)[:, None].astype(self.table.dtype)

    def light(self) -> Model:
        """The same in single precision, for scoring."""
        return replace(self, table=self.table.astype(np.float32), filters=[w.astype(np.float32) for w in self.filters])

    def projected(self, feats: np.ndarray, starts: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """project(words(...)), some words at a time, which keeps it in the processor's cache."""
        cuts = range(0, len(starts) - 1, at_once)
        return np.vstack([self.project(self.words(feats[starts[k] : starts[min(k + at_once, len(starts) - 1)]], starts[k : k + at_once + 1] - starts[k])) for k in cuts])

    def project(self, embedded: np.ndarray) -> np.ndarray:
        """What a word adds to each filter at each of its places: one block of FILTERS columns per width and place."""
        # einsum adds each row up alike wherever it stands, so that equal texts get equal scores.
        return np.hstack([np.einsum("ws,sf->wf", embedded, w[k]) for w in self.filters for k in range(len(w))])


def new_model(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    return Model(rng.normal(0, INITIAL, (BUCKETS, SIZE)), [rng.normal(0, 0.5 / math.sqrt(w), (w, SIZE, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0)


def responses(projected: np.ndarray, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Filter responses at each position; `real` is False on the padding that follows each text."""
    out, column, n = [], 0, len(ids)
    for width in WIDTHS:
        total = projected[ids, column : column + FILTERS].copy()
        for k in range(1, width):
            column += FILTERS
            total[: n - k] += projected[ids[k:], column : column + FILTERS]
        column += FILTERS
        out.append(total)
    joined = np.hstack(out)
    joined[~real] = -np.inf
    return joined


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = 8, least_steps: int = 600, batch: int = 48, rate: float = 0.03, start: Model | None = None, share: float | None = None) -> Model:
    """Adam on the logistic loss, both classes weighing alike; the table is updated where a batch touches it.

    It goes on from a start, if there is one, which is changed; share is that of label 1 if these rows are a part only.
    """
    model, rng = start or new_model(seed), np.random.default_rng(seed)
    words = Sample.of([t.encode() for t in texts])
    feats, starts = words.features, words.starts
    stops = np.append(words.begin[1:], len(words.ids))
    share = labels.mean() if share is None else share
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    dense = [*model.filters, model.bias, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    first, second = np.zeros_like(model.table), np.zeros_like(model.table)
    step = 0
    epochs = max(epochs, -(-least_steps * batch // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        pace = rate * (1 - 0.8 * epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            places = [np.arange(words.begin[r], stops[r]) for r in rows]
            begin = np.concatenate(([0], np.cumsum([len(p) for p in places])[:-1]))
            places = np.concatenate(places)
            ids, real = words.ids[places], words.real[places]
            ids[rng.random(len(ids)) < DROPPED] = 0
            used, local = np.unique(ids, return_inverse=True)
            sizes = starts[used + 1] - starts[used]
            own = np.concatenate(([0], np.cumsum(sizes)))
            own_feats = feats[np.repeat(starts[used] - own[:-1], sizes) + np.arange(own[-1])]
            embedded = model.words(own_feats, own)
            found = responses(model.project(embedded), local, real)
            ends = np.append(begin[1:], len(ids))
            where = np.stack([a + found[a:b].argmax(axis=0) for a, b in zip(begin, ends, strict=True)])
            top = np.take_along_axis(found, where, axis=0) + model.bias
            hidden = np.tanh(top)
            logit = hidden @ model.out + model.shift
            error = (1 / (1 + np.exp(-logit)) - labels[rows]) * weight[rows] / len(rows)
            d_out = hidden.T @ error + 1e-4 * model.out
            d_top = error[:, None] * model.out * (1 - hidden**2)
            d_filters, d_words = [np.zeros_like(w) for w in model.filters], np.zeros_like(embedded)
            for j, width in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                for k in range(width):
                    place = local[np.minimum(where[:, cols] + k, len(ids) - 1)]
                    g = d_top[:, cols]
                    d_filters[j][k] = np.einsum("bfs,bf->sf", embedded[place], g)
                    np.add.at(d_words, place, g[:, :, None] * model.filters[j][k].T[None])
            touched = np.flatnonzero(np.abs(d_words).sum(axis=1))
            d_table = np.zeros((0, SIZE))
            rows_hit = np.zeros(0, np.int64)
            if len(touched):
                spread = np.repeat(d_words[touched] / sizes[touched][:, None], sizes[touched], axis=0)
                hit = np.concatenate([own_feats[own[t] : own[t + 1]] for t in touched])
                rows_hit, to = np.unique(hit, return_inverse=True)
                d_table = np.zeros((len(rows_hit), SIZE))
                np.add.at(d_table, to, spread)
            step += 1
            fix = pace * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, (m, v), g in zip(dense, moments, [*d_filters, d_top.sum(axis=0), d_out], strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= fix * m / (np.sqrt(v) + 1e-8)
            if len(rows_hit):
                first[rows_hit] += 0.1 * (d_table - first[rows_hit])
                second[rows_hit] += 0.001 * (d_table**2 - second[rows_hit])
                model.table[rows_hit] -= fix * first[rows_hit] / (np.sqrt(second[rows_hit]) + 1e-8)
            model.shift -= pace * float(error.sum())
    return model


_MARKS = {name: Words([" ".join(known).encode()]).hashes for name, known in FUNCTION_WORDS.items()}


def logits(model: Model, texts: list[bytes], at_once: int = 1 << 20) -> tuple[np.ndarray, list[str]]:
    """Raw logits and guessed languages of UTF-8 texts, in blocks of about at_once bytes."""
    out, languages = [], []
    names, light = list(FUNCTION_WORDS), model.light()
    for part in in_blocks(texts, at_once):
        words = Words(part)
        projected = light.projected(words.features, words.starts)
        top = np.maximum.reduceat(responses(projected, words.ids, words.real), words.begin, axis=0) + model.bias
        out.append(np.einsum("bf,f->b", np.tanh(top), model.out) + model.shift)
        known = np.zeros((len(words.hashes) + 1, len(names)), np.int32)
        for k, name in enumerate(names):
            known[1:, k] = np.isin(words.hashes, _MARKS[name])
        counts = np.add.reduceat(known[words.ids], words.begin, axis=0)
        languages += [names[c.argmax()] if c.max() else "" for c in counts]
    return np.concatenate(out) if out else np.zeros(0), languages


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    raw, languages = logits(model, texts)
    cut = np.array([model.thresholds.get(x, model.thresholds[""]) for x in languages])
    return 1 / (1 + np.exp(-np.clip(raw - cut + math.log(CUT / (1 - CUT)), -30, 30)))


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap around it."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(labels.sum(), 1))
    best = int(f1.argmax())
    low = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
    return float((logits[order[best]] + low) / 2)


def fit(texts: list[str], labels: list[int], seed: int = 7, least: int = 20) -> Model | None:
    """Train on four fifths of the sample, calibrate thresholds on the rest; None without both classes."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return None
    held = np.array([zlib.crc32(t.encode()) % 5 == 0 for t in texts])
    if len(set(y[~held])) < 2:
        held[:] = False
    model = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held], seed)
    check = held if len(set(y[held])) == 2 else np.ones(len(texts), dtype=bool)
    raw, languages = logits(model, [t.encode() for t, h in zip(texts, check, strict=True) if h])
    y, languages = y[check], np.array(languages)
    model.thresholds = {"": threshold(raw, y)}
    for name in FUNCTION_WORDS:
        mine = languages == name
        if min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= least:
            model.thresholds[name] = threshold(raw[mine], y[mine])
    trim()
    return model


def usable_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id and toxic of the labelled documents that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    return known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 2400, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of at most sample_rows labelled documents, up to half of them toxic, none of them held out.

    Texts are taken in the order of a hash until they come to sample_bytes; none is longer than a 64th part of that.
    """
    usable = usable_labels(labels, id_col, label_col)
    ids: dict[int, int] = {}
    for toxic in (1, 0):
        for r in usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2).collect():  # bounded by sample_rows
            ids[r["doc_id"]] = toxic
    if not ids:
        return [], []
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    upto = F.sum(F.octet_length("text")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sample = text_frame(docs, id_col, text_col).where(F.col("doc_id").isin(*ids) & (F.octet_length("text") <= sample_bytes // 64)).dropDuplicates(["doc_id", "text"])
    sample = sample.orderBy(*order).limit(sample_rows).withColumn("_upto", upto).where(F.col("_upto") <= sample_bytes)
    rows = sample.orderBy("doc_id", "text").select("doc_id", "text").collect()  # bounded by sample_rows and sample_bytes
    return [r["text"] for r in rows], [ids[r["doc_id"]] for r in rows]


PARTS = 64  #: of the table, each averaged by itself
STEP_BYTES = 1 << 20  #: of text that are made words at once in training


def dense(model: Model) -> np.ndarray:
    return np.concatenate([*(w.ravel() for w in model.filters), model.bias, model.out, [model.shift]])


LABEL_BITS = 1 << 24  #: bits that tell most texts without a label before the shuffle


def label_bits(usable: DataFrame) -> np.ndarray:
    """LABEL_BITS bits, of which each doc_id sets one; at most LABEL_BITS / 64 rows come to the driver."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(LABEL_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    found = usable.groupBy(F.floor(at / 64).alias("at")).agg(F.bit_or(one).alias("bits")).toPandas()
    bits = np.zeros(LABEL_BITS // 64, np.uint64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def labelled_shards(texts: DataFrame, usable: DataFrame, shards: int) -> DataFrame:
    """shard, doc_id, text and toxic of all rows (doc_id, text) that have a label: a partition for each shard, mixed by a hash.

    Both sides of the join are dealt by doc_id to the shards, so the texts are shuffled once, and
    only those that the bits let through; the join tells the rest.  A shard's rows and their order are the same however rows arrive.
    """
    shared = texts.sparkSession.sparkContext.broadcast(label_bits(usable))  # LABEL_BITS bits, however many labels there are

    @F.pandas_udf("boolean")
    def may_have(at: pd.Series) -> pd.Series:
        where = at.to_numpy(np.int64)
        return pd.Series(((shared.value[where >> 6] >> (where & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))

    likely = small_batches(texts).where(F.col("doc_id").isNotNull()).where(may_have(F.pmod(F.xxhash64("doc_id"), F.lit(LABEL_BITS))))
    rows = likely.repartition(shards, "doc_id").join(usable.repartition(shards, "doc_id").hint("merge"), "doc_id")
    return cut(rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text", "toxic").sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id", "text"))


def trained_shards(rows: DataFrame, start: Model, share: float) -> DataFrame:
    """part and delta (float32 bytes) of every shard's model against the start, each trained on all rows (labelled_shards) of its shard."""
    shared = rows.sparkSession.sparkContext.broadcast(start)  # of fixed size

    def told(model: Model) -> pa.RecordBatch:
        parts = np.split((model.table - shared.value.table).astype(np.float32), PARTS)
        deltas = [*parts, (dense(model) - dense(shared.value)).astype(np.float32)]
        return pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array([d.tobytes() for d in deltas], pa.binary())], ["part", "delta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model, texts, y, size = None, None, [], [], 0

        def step() -> None:
            nonlocal texts, y, size
            if texts:
                train(texts, np.array(y, np.float64), epochs=1, least_steps=0, rate=0.005, start=model, share=share)
            texts, y, size = [], [], 0

        for batch in batches:
            for own, text, toxic in zip(*(batch[c].to_pylist() for c in ("shard", "text", "toxic")), strict=True):
                if own != shard:
                    if model is not None:
                        step()
                        yield told(model)
                    shard, model = own, copy.deepcopy(shared.value)
                texts.append(text)
                y.append(toxic)
                size += len(text)
                if size >= STEP_BYTES:
                    step()
        if model is not None:
            step()
            yield told(model)
        trim()

    return small_batches(rows.select("shard", "text", "toxic")).mapInArrow(run, "part int, delta binary")


def averaged(deltas: DataFrame) -> dict[int, np.ndarray]:
    """The mean change of each part over shards; of a row of the table, over the shards that changed it."""

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        total, many = 0.0, 0
        for d in frame["delta"]:
            one = np.frombuffer(d, np.float32).astype(np.float64)
            one = one.reshape(-1, SIZE) if frame["part"].iloc[0] < PARTS else one[None]
            total, many = total + one, many + (one != 0).any(axis=1)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "delta": [(total / np.maximum(many, 1)[:, None]).tobytes()]})

    return {r["part"]: np.frombuffer(r["delta"], np.float64) for r in deltas.groupBy("part").applyInPandas(mean, "part int, delta binary").collect()}  # of fixed size


def calibrated(model: Model, rows: DataFrame, least: int = 20) -> dict[str, float]:
    """Thresholds by guessed language from all rows (text, toxic): counts for each 64th of a logit, of which there are 2^14 at most."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, languages = logits(shared.value, [t.encode() for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(np.asarray(raw, np.float64)), batch["toxic"]], ["lang", "raw", "toxic"])
        trim()

    told = small_batches(rows.select("text", "toxic")).mapInArrow(run, "lang string, raw double, toxic int")
    at = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-127.0)), F.lit(127.0)) * 64)
    bins = told.groupBy("lang", at.alias("at")).agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).toPandas()  # of bounded size

    def cut(own: pd.DataFrame) -> float:
        own = own.groupby("at").agg({"hits": "sum", "n": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
        f1 = 2 * own["hits"].cumsum() / (own["n"].cumsum() + max(own["hits"].sum(), 1))
        best = int(f1.to_numpy().argmax())
        low = own["low"].iloc[best]
        return float((low + (own["high"].iloc[best + 1] if best + 1 < len(own) else low - 1)) / 2)

    found = {"": cut(bins)}
    for name in FUNCTION_WORDS:
        own = bins[bins["lang"] == name]
        if min(own["hits"].sum(), (own["n"] - own["hits"]).sum()) >= least:
            found[name] = cut(own)
    return found


def learn(docs: DataFrame, labels: DataFrame, shard_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **sample: int) -> Model | None:
    """A model that all labelled rows have trained, but for those held out, with thresholds from all that are held back.

    The model of a sample is where the training starts.  From there each shard of the rows trains
    a model of its own, and their mean is taken; all rows that are held back, a fifth by their texts, then set the thresholds.
    """
    start = fit(*training_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **sample))
    if start is None:
        return None
    spark = docs.sparkSession
    texts = text_frame(docs, id_col, text_col).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    usable = cut(usable_labels(labels, id_col, label_col))
    rows = labelled_shards(texts, usable, max(1, -(-usable.count() // shard_rows))).withColumn("back", F.crc32(F.encode("text", "UTF-8")) % 5 == 0)
    count = {r["back"]: (r["n"], r["hits"]) for r in rows.groupBy("back").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).collect()}  # two rows
    both = lambda back: back in count and 0 < count[back][1] < count[back][0]
    n, hits = count[False] if both(False) else (sum(c[0] for c in count.values()), sum(c[1] for c in count.values()))
    changes = averaged(trained_shards(rows.where("not back") if both(False) else rows, start, hits / n))
    start.table += np.concatenate([changes[k].reshape(-1, SIZE) for k in range(PARTS)])
    vector, at = dense(start) + changes[PARTS], 0
    for w in (*start.filters, start.bias, start.out):
        w[...] = vector[at : at + w.size].reshape(w.shape)
        at += w.size
    start.shift = float(vector[-1])
    start.thresholds = calibrated(start, rows.where("back") if both(True) else rows)
    del rows, usable, texts
    release(spark)
    return start


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def each(ids: list, texts: list[bytes]) -> dict:
        return {"doc_id": ids, "score": scores(shared.value, texts) if shared.value is not None else [0.0] * len(ids)}

    scored = map_texts(text_frame(docs, id_col, text_col), each, "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score stays under the cut, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        trim()
        return pd.Series(scores(shared.value, [t.encode() for t in texts]) if shared.value is not None else [0.0] * len(texts), dtype="float64")

    return small_batches(docs).where(scored(F.coalesce(F.col(text_col), F.lit(""))) < CUT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
