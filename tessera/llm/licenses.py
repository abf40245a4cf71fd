"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Terms of the templates are weighed by how many documents of the whole corpus hold them (one
aggregate, as many rows as the templates have terms); a common notice's own words keep the weight of
words that one document in twenty holds.  Every line of a text is compared, every window of consecutive
lines (blank ones aside) with at most twice as many words as the longest template, and the whole text, so notices are found wherever they stand,
however they are wrapped and however common they are.  What is left out is only what an upper bound of its
cosine rules out, which changes no result.  A text with a licence file's name, or of FILE_WORDS words and
more that is itself like a template, is a licence file, and covers its directory and all below that have
none of their own: directories are joined with their ancestors that hold a licence file and the deepest
one wins.  The joins are on distinct directories; only ids and paths take part, never texts.

Defined results: a null or empty text has no licence of its own; a null path lies in the root; of
several licence files in a directory the most similar one counts, then the smaller path; of equally
similar lines and windows of a text the one that begins first counts, then the shortest; repeated
rows each return the same; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Notices by which works name their licence, and openings and later passages of licence texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
NOTICE, FILE = 0.7, 0.45  #: least cosines of a notice and of a licence file
RARE = 0.05  #: terms but for function words weigh as if at most this share of documents held them
FILE_WORDS = 50  #: words of a licence file that has no licence file's name
SLACK = 1e-6  #: by how much bounds may be off in floating point
#: Function words of the templates; they mark no line.
STOP = frozenset("all and any are as at by can either except following for from has in into is it later may no not of on or that the this to under with without you".split())
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)[^/]*$"
WORD = re.compile(rb"[a-z0-9]+")


def terms(text: str) -> list[str]:
    return [w.decode() for w in WORD.findall(text.lower().encode())]


def document_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and how many hold each term."""
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+")
    held = F.concat(F.array(F.lit("")), F.array_remove(F.array_intersect(words, F.array(*map(F.lit, vocabulary))), ""))
    found = {r["term"]: r["n"] for r in docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per term
    return found.pop("", 0), found


class Matcher:
    def __init__(self, templates: dict[str, list[str]], total: int, counts: dict[str, int]) -> None:
        self.names = [name for name, texts in templates.items() for _ in texts]
        lists = [Counter(terms(t)) for texts in templates.values() for t in texts]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set().union(*lists)))}
        self.unknown = math.log(total + 1) + 1
        own = {w for w in self.vocabulary if len(w) > 1 and w not in STOP}
        held = {w: min(counts.get(w, 0), max(1, RARE * total)) if w in own else counts.get(w, 0) for w in self.vocabulary}
        self.idf = np.array([math.log((total + 1) / (held[w] + 1)) + 1 for w in self.vocabulary])
        #: Of each term the templates that hold it, and its weights there.
        held_by: dict[bytes, list[tuple[int, float]]] = {}
        for t, words in enumerate(lists):
            length = math.sqrt(sum((n * self.idf[self.vocabulary[w]]) ** 2 for w, n in words.items()))
            for w, n in words.items():
                held_by.setdefault(w.encode(), []).append((t, n * self.idf[self.vocabulary[w]] / length))
        self.postings = {w: (np.array([t for t, _ in p]), self.idf[self.vocabulary[w.decode()]] * np.array([x for _, x in p])) for w, p in held_by.items()}
        self.places = {w.encode(): k for w, k in self.vocabulary.items()}
        self.squares = {w: float(self.idf[k]) ** 2 for w, k in self.places.items()}
        self.most_words = 2 * max((sum(words.values()) for words in lists), default=0)

    def best(self, counted: Counter) -> tuple[float, int]:
        """The greatest cosine of a text's words to a template, and that template."""
        dots, square = np.zeros(len(self.names)), 0.0
        for w, n in counted.items():
            posting = self.postings.get(w)
            if posting is None:
                square += (n * self.unknown) ** 2
            else:
                dots[posting[0]] += n * posting[1]
                square += n * n * self.squares[w]
        cosines = dots / math.sqrt(square) if square else dots
        k = int(cosines.argmax())
        return round(float(cosines[k]), 9), k

    def lengths(self, counted: Counter) -> tuple[float, float]:
        """The squared lengths of a vector in the templates' terms and in all others."""
        known = others = 0.0
        for w, n in counted.items():
            square = self.squares.get(w)
            if square is None:
                others += (n * self.unknown) ** 2
            else:
                known += n * n * square
        return known, others

    def windows(self, words: list[int], known: list[float], others: list[float], need: float) -> Iterator[tuple[int, int]]:
        """(start, stop) of the windows of two lines and more whose cosine may reach `need`.

        Terms outside the templates only add to the length, at least what they add line by line; those of
        the templates add at most the sum of their lines' squares times the number of lines.  A window
        that begins or ends with a line without such terms is never better than without it.
        """
        n = len(words)
        if n < 2:
            return
        words_to, known_to, others_to = (np.concatenate(([0.0], np.cumsum(x))) for x in (words, known, others))
        holds = np.array(known) > 0
        share = need * need
        for size in range(2, n + 1):
            count = words_to[size:] - words_to[:-size]
            short = count <= self.most_words
            if not short.any():
                return
            most = size * (known_to[size:] - known_to[:-size])
            may = short & holds[: n - size + 1] & holds[size - 1 :] & (most >= share * (most + others_to[size:] - others_to[:-size]))
            for start in np.flatnonzero(may).tolist():
                yield start, start + size

    def scan(self, text: bytes) -> tuple[str | None, float, int | None, float, int]:
        """Licence, its similarity and line, the similarity of the whole text, and its words."""
        split = [(n, found) for n, line in enumerate(text.lower().split(b"\n")) if (found := WORD.findall(line))]
        lines = [Counter(found) for _, found in split]
        every = lines[0] if len(lines) == 1 else Counter()
        if len(lines) > 1:
            for counted in lines:
                every.update(counted)
        whole, j = self.best(every)
        need = (whole if whole >= FILE else NOTICE) - SLACK  # what stays below changes no result
        lengths = [self.lengths(counted) for counted in lines]
        enough = lambda known, others: known > 0 and known >= need * need * (known + others)
        tops = [(*self.best(counted), k, 1) for k, (counted, both) in enumerate(zip(lines, lengths, strict=True)) if enough(*both)]
        start, counted, stop = -1, Counter(), 0
        for a, b in sorted(self.windows([len(found) for _, found in split], [x for x, _ in lengths], [x for _, x in lengths], need)):
            if a != start:
                start, counted, stop = a, Counter(), a
            for part in lines[stop:b]:
                counted.update(part)
            stop = b
            if enough(*self.lengths(counted)):
                tops.append((*self.best(counted), a, b - a))
        score, k, line, _ = max(tops, key=lambda t: (t[0], -t[2], -t[3]), default=(whole, j, 0, 0))
        if whole > score:
            score, k, line = whole, j, 0
        size = sum(map(len, (found for _, found in split)))
        if score >= NOTICE or whole >= FILE:
            return self.names[k], score, split[line][0], whole, size
        return None, 0.0, None, whole, size


def scan(docs: DataFrame, path: Column, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, origin (own, inherited or none), similarity, line of the notice and the directory it comes from."""
    templates = templates or TEMPLATES
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in terms(t)})
    total, counts = document_counts(docs, vocabulary, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("licence", pa.string()), ("similarity", pa.float64()), ("line", pa.int64()), ("whole", pa.float64()), ("words", pa.int64())])

    def run(batches):  # noqa: ANN001, ANN202
        matcher = Matcher(templates, total, counts)
        for batch in batches:
            found = [matcher.scan(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], schema.field(k + 2).type) for k in range(5))], schema=schema)

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.mapInArrow(run, "doc_id long, path string, licence string, similarity double, line long, whole double, words long")
    own = cut(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))
    is_file = F.col("licence").isNotNull() & (((F.col("whole") >= FILE) & (F.col("words") >= FILE_WORDS)) | F.col("path").rlike(FILE_NAME))
    files = own.where(is_file).groupBy("dir").agg(F.min(F.struct((-F.col("whole")).alias("w"), "path", "licence")).alias("_f")).select(F.col("dir").alias("from_dir"), F.col("_f.licence").alias("_licence"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = own.select("dir").distinct().withColumn("_parts", parts).select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("_parts", F.lit(1), n), "/").alias("from_dir")))).alias("_a"))
    nearest = up.select("dir", "_a.*").join(files, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "_licence")).alias("_near"))
    joined = own.join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    return joined.select(
        "doc_id",
        F.coalesce("licence", "_near._licence").alias("licence"),
        F.when(has, "own").when(F.col("_near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("similarity")).otherwise(0.0).alias("similarity"),
        F.when(has, F.col("line")).alias("line"),
        F.when(~has, F.col("_near.from_dir")).alias("from_dir"),
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no paths: a document's is made of its source, its thousand and its id.
    path = F.concat_ws("/", "source", (F.col("doc_id") / 1000).cast("long").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents"), path)
