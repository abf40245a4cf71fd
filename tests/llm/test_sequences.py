"""Collocations, periodic runs and token files against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from support import rows
from test_queries import run
from test_texts import WORD_BPE

from tessera.llm import collocations, periodic, tokenfiles

sha = lambda b: hashlib.sha256(b).hexdigest()


def brute_phrases(rows, longest=5, least=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(fold)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, a in candidates.items():
        words = p[1:]
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                inner = (p[0], *words[i:j])
                if len(inner) < len(p) and a >= candidates[inner]:
                    dropped.add(inner)
    scores = {}
    for p, a in candidates.items():
        if p not in dropped:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, l, r = min(cuts)
            scores.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, k + 1, phrase.decode(), -a, l, r, n[lang], -score) for lang, found in scores.items() for k, (score, a, phrase, l, r) in enumerate(sorted(found)[:top]))


def phrase_texts():
    rng = random.Random(11)
    words = ["a", "b", "c", "d", "Ée", "of"]
    out = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    return [*out, ("en", None), ("en", ""), (None, "one. two"), ("", "a b c a b c a b c"), ("en", "of the same of the same " * 40), ("de", "x " * 400), ("de", "x " * 400)]


@pytest.mark.parametrize(("least", "places", "lot", "marks"), [(5, 1 << 21, 1 << 15, 1 << 24), (3, 50, 7, 64), (40, 300, 64, 128)])
def test_collocations(spark, monkeypatch, least, places, lot, marks):
    texts = phrase_texts()
    docs = spark.createDataFrame([(i, "x", *t) for i, t in enumerate(texts)], "doc_id long, word string, lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "LOT", lot)
    monkeypatch.setattr(collocations, "MARKS", marks)
    got = collocations.collocations(docs, least=least, shard_places=places, top=30)
    assert rows(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == brute_phrases(texts, least=least, top=30)


def test_shards_are_neither_shuffled_nor_joined_with_words(spark, monkeypatch):
    """Only packed counts move; words that share an id are hashed anew."""
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(phrase_texts())], "doc_id long, lang string, text string").repartition(3)
    plans, kept = [], collocations.cut
    monkeypatch.setattr(collocations, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    monkeypatch.setattr(collocations, "ID_BITS", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    words, phrases, _ = collocations.frequent_phrases(docs, least=5, shard_places=300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert words.select("id").distinct().count() == words.count() and phrases.where("size > 2").count()
    rounds = [p.split("Initial Plan")[0] for p in plans if "bucket#" in p]
    assert len(rounds) >= 2 and all(p.count("Exchange hashpartitioning(shard") <= 1 and "Join [lang" not in p for p in rounds)


def test_lots_of_a_shard_are_independent():
    shard = collocations.Shard()
    for lang, text in phrase_texts():
        shard.add(lang or "und", (text or "").encode())
    row = shard.row(0).to_pylist()[0]
    every = np.arange(len(shard.names))
    maps = collocations.Bitmaps(every, every[::-1].copy(), np.frombuffer(row["sizes"], "<u4").astype(np.int64), collocations.unpacked(row["gaps"], "<u4"), collocations.unpacked(row["bits"], "<u2"))
    want = None
    for lot in (3, 40, 1 << 20):
        collocations.LOT, before = lot, collocations.LOT
        got = Counter()
        for phrases, n in collocations.Search(maps, 2, np.zeros((0, 1), np.int64)).counts():
            got.update({tuple(p): c for p, c in zip(phrases.tolist(), n.tolist(), strict=True)})
        collocations.LOT = before
        assert want is None or got == want
        want = got


def test_collocations_of_odd_rows(spark, docs, no_docs, awkward):
    want = brute_phrases([("en", t) for _, t in awkward], least=12)
    assert rows(collocations.collocations(docs, least=12), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == want
    assert collocations.collocations(no_docs).count() == 0


def test_op11(spark, folder, awkward):
    got = run(spark, folder, "op11_collocations", lang="string", rank="bigint", phrase="string", a="bigint", l="bigint", r="bigint", n="bigint", score="bigint")
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_phrases([("en", t) for _, t in awkward])


def brute_runs(words):
    """(start, length, period) by trying every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_of_random_words():
    hashes = periodic.WordHashes()
    for seed in range(1500):
        rng = random.Random(seed)
        words = [rng.choice([b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            period, at = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 7))], rng.randint(0, len(words))
            words[at:at] = (period * 8)[: rng.randint(3, 40)]
        want = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        assert periodic.runs(words, hashes) == want
        assert periodic.stretch_runs(words) == sorted(want)


def test_long_runs():
    hashes = periodic.WordHashes()
    assert periodic.runs([b"x"] * 30_000, hashes) == [(0, 30_000, 1)]
    words = [b"%d" % i for i in range(3_000)] * 5
    assert periodic.runs([b"y", *words, b"y"], hashes) == [(1, 15_000, 3_000)]


def test_op12(spark, folder, no_docs, awkward):
    got = run(spark, folder, "op12_periodic_runs", doc_id="bigint", n_runs="bigint", start="bigint", length="bigint", period="bigint", exponent_milli="bigint", runs_sha256="string", collapsed_sha256="string")
    want = Counter()
    for i, t in awkward:
        words = re.findall("[^ \t-\r]+", t or "")
        n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, size, q in found for k in range(s + q, s + size)}
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[i, len(found), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()), sha(" ".join(w for k, w in enumerate(words) if k not in gone).encode())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got) == want
    assert periodic.digests(periodic.periodic_runs(no_docs)).count() == 0


def test_pairs_are_told_by_small_keys(spark, monkeypatch):
    """What is summed for all pairs is a few bytes each; rare pairs that pass don't count."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    texts = [("en", " ".join(rng.choices(words, k=400)) + " w1 w2") for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang").repartition(2)
    sizes, kept = [], collocations.by_bucket

    def by_bucket(counts, *rest):
        if "keys" in counts.columns:
            sizes.append(counts.selectExpr("sum(length(keys) + length(counts))").first()[0])
        return kept(counts, *rest)

    monkeypatch.setattr(collocations, "by_bucket", by_bucket)
    want = brute_phrases(texts)
    assert rows(collocations.collocations(docs), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == want
    pairs = len({p for _, t in texts for p in zip(t.split(), t.split()[1:], strict=False)})
    assert pairs > 100_000 and 0 < sizes[0] < 4 * pairs
    told = collocations.likely_keys
    monkeypatch.setattr(collocations, "likely_keys", lambda counts, least, buckets: told(counts, 1, buckets))  # as if all shared frequent keys
    assert rows(collocations.collocations(docs), "lang", "rank", "phrase", "a", "l", "r", "n", "score") == want


@pytest.mark.parametrize("words", [1, 3, 2_000])
def test_ids_through_a_coder(words):
    rng = np.random.default_rng(words)
    for n in (1, 511, 512, 131_072, 131_073, 300_001):
        ids = (rng.zipf(1.2, n) % words).astype(np.uint32)
        table = tokenfiles.frequencies(dict(Counter(ids.tolist())))
        assert sum(table.values()) == 1 << 20 and min(table.values()) > 0
        coder = tokenfiles.Coder(table)
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all()
        for a in rng.integers(0, n + 1, 4).tolist():
            b = int(rng.integers(a, n + 1))
            assert (coder.decode(data, a, b) == ids[a:b]).all()
        for at in (5, 20, len(data) - 1):
            with pytest.raises(tokenfiles.Damaged):
                coder.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(tokenfiles.Damaged):
            coder.decode(data[:-4])


def test_frequencies_of_many_rare_ids():
    table = tokenfiles.frequencies({i: 1 for i in range(1 << 10)} | {5000: 10**12}, bits=11)
    assert sum(table.values()) == 1 << 11 and min(table.values()) == 1
    with pytest.raises(ValueError, match="slots"):
        tokenfiles.frequencies({i: 1 for i in range(5)}, bits=2)


def test_joined_checksums():
    for a, b in ((b"", b"x"), (b"x", b""), (b"hello" * 99, b"world" * 1234)):
        assert tokenfiles.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def brute_files(awkward):
    """Rows of documents with an id, in the order of ids; ids that are repeated follow one another in any order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    out = []
    for i, t in awkward:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i is None, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0], r[1] or 0))


@pytest.mark.parametrize("block", [64, 5_000, 1 << 19])
def test_token_files(spark, docs, awkward, tmp_path, block):
    tokenfiles.write_files(docs, f"{tmp_path}/files", WORD_BPE, block=block)
    got = sorted(tokenfiles.read_documents(spark, f"{tmp_path}/files").collect(), key=lambda r: r["start"])
    want = brute_files(awkward)
    assert [r["doc_id"] for r in got] == [i for _, i, _, _ in want]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(r[1:] for r in want)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    pieces = tokenfiles.read_pieces(spark, f"{tmp_path}/files", keep_ids=True).orderBy("start", "at").collect()
    assert zlib.crc32(b"".join(r["ids"] for r in pieces if r["doc_id"] == 400)) == next(c for _, i, _, c in want if i == 400)


def test_missing_blocks_are_told(spark, docs, tmp_path):
    tokenfiles.write_files(docs, f"{tmp_path}/files", WORD_BPE, block=1_000)
    blocks = spark.read.parquet(f"{tmp_path}/files/blocks")
    inside = blocks.where("size(starts) = 1 and starts[0] < first and starts[0] + lengths[0] > first + n").first()["first"]
    blocks.where(f"first <> {inside}").write.parquet(f"{tmp_path}/some/blocks")
    for name in ("frequencies", "format"):
        spark.read.parquet(f"{tmp_path}/files/{name}").write.parquet(f"{tmp_path}/some/{name}")
    with pytest.raises(Exception, match="are missing"):
        tokenfiles.read_documents(spark, f"{tmp_path}/some").collect()


def test_no_rows_make_no_blocks(spark, no_docs, tmp_path):
    tokenfiles.write_files(no_docs, f"{tmp_path}/files", WORD_BPE)
    assert tokenfiles.read_documents(spark, f"{tmp_path}/files").count() == 0


def test_op13(spark, folder, awkward):
    got = run(spark, folder, "op13_token_files", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(r[1:] for r in brute_files(awkward))
