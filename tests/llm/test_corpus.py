"""Operators that compare documents with one another, held against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from support import rows
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import licenses, linededup, neardup, neighbours, packing, toxicity


def shingle_set(text):
    words = [w for w in re.split("[\x20\t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute_components(docs, percent):
    """(doc_id, n_shingles, component) of every row; rows that agree in id and text are one, and rows without an id come last."""
    nodes = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    sets = [shingle_set(t) for _, t in nodes]
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(sets):
        for y in range(x + 1, len(sets)):
            both = len(a & sets[y])
            if both and 100 * both >= percent * (len(a) + len(sets[y]) - both):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    of = {d: (len(sets[i]), nodes[find(i)][0]) for i, d in enumerate(nodes)}
    return sorted(((i, *of[i, t]) for i, t in docs), key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_near_duplicates_match_all_pairs(docs, awkward):
    out = neardup.near_duplicates(docs)
    assert rows(out, "doc_id", "n_shingles", "component_id") == brute_components(awkward, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_texts_of_a_repeated_id_keep_their_own_links(spark):
    """Two texts of id 5, two of id 9, and a near copy of one of each; rows without an id; a repeated row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    made = [(5, a), (5, b), (9, a), (9, c), (12, a + " more"), (12, c + " more"), (None, b), (None, "no id here at all"), (None, "no id here at all"), (9, c), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*d, "x", 1) for d in made], "doc_id long, text string, `a.b` string, text_hash int")
    assert rows(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_components(made, 85)
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns
    assert rows(left, "doc_id", "text") == sorted([(5, a), (5, b), (9, c), (None, "no id here at all"), (3, ""), (3, "")], key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


def test_crowded_hubs_and_buckets_are_split(spark, monkeypatch):
    """The same links where a hub's candidates and a bucket's members meet in many parts."""
    monkeypatch.setattr(neardup, "PER_HUB", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base, made = [f"w{i}" for i in range(300)], []
    for i in range(60):
        copy = list(base)
        for k in range(i % 8):
            copy[(37 * i + 41 * k) % 300] = f"changed{i}_{k}"
        made.append((i, " ".join(copy)))
    out = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 90)
    assert rows(out, "doc_id", "n_shingles", "component_id") == brute_components(made, 90)


def test_links_across_chains_and_borders(spark):
    """Chains of texts that are each just similar enough to the next, and pairs just on either side of the limit."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(12):
        base = base[:-1] if k % 2 else ["v%d" % k, *base]
        texts.append(" ".join(base))
    for n in (6, 7, 8, 20, 33):
        texts += [" ".join(f"n{n}_{i}" for i in range(n + 4)), " ".join(f"n{n}_{i}" for i in range(n + 5))]
    made = [(i, t) for i, t in enumerate(texts)]
    out = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))
    assert rows(out, "doc_id", "n_shingles", "component_id") == brute_components(made, 85)


def test_near_duplicates_of_odd_rows(docs, no_docs, awkward):
    out = neardup.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in awkward)
    repeated = {(r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] == 303}
    assert repeated == {(1, 303, True)}
    assert {(r["n_shingles"], r["kept"]) for r in out if r["doc_id"] in (300, 301, 302)} == {(0, True)}
    assert neardup.near_duplicates(no_docs).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = a.copy()
        fresh = int(len(a) * (1 - share) / (1 + share))
        b[:fresh] = rng.integers(0, 1 << 63, fresh, dtype=np.uint64)
        n = np.array([4000.0])
        got = neardup.estimate(neardup.sketch(np.unique(a))[None], neardup.sketch(np.unique(b))[None], n, n)[0]
        assert abs(got - share * 2 / (1 + share) / (2 - share * 2 / (1 + share))) < 0.15


def brute_lines(docs, least):
    """Deleted lines: those in later copies, not overlapping the first, of runs of at least `least` words."""
    solid = {}
    for i, t in sorted(docs):
        solid[i] = [(n, x, len(x.split())) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    seen, runs = {}, []
    for i in sorted(solid):
        lines = solid[i]
        for a in range(len(lines)):
            for b in range(a, min(len(lines), a + 60)):
                if sum(x[2] for x in lines[a : b + 1]) >= least:
                    key = tuple(x[1] for x in lines[a : b + 1])
                    runs.append((i, a, b, key))
                    seen.setdefault(key, (i, a, b))
    gone = defaultdict(set)
    for i, a, b, key in runs:
        j, c, e = seen[key]
        if i != j or a > e:
            gone[i] |= {solid[i][k][0] for k in range(a, b + 1)}
    return {i: sorted(g) for i, g in gone.items() if g}


@pytest.mark.parametrize("least", [1, 4, 50])
def test_line_dedup_matches_all_runs(docs, awkward, least):
    """Ids are numbered by their order here, for they repeat: rows that agree in id and text are one, and null ids come last."""
    distinct = sorted({(i, t) for i, t in awkward if t}, key=lambda d: (d[0] is None, d[0] or 0))
    unique = [d for d in distinct if sum(e[0] == d[0] for e in distinct) == 1]
    out = linededup.deletions(docs.where("doc_id is null or doc_id <> 306"), least)
    want = {unique[n][0]: lines for n, lines in brute_lines([(n, t) for n, (_, t) in enumerate(unique)], least).items()}
    assert {None if r["doc_id"] == linededup.LAST else r["doc_id"]: r["deleted"] for r in out.collect()} == want


def test_rows_without_an_id_lose_later_copies(spark):
    body = "\n".join(f"line {k} of the text that is here" for k in range(10))
    made = spark.createDataFrame([(None, body, 1, "x"), (7, body, 2, "y"), (None, "other\n" + body, 3, "z"), (7, body, 2, "y"), (8, None, 4, None), (7, "another text", 5, "q")], "doc_id long, text string, _text int, deleted string")
    out = linededup.deduplicated(made)
    assert out.columns == ["doc_id", "text", "_text", "deleted"]
    assert rows(out, "_text", "text") == [(1, ""), (2, body), (2, body), (3, "other"), (4, None), (5, "another text")]
    kept = linededup.deduplicated(made, mark="gone")
    assert kept.columns == [*made.columns, "gone"] and rows(kept, "_text", "deleted") == [(1, "x"), (2, "y"), (2, "y"), (3, "z"), (4, None), (5, "q")]
    staged = corpus_pipeline.dedup_lines(spark, made, "")
    assert staged.columns == made.columns and rows(staged, "_text", "text") == [(2, body), (2, body), (3, "other"), (4, None), (5, "another text")]


def suffix_intervals(docs, least):
    """From a sorted list of all suffixes and their common prefixes: the intervals of the depth that has `least` words, of two copies or more."""
    suffixes = []
    for i, t in docs:
        solid = [x for x in t.split("\n") if x.strip()]
        suffixes += [(tuple(solid[a:]), i, a) for a in range(len(solid))]
    suffixes.sort()
    common = lambda p, q: next((n for n, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))  # noqa: E731, B905
    depth = lambda s: next((n + 1 for n in range(len(s)) if sum(len(x.split()) for x in s[: n + 1]) >= least), None)
    out, group = set(), []
    for n, (s, i, a) in enumerate(suffixes):
        m = depth(s)
        joined = group and m is not None and common(suffixes[n - 1][0], s) >= m
        if not joined:
            out |= {frozenset(group)} if len(group) > 1 else set()
            group = []
        if m is not None:
            group.append((i, a, m))
    return out | ({frozenset(group)} if len(group) > 1 else set())


def test_names_are_the_intervals_of_the_suffix_array(spark):
    rng = np.random.default_rng(12)
    made = [(i, "\n".join(f"l{rng.integers(0, 4)} word" if rng.random() < 0.9 else f"only{i}_{k}" for k in range(rng.integers(5, 40)))) for i in range(30)]
    found = defaultdict(set)
    for r in linededup.run_copies(spark.createDataFrame(made, "doc_id long, text string"), 12).collect():
        found[tuple(r[c] for c in linededup.INTERVAL)].add((r["doc_id"], r["start"], r["m"]))
    got, want = {frozenset(g) for g in found.values() if len(g) > 1}, suffix_intervals(made, 12)
    # Runs that end at a line and are not the shortest from their start on have intervals of their own.
    assert want and {g for g in got if next(iter(g)) in {x for w in want for x in w}} == want
    assert all(any({(i, a) for i, a, _ in g} <= {(i, a) for i, a, _ in w} for w in want) for g in got)


def test_repeated_runs_are_maximal(spark):
    line = lambda k: f"line {k} has five words"
    passage = [line(k) for k in range(20)]
    made = [(1, "\n".join(["head a", *passage, "tail a"])), (2, "\n".join([*passage[:7], "", *passage[7:], "tail b"])), (3, "\n".join(["other", *passage[4:16]])), (4, "\n".join(passage[:3]))]
    got = linededup.repeated_runs(spark.createDataFrame(made, "doc_id long, text string"), 50)
    assert rows(got, "doc_id", "first_line", "last_line", "from_doc", "n_lines") == [(2, 0, 20, 1, 20), (3, 1, 12, 1, 12)]


def test_line_dedup_of_odd_rows(docs, no_docs, awkward):
    out = linededup.deduplicated(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter(i for i, _ in awkward)
    same = {r["doc_id"]: r["text"] for r in out.where("doc_id in (300, 301, 406, 400)").collect()}
    assert same == {i: t for i, t in awkward if i in (300, 301, 406, 400)}
    assert linededup.deduplicated(no_docs).count() == 0


def test_runs_that_repeat_themselves_keep_one(spark):
    made = spark.createDataFrame([(1, "\n".join(["a b c"] * 6)), (2, "\n".join(["x y", "z w", "x y", "z w", "q"])), (3, "z w\nx y\nz w")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(made, 4).collect()}
    want = brute_lines([(1, "\n".join(["a b c"] * 6)), (2, "x y\nz w\nx y\nz w\nq"), (3, "z w\nx y\nz w")], 4)
    assert {i: sorted(set(range(n)) - set(want.get(i, []))) for i, n in ((1, 6), (2, 5), (3, 3))} == {1: [0, 1], 2: [0, 1, 4], 3: []}
    assert got == {1: "a b c\na b c", 2: "x y\nz w\nq", 3: ""}


def brute_nearest(vectors, every, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in vectors if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-float(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j) for n, (_, j) in enumerate(scored)]
    return sorted(out)


def test_exact_factor_is_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-4, 5, 8).astype(float).tolist()) for i in range(300)]
    vectors += [(300 + i, [1.0] * 8) for i in range(60)]  # one very common vector
    vectors += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [float("inf")] + [0.0] * 7), (405, []), (None, [1.0] * 8), (420, [1.0, 2.0]), (440, [2.0, 1.0])]
    made = spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in vectors], "vec_id long, embedding array<double>, rank int, score double, dim int")
    out = neighbours.nearest(made, 20, 20, factor=1.0, shard_rows=100, block_rows=5)
    assert rows(out, "query_id", "rank", "vec_id") == brute_nearest(vectors, 20, 20)
    assert neighbours.nearest(made.limit(0)).count() == 0
    assert all(abs(r["score"] - np.dot(dict(vectors)[r["query_id"]], dict(vectors)[r["vec_id"]])) < 1e-12 for r in out.collect())


def test_relaxed_search_recalls_nine_tenths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(made).collect()}
    want = {(i, j) for i, _, j in brute_nearest([(i, v.astype(np.float32)) for i, v in enumerate(x)], 20, 20)}
    assert len(got & want) >= 0.95 * len(want)


INSULTS = "dolt fool knave wretch".split()


@pytest.fixture(scope="session")
def judged(spark):
    rng = np.random.default_rng(6)
    made, labels = [], []
    for i in range(600):
        words = [f"word{rng.integers(0, 400)}" for _ in range(rng.integers(5, 80))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.integers(0, len(words)), INSULTS[rng.integers(0, 4)])
        made.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(judged):
    docs, labels = judged
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    out = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    assert toxicity.clean(docs, model).count() == sum(not r["predicted"] for r in out)


def test_toxicity_training_is_bounded_and_blind(judged):
    docs, labels = judged
    texts, y = toxicity.training_sample(docs, labels, sample_rows=40)
    assert len(texts) <= 40 and sum(y) == 20
    few, _ = toxicity.training_sample(docs, labels, sample_bytes=20_000)
    assert 0 < sum(len(t) for t in few) <= 20_000 and max(map(len, few)) <= 20_000 // 64
    held = {r["text"] for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    assert not held & set(texts)


def test_toxicity_learns_from_all_labelled_rows(judged):
    """The sample is but the start: words that it lacks are trained too, and all rows held back set the thresholds."""
    docs, labels = judged
    texts, y = toxicity.training_sample(docs, labels, sample_rows=40)
    start, model = toxicity.fit(texts, y), toxicity.learn(docs, labels, shard_rows=100, sample_rows=40)
    seen = np.zeros(len(model.table), bool)
    seen[toxicity.Words([t.encode() for t in texts]).features] = True
    assert ((start.table != model.table).any(axis=1) & ~seen).any() and model.thresholds != start.thresholds
    held = toxicity.score(docs, toxicity.learn(docs, labels, shard_rows=100, sample_rows=300)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    assert toxicity.learn(docs, labels.limit(0)) is None


def test_toxicity_shuffles_only_labelled_texts_and_once(spark, monkeypatch):
    """Texts without a label stay where they are, and the join needs no second shuffle; without any bits' help the rows are the same."""
    texts = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(3).union(spark.sql("SELECT 7L, 'again'"))
    usable = spark.range(0, 400, 10).selectExpr("id + 7 AS doc_id", "int(id % 20 = 0) AS toxic")
    want = sorted((i, t, int((i - 7) % 20 == 0)) for i, t in [(7, "again"), *((i, f"text {i}") for i in range(7, 400, 10))])
    plans = []
    monkeypatch.setattr(toxicity, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    for bits in (1 << 24, 64):
        monkeypatch.setattr(toxicity, "LABEL_BITS", bits)
        told = toxicity.label_bits(usable)
        found = toxicity.labelled_shards(texts, usable, 4).collect()
        assert sorted((r["doc_id"], r["text"], r["toxic"]) for r in found) == want and len({r["shard"] for r in found}) == 4
        assert sum(int(x).bit_count() for x in told) <= 40
        plan = plans[-1].split("Initial Plan")[0]
        assert plan.count("hashpartitioning(doc_id") == 2 and plan.index("hashpartitioning(doc_id") < plan.index("may_have(")


def test_all_of_a_run_without_spaces_is_seen():
    """Toxic words far into runs of letters and of Chinese characters; texts of either class begin alike."""
    rng = np.random.default_rng(8)
    for signs, bad in (("abcdefghijklmnop", "scoundrel"), ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "混蛋坏人")):
        made = []
        for i in range(400):
            run = "".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(40, 90)))
            at = int(rng.integers(30, len(run)))
            made.append(run[:at] + bad + run[at:] if i % 4 == 0 else run)
        labels = [int(i % 4 == 0) for i in range(400)]
        model = toxicity.fit(made[:300], labels[:300])
        got = toxicity.scores(model, [t.encode() for t in made[300:]]) >= toxicity.CUT
        assert (got == np.array(labels[300:])).mean() >= 0.9
    words = toxicity.Words([b"x" * n for n in (24, 25, 36, 37, 1000)])
    assert words.counts.tolist() == [1, 2, 2, 3, 83]


def test_toxicity_of_odd_rows(judged, docs, no_docs, awkward):
    labelled, labels = judged
    model = toxicity.fit(*toxicity.training_sample(labelled, labels))
    out = toxicity.score(docs, model)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in awkward)
    by_text = defaultdict(set)
    texts = dict((i, t or "") for i, t in awkward if i not in (None, 306))
    for r in out.where("doc_id is not null and doc_id <> 306").collect():
        by_text[texts[r["doc_id"]]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.score(no_docs, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit([], [])).collect()} == {0.0}
    assert toxicity.training_sample(labelled, labels.limit(0)) == ([], [])


def test_scores_match_plain_loops():
    """Words, n-grams, filters, maxima and the logistic layer, one number after the other."""
    made = ["Bad words here, BAD words", "one", "", "  ", "ein Wort und noch ein Wort der die das", "x" * 60 + " end", "日本語のテキスト is long enough to be parted", "a b c d e f g h i"]
    labels = [1, 0, 0, 1, 0, 1, 0, 1]
    model = toxicity.train(made, np.array(labels, dtype=np.float64), epochs=2, least_steps=8, batch=4)
    model.bias[:] = np.linspace(-0.2, 0.3, len(model.bias))
    fold = lambda b: bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in b)
    mask = (1 << 64) - 1

    def mix(h):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & mask
        return h ^ h >> 32

    poly = lambda b: mix(sum((c + 1) * pow(int(toxicity._BASE), k, 1 << 64) for k, c in enumerate(b)) & mask)

    def embedded(piece, first, last):
        """The mean of the vectors of a piece and of its n-grams."""
        whole = poly(piece)
        if not (first and last):
            whole = mix((whole + (1 + first + 2 * last) * int(toxicity._BASE)) & mask)
        buckets = [mix((whole + 1) & mask)]
        for n in toxicity.GRAMS:
            for i in range(len(piece) - n + 1):
                kind = 4 * n + 2 * (first and i == 0) + (last and i + n == len(piece))
                buckets.append(mix((poly(piece[i : i + n]) + kind) & mask))
        return sum(model.table[b % toxicity.BUCKETS] for b in buckets) / len(buckets)

    def logit(text):
        words = []
        for run in fold(text.encode()).split():
            many = 1 + max(0, -(-(len(run) - toxicity.LONGEST) // toxicity.STEP))
            words += [embedded(run[k * toxicity.STEP : k * toxicity.STEP + toxicity.LONGEST], k == 0, k == many - 1) for k in range(many)]
        blank = model.table[0]
        words = words or [blank]
        padded, tops = words + [blank] * toxicity.PAD, []
        for width, filters in zip(toxicity.WIDTHS, model.filters, strict=True):
            for f in range(toxicity.FILTERS):
                tops.append(max(sum(float(padded[i + k] @ filters[k][:, f]) for k in range(width)) for i in range(len(words))))
        return sum(np.tanh(t + b) * o for t, b, o in zip(tops, model.bias, model.out, strict=True)) + model.shift

    raw, languages = toxicity.logits(model, [t.encode() for t in made])
    assert np.abs(raw - [logit(t) for t in made]).max() < 1e-4 and languages[4] == "de"
    model.thresholds = {"": 0.25, "de": -0.5}
    want = [1 / (1 + np.exp(-(x - model.thresholds.get(lang, 0.25) + np.log(7 / 3)))) for x, lang in zip(raw, languages, strict=True)]
    assert np.abs(toxicity.scores(model, [t.encode() for t in made]) - want).max() < 1e-9


def test_thresholds_are_the_best_of_all_cuts():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = rng.permutation(40).astype(float), (rng.random(40) < 0.4).astype(float)
        f1 = lambda cut: 2 * y[x >= cut].sum() / ((x >= cut).sum() + max(y.sum(), 1))  # noqa: B023, E731
        assert abs(f1(toxicity.threshold(x, y)) - max(f1(c) for c in x)) < 1e-12


FILES = [
    (1, "src/a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (2, "src/a/main.c", "int main() {}"),
    (3, "src/a/deep/er/x.c", "// nothing here"),
    (4, "src/a/deep/COPYING", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (5, "src/b/y.c", "/* Licensed under the Apache License, Version 2.0. */\nint y;"),
    (6, "lib/z.c", "int z;"),
    (7, None, None),
    (8, "src/a/deep/w.c", "a license to print money, said the free man"),
]


def test_licences_and_their_inheritance(spark, no_docs):
    made = spark.createDataFrame([(i, p, t, "x", 1.0, "y") for i, p, t in FILES], "doc_id long, path string, text string, licence string, similarity double, dir string")
    out = licenses.scan(made, F.col("path"))
    assert rows(out, "doc_id", "licence", "origin", "from_dir") == [
        (1, "MIT", "own", None), (2, "MIT", "inherited", "src/a"), (3, "GPL-3.0", "inherited", "src/a/deep"), (4, "GPL-3.0", "own", None),
        (5, "Apache-2.0", "own", None), (6, None, "none", None), (7, None, "none", None), (8, "GPL-3.0", "inherited", "src/a/deep"),
    ]
    assert licenses.scan(no_docs, F.col("path")).count() == 0


def test_every_template_is_its_own_best_match():
    matcher = licenses.Matcher(licenses.TEMPLATES, 1000, {"the": 900, "of": 900, "to": 900, "in": 900, "and": 900})
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert matcher.scan(("// " + text).encode())[0] == name
    assert matcher.scan(b"")[0] is None and matcher.scan("für die the of 日本".encode())[0] is None


def test_scans_match_plain_cosines():
    """Similarities against vectors written out: every line, every window of lines and the whole text."""
    rng, common = np.random.default_rng(4), "the of to in and a is".split()
    counts = {w: 700 for w in common} | {"software": 30, "license": 40}
    matcher = licenses.Matcher(licenses.TEMPLATES, 1000, counts)
    weight = lambda w: float(matcher.idf[matcher.vocabulary[w]]) if w in matcher.vocabulary else matcher.unknown
    vector = lambda text: {w: n * weight(w) for w, n in Counter(licenses.terms(text)).items()}
    length = lambda v: sum(x * x for x in v.values()) ** 0.5
    cosine = lambda u, v: sum(x * v.get(w, 0) for w, x in u.items()) / (length(u) * length(v)) if u and v else 0.0
    templates = [(name, vector(t)) for name, texts in licenses.TEMPLATES.items() for t in texts]
    sources = [t for texts in licenses.TEMPLATES.values() for t in texts]
    for _ in range(150):
        lines = []
        for _ in range(rng.integers(1, 4)):
            words = sources[rng.integers(0, len(sources))].split()
            words = [w for w in words if rng.random() < 0.9] + [f"word{rng.integers(0, 99)}" for _ in range(rng.integers(0, 6))]
            lines += [" ".join(words), "plain words between them"]
        text = "\n".join(lines)
        best = lambda t: max(((round(cosine(vector(t), v), 9), name) for name, v in templates), key=lambda x: x[0])
        whole = best(text)
        spans = ["\n".join(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
        each = [best(t) for i, t in enumerate(spans) if "\n" not in t or len(licenses.terms(t)) <= matcher.most_words]
        top = max([whole, *each], key=lambda x: x[0])
        licence, similarity, _, of_whole, words = matcher.scan(text.encode())
        assert abs(of_whole - whole[0]) < 1e-8 and words == len(licenses.terms(text))
        if top[0] >= licenses.NOTICE:
            assert abs(similarity - top[0]) < 1e-8 and licence in {n for s, n in [whole, *each] if abs(s - top[0]) < 1e-8}
        elif whole[0] < licenses.FILE:
            assert licence is None


WRAPPED = {
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0\nInternational License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\n\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\nany later version.",
    "MIT": "# Released\n#\n# under the\n# MIT\n# License.",
}


@pytest.mark.parametrize("share", [0.0005, 0.02, 0.2, 0.6])
@pytest.mark.parametrize("name", sorted(WRAPPED))
def test_wrapped_notices_between_prose_with_their_words(share, name):
    held = int(100_000 * share)
    matcher = licenses.Matcher(licenses.TEMPLATES, 100_000, {w: held for texts in licenses.TEMPLATES.values() for t in texts for w in licenses.terms(t)})
    for before, after in (("some prose of ours", "and more"), ("a work of public software as its source", "the software and the work are public"), ("their license", "version 4.0")):
        licence, similarity, line, _, _ = matcher.scan(f"{before}\n{WRAPPED[name]}\n{after}".encode())
        assert (licence, line) == (name, 1) and similarity > 0.97


def test_op9(spark, tmp_path):
    prose = lambda i: " ".join(f"word{(37 * i + 7 * k * k) % 400}" for k in range(80))
    texts = {i: prose(i) for i in range(60)} | {60: None, 61: ""}
    wanted = {}
    for k, (name, notice) in enumerate(WRAPPED.items()):
        for i in (3 * k, 20 + k):
            texts[i] = f"{prose(i)}\nthe public work\n{notice}\na source of software\n{prose(i + 90)}"
            wanted[i] = name, "own"
    made = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.op9_licence_scan(spark, str(tmp_path)).collect()}
    assert got == {i: wanted.get(i, (None, "none")) for i in texts}


@pytest.mark.parametrize("every", [1, 3])
def test_common_notices_are_found(spark, every):
    """A notice in all or a third of the rows, on a line of its own, behind other words, or over two lines between prose."""
    notices = ["Released under the MIT License.", "prose here\n# demo: Released under the MIT License.", "the public work of words\nReleased under the\nMIT License.\na file of other words"]
    made = [(i, f"d{i}/x.txt", f"some words w{i} of the text\n" + (notices[i // every % 3] if i % every == 0 else "and nothing else")) for i in range(90)]
    made += [(1000, "g/y.txt", "int y;"), (1001, "e/LICENSE", "Released under the MIT License."), (1002, "e/f/y.txt", "int y;")]
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.scan(spark.createDataFrame(made, "doc_id long, path string, text string"), F.col("path")).collect()}
    want = {i: ("MIT", "own") if i % every == 0 else (None, "none") for i in range(90)}
    assert got == want | {1000: (None, "none"), 1001: ("MIT", "own"), 1002: ("MIT", "inherited")}


def test_licences_of_odd_rows(docs, awkward):
    out = licenses.scan(docs, F.col("path"))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in awkward)


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory, judged):
    """A folder with documents and labels as the pipeline reads them."""
    folder = tmp_path_factory.mktemp("corpus")
    docs, labels = judged
    passage = "\n".join(" ".join(f"word{(91 * k + 13 * i * i) % 400}" for i in range(20)) for k in range(3))
    line = lambda n: " ".join(f"word{(37 * n + 7 * i * i) % 400}" for i in range(30))
    more = [(1000, line(1) + "\n" + passage), (1001, line(2) + "\n" + passage), (1002, line(3)), (1003, line(3) + " more"), (1004, line(9) + " word1@word2.word3 " + line(10)), (1005, ""), (1006, None), (1007, passage)]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    both.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    labels.select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stage_by_stage(spark, corpus, judged, tmp_path):
    labels = {r["doc_id"]: r["toxic"] for r in judged[1].collect()}
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "personal_data", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in before if not labels.get(i)}
    assert len(clean - set(seen["toxicity"])) <= 0.02 * len(clean) and len(set(seen["toxicity"]) - clean) <= 0.1 * sum(labels.values())
    lines = seen["line_dedup"]
    assert lines[1000] == before[1000] and before[1001] == lines[1001] + "\n" + before[1007] and lines[1001] and 1007 not in lines and lines[1005] == "" and lines[1006] is None
    near = seen["near_dedup"]
    assert 1002 in near and 1003 not in near
    assert {i for i, _, c in brute_components(list(lines.items()), 80) if i == c} == set(near)
    personal = seen["personal_data"]
    assert personal[1004] == before[1004].replace("word1@word2.word3", "[EMAIL]") and {i: t for i, t in personal.items() if i != 1004} == {i: t for i, t in near.items() if i != 1004}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert {r["doc_id"] for r in packed.collect()} == set(personal) and packed.columns == packing.COLUMNS


def test_pipeline_drops_near_copies_from_four_fifths_on(spark, tmp_path):
    """Copies with three to seven scattered words changed: similarities on either side of 0.80, some between it and 0.85."""
    made = []
    for i in range(25):
        base = [f"w{i}_{k}" for k in range(250)]
        copy = list(base)
        for k in range(3 + i % 5):
            copy[20 + 30 * k] = f"changed{i}_{k}"
        made += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    sets = {i: shingle_set(t) for i, t in made}
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 50, 2)]
    assert sum(0.8 <= x < 0.85 for x in alike) >= 5 and min(alike) < 0.8
    docs = spark.createDataFrame(made, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i, _, c in brute_components(made, 80) if i == c}


def test_pipeline_run_is_its_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    pieces = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, corpus).collect()
    assert Counter(tuple(r[c] for c in pieces) for r in got) == Counter(tuple(r[c] for c in pieces) for r in docs.collect())
    ends = Counter()
    for r in got:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.CAPACITY and len(ends) == len({r["sequence_id"] for r in docs.collect()})


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_take_odd_rows(spark, docs, no_docs, corpus, awkward, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, corpus)
    assert out.columns == docs.columns
    left = out.select("doc_id", "text", "n_chars").collect()
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"] or "") for r in left) or name in ("toxicity", "near_dedup")
    if name == "near_dedup":
        heads = {(i, c) for (i, _, c), (_, t) in zip(brute_components(awkward, 80), awkward, strict=True)}
        assert {r["doc_id"] for r in left} == {c for _, c in heads}
        assert Counter(r["doc_id"] for r in left if not shingle_set(r["text"])) == Counter(i for i, t in awkward if not shingle_set(t))
        assert max(Counter((r["doc_id"], r["text"]) for r in left if shingle_set(r["text"])).values()) == 1
    elif name == "personal_data":
        assert Counter(r["doc_id"] for r in left) == Counter(i for i, _ in awkward)
    assert function(spark, no_docs, corpus).count() == 0


def test_queries_are_registered():
    from tessera.llm.queries import QUERIES

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
