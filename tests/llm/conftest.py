import random

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, kind string, start long, score double, words long, deleted long, _row long, `a.b` string"

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, repeated rows and ids, odd characters."""
    rng = random.Random(4)
    passage = "\n".join(sentence(rng, 24) for _ in range(3))
    short = "same little line"
    out = []
    for i in range(40):
        lines = [sentence(rng, rng.randint(3, 70)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 3 == 0:
            lines.insert(0, short)
        if i % 5 == 0:
            lines.insert(1, "")
        out.append((i, "\n".join(lines)))
    whole = out[7][1]
    out += [(100 + i, whole) for i in range(12)]
    base = sentence(rng, 120).split()
    for i in range(14):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"changed{i}"
        out.append((200 + i, " ".join(copy)))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one two three"), (305, "One  two\tTHREE"), (303, "one"), (303, "one"), (None, "no id here at all"), (None, None), (306, "other text"), (306, "and another one")]
    out += [(400, "Ünïcödé 日本語 😀 ſſ   x\x1cy\x85z"), (401, "a" * 30_000), (402, "1" * 20_000), (403, "x " * 15_000), (404, "1.1." * 4_000), (405, "a@" * 4_000 + "b.c" + ".d" * 4_000), (406, "\n" * 3_000), (407, "password = " * 500)]
    return out


@pytest.fixture(scope="session")
def awkward():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    made = [(i, t, "en", "src", len(t or ""), "p", "k", 1, 0.5, 2, 3, 4, "c") for i, t in awkward]
    return spark.createDataFrame(made, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """documents (odd rows of all kinds), labels and embeddings as the driver lays them out."""
    where = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)] + [(150 + i, [0.5] * 8) for i in range(30)] + [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [None] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    return str(where)
