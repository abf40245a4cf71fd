"""The registered queries themselves: columns, types and digests against plain Python, and the SQL against the queries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from support import rows
from test_corpus import brute_components, brute_nearest
from test_texts import WORD_BPE, base_personal, base_secrets

from tessera.llm import queries

sha = lambda b: hashlib.sha256(b).hexdigest()
utf8 = lambda t: (t or "").encode()


def run(spark, folder, name, **types):
    out = queries.QUERIES[name](spark, folder)
    had = dict(out.dtypes)
    assert {c: had[c] for c in types} == types
    return [r.asDict() for r in out.collect()]


def test_op1(spark, folder, awkward):
    got = run(spark, folder, "op1_secret_scan", doc_id="bigint", n_assign="bigint", n_access="bigint", n_hex="bigint", base_sha256="string", spans="string")
    want = Counter()
    for i, t in awkward:
        found = base_secrets(t or "")
        count = Counter(k for k, _, _ in found)
        want[i, count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    kept = lambda r: [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
    assert all(sha(",".join(kept(r)).encode()) == r["base_sha256"] for r in got)


def test_op2(spark, folder, awkward):
    got = run(spark, folder, "op2_transport_stream", doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    pad = lambda b: b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
    want = Counter((i, len(utf8(t)), len(pad(utf8(t))), sha(pad(utf8(t))), zlib.crc32(pad(utf8(t))[-64:])) for i, t in awkward)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by_text = {r["payload_sha256"]: (r["media_bytes"], r["media_sha256"], r["feature"]) for r in got}
    assert all(by_text[r["payload_sha256"]] == (r["media_bytes"], r["media_sha256"], r["feature"]) and r["media_bytes"] % 188 == 0 and r["continuity_errors"] == 0 for r in got)


def test_op3(spark, folder, awkward):
    got = run(spark, folder, "op3_personal_data", doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string")
    want = Counter()
    for i, t in awkward:
        if i != 404:  # Python's own regular expressions are quadratic on it
            found = base_personal(t or "")
            count = Counter(kind for _, kind, _, _ in found)
            want[i, *(count[k] for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{a}:{b}" for _, k, a, b in found).encode())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got if r["doc_id"] != 404) == want


def test_op4(spark, folder, awkward):
    from tokenizers import Tokenizer

    got = run(spark, folder, "op4_best_fit_packing", doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    tokenizer, want = Tokenizer.from_file(WORD_BPE), Counter()
    for i, t in awkward:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 4096 and len(at) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_op5(spark, folder, awkward):
    import tiktoken

    from tessera.llm import bpe

    got = run(spark, folder, "op5_byte_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t in awkward:
        ids = theirs.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(utf8(t))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_op6(spark, folder):
    got = run(spark, folder, "op6_nearest", query_id="bigint", rank="int", vec_id="bigint", score="double")
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == brute_nearest(vectors, 20, 20)


def test_op7(spark, folder, awkward):
    got = run(spark, folder, "op7_toxicity", doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in awkward)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_op10(spark, folder, awkward):
    got = run(spark, folder, "op10_near_duplicates", doc_id="bigint", n_shingles="bigint", component_id="bigint", kept="boolean")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == brute_components(awkward, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.fixture(scope="session")
def plain_folder(spark, docs, folder, tmp_path_factory):
    """The same with ids that are there and occur once, as the SQL takes them to."""
    where = tmp_path_factory.mktemp("plain")
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    once.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{folder}/embeddings.parquet").write.parquet(f"{where}/embeddings.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, plain_folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{plain_folder}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, plain_folder)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    key = lambda t: tuple((v is not None, str(type(v)), v) for v in t)
    assert rows(got) == sorted((tuple(x[i] for i in at) for x in want.fetchall()), key=key)
