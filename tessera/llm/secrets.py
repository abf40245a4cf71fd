"""Secret scanning with a trigram inverted index.

Each rule's regular expression is read into a Boolean query over the trigrams that any match must
hold.  Documents are indexed in blocks: a block's posting lists say which of its documents hold
which of the trigrams that the rules' queries mention (no other list is ever read).  A query is
answered by intersecting and uniting posting lists, and only its candidates are verified with the
expression itself.  A rule without mandatory trigrams, such as a run of hexadecimal digits, verifies
every document.  Blocks are cut within partitions, so nothing is shuffled and a lost executor costs
its own blocks only.

Defined results: a null or empty text has no secrets; repeated rows each get their own result;
other columns are ignored; an empty table gives no rows.  Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as reader

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, text_frame


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  #: characters that `group` must have; shorter matches are dropped


BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)

#: A query is True (every document), a trigram, or ("and" | "or", queries).
Query = object
MOST_STRINGS, MOST_CHARS = 64, 8


def both(a: Query, b: Query) -> Query:
    parts = [q for q in (a, b) if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 or a == b else ("and", tuple(parts))


def any_of(queries: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def needs(strings: set[bytes]) -> Query:
    """What a text needs to hold one of these strings, in lower case."""

    def one(s: bytes) -> Query:
        grams = tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
        return True if not grams else grams[0] if len(grams) == 1 else ("and", grams)

    return any_of(one(s) for s in sorted(strings))


def strings_of(kind: object, value: object, folded: bool) -> set[bytes] | None:
    """The lower-case strings that a single-character item matches, if they are few."""

    def char(c: int) -> bytes | None:
        return chr(c).encode().lower() if c < 128 or not folded else None

    if kind is op.LITERAL:
        return None if char(value) is None else {char(value)}
    if kind is op.IN:
        found: set[bytes] = set()
        for k, v in value:
            if k is op.LITERAL and char(v) is not None:
                found.add(char(v))
            elif k is op.RANGE and v[1] - v[0] < 2 * MOST_CHARS and v[1] < 128:
                found |= {char(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_CHARS else None
    return None


def trigrams_of(items: Iterable, folded: bool = False) -> tuple[set[bytes] | None, Query]:
    """(all strings that the items match, or None if they are many or endless; query for the rest)."""
    query: Query = True
    run, closed = {b""}, True  # the strings of the items since the last endless one; whether there was none

    def add(strings: set[bytes]) -> None:
        nonlocal run, query, closed
        if len(run) * len(strings) > MOST_STRINGS:
            flush()
        run = {a + b for a in run for b in strings} if len(strings) <= MOST_STRINGS else {b""}

    def flush() -> None:
        nonlocal run, query, closed
        query, run, closed = both(query, needs(run)), {b""}, False

    for kind, value in items:
        if (strings := strings_of(kind, value, folded)) is not None:
            add(strings)
        elif kind is op.SUBPATTERN or kind is op.ATOMIC_GROUP:
            on = value[1] if kind is op.SUBPATTERN else 0
            inner, more = trigrams_of(value[-1] if kind is op.SUBPATTERN else value, folded or bool(on & re.IGNORECASE))
            if inner is not None:
                add(inner)
            else:
                flush()
                query = both(query, more)
        elif kind is op.BRANCH:
            found = [trigrams_of(b, folded) for b in value[1]]
            if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
                add(set().union(*(s for s, _ in found)))
            else:
                flush()
                query = both(query, any_of(q if s is None else needs(s) for s, q in found))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            inner, more = trigrams_of(body, folded)
            if inner is not None and (least, most) == (0, 1):
                add(inner | {b""})
            else:
                for _ in range(min(least, 3) if inner is not None else 0):
                    add(inner)
                if inner is None or least != most or least > 3:
                    flush()
                    query = both(query, more if least and inner is None else True)
        elif kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
            continue
        else:
            flush()
    return (run, True) if closed else (None, both(query, needs(run)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies; True if there is none."""
    strings, query = trigrams_of(reader.parse(pattern), bool(reader.parse(pattern).state.flags & re.IGNORECASE))
    return query if strings is None else needs(strings)


def mentioned(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(mentioned, query[1]))


class Index:
    """Posting lists of a block of texts for given trigrams, as sets of rows in bits."""

    def __init__(self, texts: list[bytes], slots: np.ndarray, grams: list[bytes]) -> None:
        self.rows = len(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        block = np.frombuffer(b"".join(texts).lower(), dtype=np.uint8).astype(np.uint32)
        self.lists = {g: np.zeros(self.rows, dtype=bool) for g in grams}
        if len(block) >= 3:
            slot = slots[block[:-2] << 16 | block[1:-1] << 8 | block[2:]]
            at = np.flatnonzero(slot)
            row = np.searchsorted(ends, at, side="right")
            inside = at + 2 < ends[row]
            pairs = np.unique(slot[at[inside]].astype(np.int64) * self.rows + row[inside])
            for g, r in zip(pairs // self.rows - 1, pairs % self.rows, strict=True):
                self.lists[grams[g]][r] = True

    def search(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.rows, dtype=bool)
        if isinstance(query, bytes):
            return self.lists[query]
        found = [self.search(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(found)


def slots_for(grams: list[bytes]) -> np.ndarray:
    slots = np.zeros(1 << 24, dtype=np.uint16)
    for k, g in enumerate(grams):
        slots[g[0] << 16 | g[1] << 8 | g[2]] = k + 1
    return slots


def blocks(texts: list[bytes], at_once: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > at_once:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index itself, a row per block and trigram, to store and to search for other purposes."""
    grams = sorted(set().union(*(mentioned(trigram_query(r.pattern)) for r in rules)))

    def each(ids: list, texts: list[bytes], slots: np.ndarray) -> dict:
        out: dict = {"trigram": [], "doc_ids": []}
        for start, part in blocks(texts):
            for gram, rows in Index(part, slots, grams).lists.items():
                if rows.any():
                    out["trigram"].append(gram)
                    out["doc_ids"].append([ids[start + r] for r in np.flatnonzero(rows)])
        return out

    return map_texts(text_frame(docs, id_col, text_col), each, "trigram binary, doc_ids array<long>", pa.schema([("trigram", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]), lambda: slots_for(grams))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the secrets found: array of (kind, start, end) by start, then in the order of the rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(mentioned, queries)))

    def setup() -> tuple:
        return slots_for(grams), [(re.compile(r.pattern.encode()), re.compile(r.pattern)) for r in rules]

    def each(ids: list, texts: list[bytes], tools: tuple) -> dict:
        slots, compiled = tools
        found: list[list] = [[] for _ in texts]
        for start, part in blocks(texts):
            index, decoded = Index(part, slots, grams), {}
            for k, (rule, query, (raw, exact)) in enumerate(zip(rules, queries, compiled, strict=True)):
                for r in np.flatnonzero(index.search(query)):
                    # A byte-wise look first spares most texts of a full scan the decoding.
                    if query is True and not raw.search(part[r]):
                        continue
                    text = decoded[r] = decoded.get(r) or part[r].decode()
                    found[start + r] += [(m.start(), k, m.end()) for m in exact.finditer(text) if len(m[rule.group]) >= rule.least]
        return {"doc_id": ids, "secrets": [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]}

    secret = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return map_texts(text_frame(docs, id_col, text_col), each, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>", pa.schema([("doc_id", pa.int64()), ("secrets", pa.list_(secret))]), setup)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))



#: The same rules as the SQL engine's expressions: white space and letters of either case are spelt out.
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_IN_SQL = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "url_login": rf"[a-z][a-z0-9+.-]{{1,20}}://[^{_BLANK}:/@]{{1,64}}:[^{_BLANK}:/@]{{1,64}}@",
}


def _matches(k: int, rule: Rule) -> str:
    pattern = _IN_SQL.get(rule.kind, rule.pattern).replace("'", "''")
    return f"SELECT rid, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS held, string_split_regex(text, '{pattern}') AS gaps FROM docs"


#: Places are the lengths of the matches, and of what stands between them, up to each.
OP1_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), matched AS (
  {" UNION ALL ".join(_matches(k, r) for k, r in enumerate(BASE + MORE))}
), numbered AS (
  SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matched WHERE len(found) > 0
), spans AS (
  SELECT rid, k, kind, coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS start, len(found[i]) AS size
  FROM numbered WHERE len(held[i]) >= least
), lines AS (
  SELECT rid, k, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS line FROM spans
), joined AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(line, ',' ORDER BY start, k) FILTER (k < {len(BASE)}) AS base, string_agg(line, ',' ORDER BY start, k) AS spans
  FROM lines GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (rid)
"""
