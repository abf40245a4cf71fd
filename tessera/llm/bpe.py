"""Byte-level BPE encoding and decoding in linear time.

Vocabulary bytes are mapped to Latin-1 characters for a pyahocorasick automaton, which gives every
token that occurs in a piece of text.  Encoding walks left to right with the longest token at each
place; a token may follow another only if BPE itself would keep their border, which is decided by
undoing the merges of both sides (memoised per pair of tokens).  Where no token may follow, the
walk backs up to the next shorter token, and places found hopeless are remembered, so each is
visited once.  The result is the exact outcome of merging by rank.

Defined results: a null or empty text has no ids (their digests are those of empty strings); equal
texts give equal values; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table, text_frame

CACHED = 700_000
PAIRS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a token that no merge makes."""
        if token not in self.halves:
            whole, limit = self.tokens[token], token
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best >= limit:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self.shorter:
            whole = self.tokens[token]
            self.shorter[token] = next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), -1)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank the bytes of both leaves exactly these two tokens.

        Merges happen in the order of rank, so undo, of both inner neighbours, the later one first;
        at each state the border holds only if no merge across it comes before the last one undone.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, undone = left, right, len(self.tokens) + 1
        fits = True
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            # Undoing a on the left: a tie goes to the left merge, which comes first in the text.
            if across is not None and across < undone:
                fits = False
                break
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and a > b):
                a, undone = pa_[1], a
            else:
                b, undone = pb[0], b + 1  # a merge of equal rank across the border starts further left and wins
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[left, right] = fits
        return fits

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest = [(0, -1)] * len(piece)
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            at = end - found[0] + 1
            if found > longest[at]:
                longest[at] = found
        ids: list[int] = []
        hopeless = bytearray(len(piece) + 1)
        at, token = 0, longest[0][1]
        while True:
            size = len(self.tokens[token]) if token >= 0 else 0
            if size and not hopeless[at + size] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at += size
                if at == len(piece):
                    return ids
                token = longest[at][1]
            elif size:
                token = self.next_shorter(token)
            elif ids:
                hopeless[at] = 1
                token = ids.pop()
                at -= len(self.tokens[token])
                token = self.next_shorter(token)
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceIds(dict):
    """ids of pieces of text, as the bytes of small numbers, for most pieces recur."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe, self.kind = bpe, "<u2" if max(bpe.tokens) < 1 << 16 else "<u4"

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.bpe.encode(piece.encode()), dtype=self.kind).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = found
        return found

    def ids(self, pieces: list[str]) -> list[int]:
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), self.kind).tolist()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and the digests of ids and of the decoded bytes per document; with keep_ids the ids and bytes too."""

    def setup() -> tuple:
        import regex

        bpe = ByteBPE(read_ranks(ranks_path))
        return bpe, PieceIds(bpe), regex.compile(pattern).findall, {i: str(i) for i in bpe.tokens}

    def each(doc_ids: list, texts: list[bytes], tools: tuple) -> dict:
        bpe, cache, split, shown = tools
        out: dict = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for doc_id, text in zip(doc_ids, texts, strict=True):
            ids = cache.ids(split(text.decode()))
            decoded = bpe.decode(ids)
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                out["ids"].append(ids)
                out["decoded"].append(decoded)
        return out

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
        schema += ", ids array<int>, decoded binary"
    return map_texts(text_frame(docs, id_col, text_col), each, schema, pa.schema(fields), setup)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
