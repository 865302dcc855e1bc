"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised directly: each token's bytes are mapped to one character a byte, its score
is its negative rank, its id its place by rank, and normalisation is the identity. Merging the pair
of the highest score first is then merging the pair of the lowest rank first. A pre-token that is
itself in the vocabulary is one token, as in the rank-based encoders. Decoding maps ids back to
bytes and joins them.

Null texts are empty: no ids, and the digests of nothing. Repeated rows are encoded each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

from pyspark.sql import DataFrame

from polystore.llm.common import map_rows

FIRST = 0x100  # the character of byte 0; the others follow
CACHE_ENTRIES = 300_000
LONG = 64
#: Fixed values of the sentencepiece model format (field numbers and enumerated values).
NORMAL, UNKNOWN, BPE_MODEL = 1, 2, 2
VARINT, BYTES, FIXED32 = 0, 2, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, kind: int, value) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == VARINT:
        return head + _varint(value & (1 << 64) - 1)
    if kind == FIXED32:
        return head + struct.pack("<f", value)
    return head + _varint(len(value)) + value


TO_CHARS = {b: chr(FIRST + b) for b in range(256)}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose id of a token is its place among the ranks; the unknown piece comes last."""
    pieces = [
        _field(1, BYTES, as_chars(token).encode()) + _field(2, FIXED32, float(-rank)) + _field(3, VARINT, NORMAL)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(_field(1, BYTES, b"<unk>") + _field(2, FIXED32, 0.0) + _field(3, VARINT, UNKNOWN))
    trainer = _field(3, VARINT, BPE_MODEL) + _field(4, VARINT, len(pieces)) + _field(40, VARINT, len(pieces) - 1) + b"".join(_field(n, VARINT, -1) for n in (41, 42, 43))
    normaliser = _field(1, BYTES, b"identity") + b"".join(_field(n, VARINT, 0) for n in (3, 4, 5))
    return b"".join(_field(1, BYTES, p) for p in pieces) + _field(2, BYTES, trainer) + _field(3, BYTES, normaliser)


class Codec:
    """encode() and decode() of one vocabulary; remembers the ids of short pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(ranks_path)
        self.by_place = [r for _, r in sorted((r, r) for r in self.ranks.values())]
        self.plain = self.by_place == list(range(len(self.by_place)))
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, parts: list[str]) -> None:
        """Adds the ids of pre-tokens that aren't known yet, in one call of the library."""
        ranks, rest = self.ranks, []
        for p in parts:
            whole = ranks.get(p.encode())
            if whole is None:
                rest.append(p)
            else:
                self.known[p] = (whole,)
        for p, ids in zip(rest, self.processor.encode([as_chars(p.encode()) for p in rest], num_threads=1), strict=True):
            self.known[p] = tuple(ids) if self.plain else tuple(self.by_place[i] for i in ids)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        known, parts = self.known, list(map(self.split, texts))
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = set().union(*parts)
        if new:
            self.learn(list(new))
        ids = [list(chain.from_iterable(map(known.__getitem__, p))) for p in parts]
        for p in new:
            if len(p) > LONG:
                del known[p]
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, and the ids themselves if ids is set."""

    def make():
        codec = Codec(ranks_path, pattern)
        digits = {r: str(r) for r in codec.ranks.values()}

        def work(rows):
            out = []
            for r, got in zip(rows, codec.encode_many([r["text"] or "" for r in rows]), strict=True):
                said = ",".join(map(digits.__getitem__, got))
                row = (r["doc_id"], len(got), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(codec.decode(got)).hexdigest())
                out.append((*row, got) if ids else row)
            return out

        return work

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(picked, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
