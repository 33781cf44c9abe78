"""Byte-level BPE through a sentencepiece model that is serialised straight from the ranks.

Each byte maps to one printable character, so a token of the rank file becomes a piece; its score is the
negative rank, so sentencepiece's best-score-first merging is lowest-rank-first merging.  The normaliser is
the identity.  Pre-tokens are encoded one by one; decoding is the inverse mapping from piece to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHE_WORDS, mapped, texts

LONG_PRETOKEN = 200


def byte_chars() -> list[str]:
    """A character for each byte: itself if it is printable Latin-1, else the next free one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: a float, a varint, or bytes with their length."""
    import struct

    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto.  Piece 0 is the unknown piece that the library asks for; rank r is piece r+1."""
    chars = byte_chars()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(r)) + _field(3, 1)) for r, t in enumerate(tokens)]
    no, off = 0, [(3, 0), (4, 0), (5, 0)]  # add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, no) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(2, b"") + b"".join(_field(n, v) for n, v in off)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.bytes_of = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.texts_of = [str(i) for i in range(len(self.bytes_of))]
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.map = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self.cache: dict[str, list[int]] = {}

    def encode_pretoken(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:  # a pre-token that is itself a token is never merged
            return [whole]
        return [i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.map))]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cache, add = self.cache, ids.extend
        for piece in self.find(text):
            got = cache.get(piece)
            if got is None:
                got = self.encode_pretoken(piece)
                if len(cache) < CACHE_WORDS and len(piece) <= LONG_PRETOKEN:
                    cache[piece] = got
            add(got)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One encoder a Python worker; the vocabulary files are installed on every machine."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, for each row's whole text.

    A null or empty text has no ids.  Rows are independent of one another: repeats, ties and a null doc_id go
    through as they are, and an empty table gives an empty one."""

    def run(batch: pa.RecordBatch) -> dict:
        codec = tokenizer(path, pattern)
        ids = [codec.encode(t) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "ids": ids, "n_tokens": [len(x) for x in ids]}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of `ids`; null ids give no bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        codec = tokenizer(path, pattern)
        return {"doc_id": batch.column("doc_id"), "decoded": [codec.decode(x or []) for x in batch.column("ids").to_pylist()]}

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, digest both; ids never leave the task."""

    def run(batch: pa.RecordBatch) -> dict:
        codec = tokenizer(path, pattern)
        counts, ids_sha, bytes_sha = [], [], []
        for text in texts(batch):
            ids = codec.encode(text)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(codec.texts_of.__getitem__, ids)).encode()).hexdigest())
            bytes_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": bytes_sha}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
