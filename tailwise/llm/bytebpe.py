"""Byte-level BPE by sentencepiece, from a rank file alone.

A BPE model is serialised directly from the vocabulary: bytes become printable characters, each token a piece
scored by its negative rank, with identity normalisation, so sentencepiece merges pairs in rank order, leftmost
first. Pre-tokens are encoded one by one; a pre-token that is itself in the vocabulary is its id without merging.
Decoding maps the pieces back to bytes.

Defined cases: a null text counts as empty and has no ids; strings of special tokens are ordinary text; repeated
rows are coded one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tailwise.llm.common import id_text
from tailwise.llm.tokens import BulkEncoder


def byte_letters() -> list[str]:
    """A printable character for each byte: itself if it is a mark or letter of Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = {b: c for b, c in enumerate(LETTERS)}
TO_BYTES = {c: b for b, c in enumerate(LETTERS)}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value & (1 << 64) - 1)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece numbers are the ranks; one unknown piece comes last."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [field(1, field(1, t.decode("latin-1").translate(TO_LETTERS).encode()) + field(2, float(-k))) for k, t in enumerate(order)]
    pieces.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2)))
    trainer = field(3, 2) + field(4, len(pieces)) + field(40, len(order)) + field(41, -1) + field(42, -1) + field(43, -1)
    normaliser = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(pieces) + field(2, trainer) + field(3, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Classes:
    """Letter, number or other, as the reference library's regular expressions see a character that this Python's
    Unicode tables don't know yet."""

    def __init__(self):
        import tiktoken

        one = {bytes([b]): b for b in range(256)}
        self.probes = [(stand_in, tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=one, special_tokens={})) for stand_in, name, pattern in (("a", "letter", r"\p{L}"), ("0", "number", r"\p{N}"))]

    @functools.lru_cache(maxsize=10_000)  # noqa: B019  one object a process
    def stand_in(self, c: str) -> str:
        return next((s for s, probe in self.probes if probe.encode_ordinary(c)), "!")


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self.pattern = regex.compile(pattern)
        self.classes: Classes | None = None
        pieces = [self.model.id_to_piece(k) for k in range(len(self.ranks))]
        self.token_bytes = [bytes(TO_BYTES[c] for c in p) for p in pieces]
        self.bulk = BulkEncoder(self._encode)

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            self.classes = self.classes or Classes()
            seen = "".join(self.classes.stand_in(c) if unicodedata.category(c) == "Cn" else c for c in text)
            return [text[slice(*m.span())] for m in self.pattern.finditer(seen)]
        return self.pattern.findall(text)

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[t.encode() for t in self.pre_tokens(s)] for s in strings]
        merged = list({t for own in parts for t in own if t not in self.ranks})
        known = dict(zip(merged, self.model.encode([t.decode("latin-1").translate(TO_LETTERS) for t in merged], num_threads=1), strict=True))
        ids, sizes = [], []
        for own in parts:
            before = len(ids)
            for t in own:
                if t in known:
                    ids += known[t]
                else:
                    ids.append(self.ranks[t])
            sizes.append(len(ids) - before)
        return np.array(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.bulk.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per process and rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def code_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded (binary)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                found = own.encode(texts[at : at + 500])
                raw = [x.astype("<u4").tobytes() for x in found]
                decoded = [own.decode(x) for x in found]
                arrays = [batch.column(0).slice(at, 500), pa.array([len(x) for x in found], pa.int64())]
                arrays += [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (raw, decoded)]
                arrays += [pa.array(xs, pa.binary()) for xs in (raw, decoded)] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)

    return id_text(docs).mapInArrow(code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids)
