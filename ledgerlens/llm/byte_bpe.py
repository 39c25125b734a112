"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

A vocabulary of ranked byte strings is serialised as a sentencepiece BPE model: each byte string
becomes a piece in the byte alphabet (one printable character a byte) whose score is its negative
rank, and normalisation is the identity.  Sentencepiece merges the pair whose joined piece has
the best score, leftmost first, which is the lowest rank first; so a pre-token in the byte
alphabet comes out as the ranks' own merges give it.  Strings of the vocabulary that the merges
do not reach, if there are any, are found on the driver and looked up, as the rank file's library
does with whole pre-tokens.  Decoding maps each id's piece back to its bytes.

Splitting follows ``public_tokenizers.PATTERN``.  Texts of characters below U+0180 are split by
one compiled pattern of the same meaning; others by ``regex``, whose letters and numbers are
narrowed to those of the rank file's library where their Unicode versions differ (the library is
asked for its classes once, on the driver).

Cases: a null text is an empty one: no tokens, the digest of no bytes, and no bytes back; texts
and pre-tokens of any length are encoded whole (a pre-token too long for the cache is merged
anew each time); repeated rows and ties give equal rows; an empty table stays empty; columns
other than doc_id and text, whatever their names, are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import _BLANKS, _LETTERS, _NUMBERS, ALPHABET, CACHE_BYTES, OTHER, ROWS, Cache, Room, unmapped
from ledgerlens.llm.common import arrow_rows, held

NAME = "byte_bpe_50k.tiktoken"
#: Bytes that read as Latin-1 characters, to the byte alphabet.
MAPPED = {b: ALPHABET[b] for b in range(256)}
#: The unknown piece that every model must have; its characters are outside the byte alphabet.
UNKNOWN = "▁unknown"
# Fixed values of the model format: field numbers and enumerations of its protocol buffers.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, UNKNOWN_KIND = 1, 2, 3, 1, 2
MODEL_TYPE, VOCAB_SIZE, UNKNOWN_ID, UNKNOWN_PIECE, BPE = 3, 4, 40, 45, 2
RULE_NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPED_BLANKS = 1, 3, 4, 5


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def chunk(field: int, raw: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(raw)) + raw


def in_alphabet(raw: bytes) -> str:
    return raw.decode("latin-1").translate(MAPPED)


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file (base64 and rank, a line each)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialised(tokens: list[bytes], ranks: dict[bytes, int]) -> bytes:
    """The model of ``tokens`` in the order of their ranks; a piece's id is its place."""
    out = bytearray()
    for t in tokens:
        piece = chunk(PIECE, in_alphabet(t).encode("utf-8")) + varint(SCORE << 3 | 5) + struct.pack("<f", -ranks[t]) + number(KIND, NORMAL)
        out += chunk(PIECES, piece)
    out += chunk(PIECES, chunk(PIECE, UNKNOWN.encode("utf-8")) + number(KIND, UNKNOWN_KIND))
    out += chunk(TRAINER, number(MODEL_TYPE, BPE) + number(VOCAB_SIZE, len(tokens) + 1) + number(UNKNOWN_ID, len(tokens)) + chunk(UNKNOWN_PIECE, UNKNOWN.encode("utf-8")))
    out += chunk(NORMALIZER, chunk(RULE_NAME, b"identity") + number(DUMMY_PREFIX, 0) + number(EXTRA_BLANKS, 0) + number(ESCAPED_BLANKS, 0))
    return bytes(out)


def spans(found: Iterable[str]) -> str:
    """Characters as the inside of a pattern's class, neighbours as ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, found)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(1)
def narrowed() -> tuple[str, str]:
    """The characters (a class's inside) that ``regex`` and the rank file's library put in
    different classes, and the pattern with the library's classes."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    pattern, odd = public_tokenizers.PATTERN, set()
    for kind in (r"\p{L}", r"\p{N}"):
        bytes_only = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs, ours = set(bytes_only.decode(bytes_only.encode_ordinary(every))), set(regex.findall(kind, every))
        more, less = spans(theirs - ours), spans(ours - theirs)
        one = f"[{kind}--[{less}]]" if less else kind
        pattern = pattern.replace(kind, f"[{one}||[{more}]]" if more else one)
        odd |= theirs ^ ours
    return spans(odd), pattern


@dataclass(frozen=True)
class Vocabulary:
    """What workers need of a rank file; its size is the vocabulary's."""

    model: bytes
    ids: tuple[int, ...]
    unreached: tuple[bytes, ...]
    odd: str
    pattern: str


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    ranks = read_ranks(path)
    tokens = sorted(ranks, key=ranks.__getitem__)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"rank file without the single bytes {missing}")
    if len(set(ranks.values())) < len(ranks) or max(ranks.values()) >= 1 << 24:
        raise ValueError("rank file with equal ranks, or ranks that a piece's score cannot hold")
    model = serialised(tokens, ranks)
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = pieces.encode([in_alphabet(t) for t in tokens], num_threads=1)
    unreached = tuple(t for i, (t, ids) in enumerate(zip(tokens, found, strict=True)) if ids != [i])
    return Vocabulary(model, tuple(ranks[t] for t in tokens), unreached, *narrowed())


#: The pattern for texts that have no character from U+0180 on.
LOW = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")


class ByteEncoder:
    """Texts to ids, packed as little-endian unsigned 32-bit numbers, and back to bytes."""

    def __init__(self, known: Vocabulary) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=known.model)
        self.numbers = np.array(known.ids, "<u4")
        pieces = [self.model.id_to_piece(i) for i in range(len(known.ids))]
        self.bytes_of = {n: unmapped(p) for n, p in zip(known.ids, pieces, strict=True)}
        rank_of = {b: n for n, b in self.bytes_of.items()}
        start = {t.decode("utf-8"): np.array([rank_of[t]], "<u4").tobytes() for t in known.unreached if _is_text(t)}
        self.cache = Cache(self._packed, Room(CACHE_BYTES), start)
        self.plain = regex.compile(public_tokenizers.PATTERN)
        self.odd = regex.compile(f"[{known.odd}]") if known.odd else None
        self.narrow = regex.compile(known.pattern, regex.V1)

    def _packed(self, pre_token: str) -> bytes:
        return self.numbers[self.model.encode(in_alphabet(pre_token.encode("utf-8")))].tobytes()

    def split(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return LOW.findall(text)
        return (self.narrow if self.odd and self.odd.search(text) else self.plain).findall(text)

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def byte_encoder(path: str, known: Vocabulary) -> ByteEncoder:
    """This worker's encoder, kept while its stage lasts."""
    return held(("byte-bpe", path), partial(ByteEncoder, known))


def _over_texts(docs: DataFrame, name: str, row, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """doc_id and what ``row(encoder, packed ids)`` gives for each text, ``ROWS`` at a time."""
    path = public_tokenizers.path(name)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = byte_encoder(path, known.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = [row(code, code.packed(x.as_py())) for x in part.column(1)]
                made = [pa.array(list(values), kind) for values, kind in zip(zip(*found, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", *columns])

    return arrow_rows(docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, schema, keeps=True)


def byte_bpe_digests(docs: DataFrame, name: str = NAME) -> DataFrame:
    """One row per document: token count, and digests of its ids and of what they decode to."""

    def row(code: ByteEncoder, packed: bytes) -> tuple:
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(code.decoded(packed)).hexdigest()

    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _over_texts(docs, name, row, columns, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def byte_encode_documents(docs: DataFrame, name: str = NAME) -> DataFrame:
    """The general form: doc_id, the ids, and the bytes that decoding them gives."""

    def row(code: ByteEncoder, packed: bytes) -> tuple:
        return np.frombuffer(packed, "<u4"), code.decoded(packed)

    columns = {"ids": pa.list_(pa.int64()), "decoded": pa.binary()}
    return _over_texts(docs, name, row, columns, "doc_id bigint, ids array<bigint>, decoded binary")
