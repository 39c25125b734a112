"""BPE encoding and decoding with word ends, for vocabularies in the tokenizers JSON format.

A pre-token's symbols are merged by a segment tree over the ranks of adjacent pairs: its root
holds the leftmost pair of the lowest rank; a merge changes two neighbouring pairs and one
vanishing pair, three point updates of logarithmic cost each; it ends when no pair can merge.
Nodes have sixteen children.  Pre-tokens repeat, so each worker keeps the results of those seen
last while its stage lasts, in caches bounded by bytes.

Splitting a text follows the vocabulary file: special tokens first, then normalisation
(NFC, white space, lower case), then the split pattern and the byte alphabet.  Texts made of
characters below U+0180, on which Python and the library agree, are split by one compiled
pattern; all others by the library's own normalizer and pre-tokenizer.  A vocabulary file with
other rules than these is an error, never counted by the wrong ones.

Cases: a null text is an empty one: no tokens, the digest of the empty string, and an empty
text back; texts and pre-tokens of any length are encoded whole (a pre-token too long for the
cache is merged anew each time); repeated rows and ties give equal rows; an empty table stays
empty; columns other than doc_id and text are never read, so that of ``docs`` with clashing
names none reaches the result, which has its own columns alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, held

NAME = "word_bpe_49k.json"
#: Bytes of the young generation of a worker's pre-token caches; as many may be old.
CACHE_BYTES = 24 << 20
#: What an entry takes of a dictionary's own table, about.
ENTRY = 56
#: Documents whose ids are gathered before they leave as an Arrow batch.
ROWS = 256
END = "</w>"
NEVER = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character of each byte, by the rule of byte-level BPE: bytes that print
    stand for themselves, the others for U+0100 onwards in order."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


ALPHABET = byte_alphabet()
BYTES = {c: b for b, c in enumerate(ALPHABET)}


def unmapped(text: str) -> bytes:
    """The bytes that stand behind text in the byte alphabet."""
    return bytes([BYTES[c] for c in text])


# The rules of a vocabulary file that this module follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_rules(spec: dict) -> None:
    """Raises where a vocabulary file asks for other rules than those above."""
    model = spec["model"]
    unlike = [k for k, v in MODEL.items() if model.get(k, v) != v]
    unlike += [k for k, v in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("decoder", None)) if spec.get(k) != v]
    unlike += [t["content"] for t in spec["added_tokens"] if any(t.get(k, v) != v for k, v in ADDED.items())]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != END or unlike:
        raise ValueError(f"vocabulary file with other rules than BPE with word ends: {', '.join(unlike) or 'model'}")


#: Characters that the fast split takes: below U+0180, without U+0130 (its lower case has two).
OTHER = re.compile("[^\\x00-įı-ſ]")


def _class(kind: str) -> str:
    return "".join(map(re.escape, (chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)))


_LETTERS, _NUMBERS, _BLANKS = _class("L"), _class("N"), "\\t-\\r \x85\xa0"
FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


#: A pair of ids is one number, so that looking up its rank hashes no text.
PAIR = 32
#: Children of a node of the tree: one comparison of so many is one step of the interpreter.
FAN = 16


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The ids after all merges, always the leftmost pair of the lowest rank first.

    ``ranks`` has the rank of each mergeable pair (left << PAIR | right), ``made`` the id that
    the merge of each rank gives.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    find = ranks.get
    # A leaf holds rank * n + position, so the least is the leftmost of the lowest rank.
    leaf = [NEVER if (r := find(a << PAIR | b)) is None else r * n + i for i, (a, b) in enumerate(pairwise(symbols))]
    if min(leaf) == NEVER:
        return symbols
    levels = [leaf]
    while len(levels[-1]) > 1 or len(levels) == 1:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, flat = levels[-1], len(levels) == 2
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := top[0]) != NEVER:
        r, i = divmod(least, n)
        j = after[i]
        symbols[i] = new = made[r]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            leaf[j] = NEVER  # the pair that began with the right symbol
            r = find(new << PAIR | symbols[k])
            leaf[i] = NEVER if r is None else r * n + i
        else:
            leaf[i] = NEVER
        if (h := before[i]) >= 0:
            r = find(symbols[h] << PAIR | new)
            leaf[h] = NEVER if r is None else r * n + h
        if flat:  # all three leaves are below the root
            top[0] = min(leaf)
            continue
        for at in (j, i, h):
            for below, above in pairwise(levels):
                if at < 0 or at >= len(below):
                    break
                at //= FAN
                least = min(below[at * FAN : at * FAN + FAN])
                if above[at] == least:
                    break
                above[at] = least
    return [s for s in symbols if s >= 0]


class Coder:
    """A vocabulary file, its splitting rules and its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_rules(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in {**self.vocab, **self.special}.items()}
        self.digits = {i: str(i) for i in self.names}
        self.ranks, self.made = {}, []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(self.vocab[a] << PAIR | self.vocab[b], r)
            self.made.append(self.vocab[a + b])
        self.inner = [self.vocab[c] for c in ALPHABET]
        self.last = [self.vocab[c + END] for c in ALPHABET]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._path, self._library = path, None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def tokens(self, raw: bytes) -> list[int]:
        """The ids of a pre-token's UTF-8 bytes."""
        if not raw:
            return []
        inner = self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merge(symbols, self.ranks, self.made)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text, and whether each is a special token."""
        if self.cut is None or not any(s in text for s in self.special):
            yield text, False
            return
        for i, part in enumerate(self.cut.split(text)):
            if part:
                yield part, bool(i & 1)

    def split(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens of a stretch, and whether they are in the byte alphabet already."""
        if OTHER.search(text):
            lib = self.library()
            return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))], True
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return FAST.findall(text.lower()), False

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as for vocabularies without a decoder; unknown ids vanish."""
        return " ".join([s for i in ids if (s := self.names.get(i)) is not None])

    def restore(self, ids: Iterable[int]) -> str:
        """The normalised text's pre-tokens joined by spaces: bytes and word ends undone."""
        found = [s for i in ids if (s := self.names.get(i)) is not None]
        marked = "".join([s + END if s in self.special else s for s in found])
        return " ".join(w if w in self.special else unmapped(w).decode("utf-8", "replace") for w in marked.split(END) if w)


class Room:
    """The bytes that the young generations of several caches may take together.

    When they are used up, every young generation becomes the old one, whose entries return as
    they are asked for again; so frequent pre-tokens stay and rare ones go.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.used, self.caches = limit, 0, []

    def take(self, size: int) -> None:
        if self.used + size > self.limit:
            for c in self.caches:
                c.turn()
            self.used = 0
        self.used += size


class Cache(dict):
    """Results by pre-token, besides those it starts with, within a ``Room``."""

    def __init__(self, make: Callable, room: Room, start: dict | None = None) -> None:
        super().__init__(start or {})
        self.make, self.room, self.start, self.old = make, room, start or {}, {}
        room.caches.append(self)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = ENTRY + sys.getsizeof(key) + sys.getsizeof(value)
        if size <= self.room.limit >> 4:
            self.room.take(size)
            self[key] = value
        return value

    def turn(self) -> None:
        self.old = {}  # before the copy, so that three generations never stand together
        self.old = dict(self)
        self.clear()
        self.update(self.start)


class Encoder:
    """Texts to their ids, as 32-bit numbers in native order, by way of the caches."""

    def __init__(self, path: str) -> None:
        self.coder = c = Coder(path)
        c.vocab = {}  # merging and decoding need it no more
        room = Room(CACHE_BYTES)
        pack = lambda ids: np.array(ids, np.int32).tobytes()
        self.special = {s: pack([i]) for s, i in c.special.items()}
        self.mapped = Cache(lambda m: pack(c.tokens(unmapped(m))), room)
        self.plain = Cache(lambda w: pack(c.tokens(w.encode("utf-8"))), room)

    def packed(self, text: str) -> bytes:
        out: list[bytes] = []
        for part, special in self.coder.pieces(text):
            if special:
                out.append(self.special[part])
            else:
                found, mapped = self.coder.split(part)
                out += map((self.mapped if mapped else self.plain).__getitem__, found)
        return b"".join(out)

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def encoder(path: str) -> Encoder:
    """This worker's encoder, kept while one stage after the other asks for it."""
    return held(("bpe", path), partial(Encoder, path))


def encode(path: str, text: str) -> list[int]:
    return encoder(path).ids(text)


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, name: str = NAME) -> DataFrame:
    """One row per document: token count, and digests of its ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(public_tokenizers.path(name))
        digits, decode = code.coder.digits, code.coder.decode
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            n, shown, back = [], [], []
            for x in batch.column(1):
                ids = code.ids(x.as_py())
                n.append(len(ids))
                shown.append(sha(" ".join([digits[i] for i in ids])))
                back.append(sha(decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_rows(docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, DIGEST, keeps=True)


def encode_documents(docs: DataFrame, name: str = NAME) -> DataFrame:
    """The general form: doc_id, the ids, and the text that decoding them gives; no other
    column.  Ids leave ``ROWS`` documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(public_tokenizers.path(name))
        decode = code.coder.decode
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part, packed, ends, back = batch.slice(at, ROWS), bytearray(), [0], []
                for x in part.column(1):
                    ids = code.packed(x.as_py())
                    packed += ids
                    back.append(decode(np.frombuffer(ids, np.int32).tolist()))
                    ends.append(len(packed) // 4)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(packed, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    return arrow_rows(docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, "doc_id bigint, ids array<int>, decoded string", keeps=True)
