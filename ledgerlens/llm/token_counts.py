"""Token counts by the whole-token shortcut.

Offline, on the driver and once a vocabulary, every string that ends a word is put through the
merges by itself; those that come out as one token are proven whole and sent to the workers.
A pre-token whose bytes are such a string counts
as one token by a single lookup, be it plain text or in the byte alphabet; only the others are
merged (see ``bpe`` for splitting, merging and the cases of null, empty, long and repeated texts).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import BYTES, CACHE_BYTES, END, NAME, Cache, Coder, Room, unmapped
from ledgerlens.llm.common import arrow_rows, held

LIMIT = 2048


def whole_tokens(code: Coder) -> dict[str, int]:
    """The pre-tokens (plain text) proven to encode as one token, each with the count 1."""
    out = {}
    for s in code.vocab:
        if s.endswith(END) and len(s) > len(END):
            mapped = s[: -len(END)]
            if set(mapped) <= BYTES.keys() and code.tokens(raw := unmapped(mapped)) == [code.vocab[s]]:
                try:
                    out[raw.decode("utf-8")] = 1
                except UnicodeDecodeError:  # part of a character: no pre-token is that
                    continue
    return out


@lru_cache(4)
def proven(path: str) -> tuple[str, ...]:
    """The whole tokens of a vocabulary file; there are no more of them than it has entries."""
    return tuple(whole_tokens(Coder(path)))


def byte_form(whole: dict[str, int]) -> dict[str, int]:
    """The same table by the byte alphabet's form of each pre-token."""
    letters = {b: c for c, b in BYTES.items()}
    return {"".join([letters[b] for b in w.encode("utf-8")]): n for w, n in whole.items()}


class Counter:
    def __init__(self, path: str, whole: tuple[str, ...]) -> None:
        self.coder = c = Coder(path)
        ones, room = dict.fromkeys(whole, 1), Room(CACHE_BYTES)
        self.plain = Cache(lambda w: len(c.tokens(w.encode("utf-8"))), room, ones)
        self.mapped = Cache(lambda m: len(c.tokens(unmapped(m))), room, byte_form(ones))

    def count(self, text: str) -> int:
        n = 0
        for part, special in self.coder.pieces(text):
            if special:
                n += 1
            else:
                found, mapped = self.coder.split(part)
                n += sum(map((self.mapped if mapped else self.plain).__getitem__, found))
        return n


def counter(path: str, whole: tuple[str, ...]) -> Counter:
    """This worker's counter, kept while its stage lasts."""
    return held(("counts", path), partial(Counter, path, whole))


def token_counts(docs: DataFrame, name: str = NAME, limit: int = LIMIT) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether these exceed ``limit``."""
    whole = docs.sparkSession.sparkContext.broadcast(proven(public_tokenizers.path(name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(name), whole.value).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return arrow_rows(rows, run, "doc_id bigint, n_bytes bigint, n_tokens bigint", keeps=True).withColumn("over_limit", F.col("n_tokens") > limit)
