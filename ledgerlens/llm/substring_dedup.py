"""Exact substring dedup: Rabin-Karp hashes of every window of ``WINDOW`` words.

A word goes if a window that covers it also starts in a document of smaller doc_id; windows
are judged on the input.  Overlapping and adjoining windows merge into maximal intervals.

How it scales.  Documents are dealt into blocks by ranges of doc_id, cut so that blocks have
about equal bytes; so "a smaller doc_id" means "an earlier block", or an earlier document of
the same block.  A block computes the rolling hashes of all its windows with numpy, keeps its
distinct ones in sorted order, and ships them as packed runs, one for each range of hash
values (a bucket) that it has any of; that is about ten bytes a window, nothing else, and
never more runs than windows, as a run's order identifies its windows.  Spark gathers a
bucket's runs in one task, which merges and counts them and answers each with one bit a
window: does an earlier block have it?  Back at the block the same order is rebuilt, answers
are laid on it, and the words are removed.  A passage shared by any number of documents
appears once a block, so hot passages make no hot bucket.  Blocks and buckets are fixed by
the memory of a task; their numbers follow the input.  The driver holds one number a block.
Blocks are cut from a sample that takes a document in proportion to its bytes, some ``POINTS``
points a block; it decides where blocks end, nothing else.

Hashes have 96 bits: a rolling one of 64, and a second one of 32 with another multiplier, so
that 10^13 windows meet by accident less than once.

Cases: a null text has no words, and keeps the digest of the empty string; texts shorter than
a window keep everything; texts of any length are one document of one block, hashed and
joined again ``CHUNK`` bytes at a time; rows without doc_id count as larger than all others and
never remove words from each other, so they are dealt into blocks of their own by their text,
equal ones as one; rows that share a doc_id are one document's parts, which never remove words
from each other either; an empty table stays empty; columns other than doc_id and text are
never read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held, parts, ship

WINDOW = 13
#: Text bytes of a block, and windows of a bucket.
BLOCK, BUCKET = 8 << 20, 2 << 20
#: What a document weighs where blocks are cut beside its bytes, about what it takes in memory; sample points a block.
BESIDE, POINTS = 1024, 64
#: Bytes of a text that are hashed at a time; the first block of rows without an id.
CHUNK, UNKNOWN = 1 << 20, 1 << 40

_RNG = np.random.default_rng(13)
#: A random 64-bit value a byte; odd multipliers, which have inverses modulo 2^64.
BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
MULTIPLIER = np.uint64(int(_RNG.integers(1 << 40, 1 << 62)) * 2 + 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
SECOND_MULTIPLIER = np.uint32(int(_RNG.integers(1 << 20, 1 << 30)) * 2 + 1)
WORD_MULTIPLIER = np.uint64(int(_RNG.integers(1 << 40, 1 << 62)) * 2 + 1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (the finishing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polynomial value of every word of some bytes, from prefix sums over them."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~BLANK[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(MULTIPLIER, len(data)), out=sums[1:])
    return start, end, (sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a text, chunk by chunk.  A word's value does not
    depend on its place, and a word that a chunk's edge cuts is put together again."""
    data, found = np.frombuffer(raw, np.uint8), []
    for at in range(0, len(data), CHUNK):
        start, end, value = chunk_words(data[at : at + CHUNK])
        start, end = (start + at).astype(np.int32), (end + at).astype(np.int32)
        if found and len(start) and len(found[-1][1]) and found[-1][1][-1] == start[0] == at:
            before = found[-1]
            shift = np.uint64(pow(int(MULTIPLIER), int(before[1][-1] - before[0][-1]), 1 << 64))
            before[2][-1:] += value[:1] * shift
            before[1][-1] = end[0]
            start, end, value = start[1:], end[1:], value[1:]
            if not len(start):  # the word may go on
                continue
        found.append((start, end, value))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    start, end, value = (np.concatenate(x) for x in zip(*found))
    return start, end, mixed(value + (end - start).astype(np.uint64))


def joined(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words at these places with one space between, some thousand of them at a time."""
    each = CHUNK // 16
    return b" ".join(b" ".join([raw[a:b] for a, b in zip(start[i : i + each].tolist(), end[i : i + each].tolist())]) for i in range(0, len(start), each))


def window_hashes(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of each run of ``window`` words, of 64 and of 32 bits: a multiplication
    and an addition a step each."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    low = (words >> np.uint64(32)).astype(np.uint32)
    value, second = words[:n].copy(), low[:n].copy()
    for i in range(1, window):
        value *= WORD_MULTIPLIER
        value += words[i : i + n]
        second *= SECOND_MULTIPLIER
        second += low[i : i + n]
    return mixed(value), second


def in_order(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by (h, x), equal ones as they stand, and where in it a value begins."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], x[order]
    same, differ = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & differ).any():  # equal in 64 bits, not in 96: next to never
        order = np.lexsort((x, h))
        a, b = h[order], x[order]
        same, differ = a[1:] == a[:-1], b[1:] != b[:-1]
    return order, np.concatenate((np.ones(min(len(h), 1), bool), ~same | differ))


def prepared(ids: list, raws: list[bytes], window: int) -> tuple:
    """A block's documents in the order of doc_id (null last): (order, spans, owner of each
    window by rank of doc_id, distinct hashes in two arrays, index of each window in these)."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raws[i]))
    spans, first, second, owner, rank, last = {}, [], [], [], -1, ()
    for i in order:
        if ids[i] != last:
            rank, last = rank + 1, ids[i]
        start, end, words = word_hashes(raws[i])
        h, x = window_hashes(words, window)
        spans[i] = (start, end, len(h))
        first.append(h)
        second.append(x)
        owner.append(np.full(len(h), rank, np.int32))
    h, x, owner = np.concatenate(first), np.concatenate(second), np.concatenate(owner)
    del first, second
    by, new = in_order(h, x)
    index = np.empty(len(h), np.int32)
    index[by] = np.cumsum(new, dtype=np.int32) - 1
    by = by[new]
    return order, spans, owner, h[by], x[by], index


def pack(h: np.ndarray, x: np.ndarray) -> bytes:
    """Sorted 64-bit values as a width and the planes of their differences' bytes, and the 32
    further bits of each."""
    delta = np.diff(h, prepend=np.uint64(0))
    width = max(1, (int(delta.max()).bit_length() + 7) // 8)
    planes = delta.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes() + x.astype("<u4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    n = (len(data) - 1) // (width + 4)
    planes = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(data, "<u4", n, 1 + n * width)


def runs(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each bucket that sorted hashes have any of."""
    if not len(h):
        return []
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]))
    return list(zip(bucket[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist()))


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Words inside any of the windows that begin at ``starts``: maximal intervals, as a mask."""
    step = np.zeros(n_words + 1, np.int8)
    step[starts] += 1  # no window begins twice
    step[starts + window] -= 1
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` as (block, none, id, raw, copies), partitioned by block, and the bytes of all texts.

    Blocks are ranges of ids that have about ``BLOCK`` bytes each, since a document has points
    in the sample that cuts them by its weight.  Only the bounds, one number a block, come to the
    driver.  Rows without an id never remove words from each other, so their blocks need no
    order: equal texts are one row with a number of copies, dealt by the text's hash.
    """
    spark = docs.sparkSession
    # Ids without nulls, which pandas would turn into floats.
    id_ = F.col("doc_id").cast("bigint")
    rows = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    weighs = F.octet_length("raw") + BESIDE
    sums = {r["none"]: r for r in rows.groupBy("none").agg(F.sum(F.octet_length("raw")).alias("size"), F.sum(weighs).alias("weight")).collect()}
    size = sum(int(r["size"]) for r in sums.values())
    known, unknown = (int(sums[k]["weight"]) if k in sums else 0 for k in (False, True))
    if known + unknown <= BLOCK:
        placed = rows.select(F.lit(0).cast("bigint").alias("block"), "*", F.lit(1).cast("bigint").alias("copies"))
        return placed.repartition(parts(spark, known + unknown, BLOCK), "block"), size
    count = max(1, -(-known // BLOCK))
    block = F.lit(0).cast("bigint")
    if count > 1:
        # A point for each full share of a block, and one by chance (of the id's hash) for the rest.
        share = weighs / F.lit(BLOCK / POINTS)
        points = (F.floor(share) + (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (share - F.floor(share)) * (1 << 20)).cast("bigint")).cast("int")
        drawn = rows.filter("not none").select("id", points.alias("n")).filter("n > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("g")).select("id")
        drawn = drawn.repartitionByRange(count, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"))
        bounds = spark.sparkContext.broadcast(np.sort(drawn.select("low").toArrow()["low"].to_numpy())[1:])

        @F.arrow_udf("bigint")
        def block_of(ids: pa.Array) -> pa.Array:
            held(None, lambda: None)
            return pa.array(np.searchsorted(bounds.value, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int64))

        block = block_of("id")
    placed = rows.filter("not none") if unknown else rows
    placed = placed.select(block.alias("block"), "*", F.lit(1).cast("bigint").alias("copies"))
    if unknown:
        bare = rows.filter("none").groupBy("none", "id", "raw").agg(F.count("*").alias("copies"))
        placed = placed.union(bare.select((F.pmod(F.xxhash64("raw"), F.lit(-(-unknown // BLOCK))) + UNKNOWN).alias("block"), "none", "id", "raw", "copies"))
    return placed.repartition(parts(spark, known + unknown, BLOCK), "block"), size


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, n_words, removed intervals (first and end word), and the kept text, for each row."""
    spark = docs.sparkSession
    ship(spark)
    rows, size = _blocks(docs)
    # A word and its blank have six bytes or so.
    buckets = max(1, -(-size // (6 * BUCKET)))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        held(None, lambda: None)
        h, x = prepared(_ids(pdf), pdf["raw"].tolist(), window)[3:5]
        found = [(int(pdf["block"].iloc[0]), b, pack(h[i:j], x[i:j])) for b, i, j in runs(h, buckets)]
        return pd.DataFrame(found, columns=["block", "bucket", "piece"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        held(None, lambda: None)
        pdf = pdf.sort_values("block")
        pieces = [unpack(p) for p in pdf["piece"]]
        ends = np.cumsum([len(h) for h, _ in pieces])
        order, new = in_order(np.concatenate([h for h, _ in pieces]), np.concatenate([x for _, x in pieces]))
        # Equal hashes stand in the order of blocks, each block's once; the first must have an id.
        block = np.repeat(pdf["block"].to_numpy(np.int64), [len(h) for h, _ in pieces])
        leads = block[order[new]] < UNKNOWN
        seen = np.zeros(len(order), bool)
        seen[order] = ~new & leads[np.cumsum(new) - 1]
        bits = [np.packbits(s).tobytes() if s.any() else None for s in np.split(seen, ends[:-1])]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": bits}).dropna()

    def cut(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        held(None, lambda: None)
        ids, raws, copies = _ids(pdf), pdf["raw"].tolist(), pdf["copies"].tolist()
        order, spans, owner, h, _, index = prepared(ids, raws, window)
        seen, at = np.zeros(len(h), bool), {b: (i, j) for b, i, j in runs(h, buckets)}
        for b, bits in zip(answers["bucket"], answers["bits"]):
            i, j = at[b]
            seen[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
        first = np.full(len(h), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(first, index, owner)
        gone, begin, out = seen[index] | (owner > first[index]), 0, []
        for i in order:
            start, end, n = spans[i]
            starts = np.flatnonzero(gone[begin : begin + n])
            begin += n
            mask = covered(len(start), starts, window)
            edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
            raw = raws[i]
            kept = joined(raw, start[~mask], end[~mask])
            spots = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()
            out.append((ids[i] is None, ids[i] or 0, len(start), int(mask.sum()), spots, kept, copies[i]))
        return pd.DataFrame(out, columns=["none", "id", "n_words", "n_removed", "spans", "kept", "copies"])

    pieces = rows.groupBy("block").applyInPandas(send, "block bigint, bucket bigint, piece binary")
    pieces = pieces.repartition(parts(spark, buckets, 1), "bucket")
    answers = pieces.groupBy("bucket").applyInPandas(judge, "block bigint, bucket bigint, bits binary")
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(cut, "none boolean, id bigint, n_words bigint, n_removed bigint, spans array<bigint>, kept binary, copies bigint")
    out = out.select(F.when(~F.col("none"), F.col("id")).alias("id"), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "copy")


def _ids(pdf: pd.DataFrame) -> list:
    return [None if none else i for none, i in zip(pdf["none"].tolist(), pdf["id"].tolist())]


def substring_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by single spaces."""
    out = remove_repeats(docs, window)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
