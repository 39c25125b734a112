"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has bit i where more than half of its shingles' XXH64 values have it.
Two fingerprints link when they differ in at most ``BITS`` = 2 bits.  They are cut into two
segments of 32 bits: a pair within 2 bits agrees in the low segment, or differs by at most
one bit in the high one (were it two or more there, none would be left for the low one).  So
each fingerprint enumerates the ball of radius 1 around its high segment and radius 0 around
its low one, looks these up in the segment tables, and every match is verified over all 64
bits within the join.  Of the two directions of a one-bit difference only that from 0 to 1
is probed.  Only distinct fingerprints take part; equal ones share a row.  A segment value that
m distinct fingerprints share costs up to 33 m^2 comparisons within the join, which Spark may
split over tasks; only what is within 2 bits leaves it.

Cases: null and blank texts have fingerprint zero and link like any other; texts of one or
two words have one shingle, the whole sequence; repeated doc_ids each get their row, and a
component's id is the least doc_id in it (null if all are null); texts of any length are
fingerprinted whole; an empty table stays empty; columns other than doc_id and text, whatever
their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, likely, settle
from ledgerlens.llm.graph import components

SHINGLE, SEED, BITS = 3, 42, 2


def fingerprint(raw: bytes) -> int:
    """The fingerprint of UTF-8 text, unsigned."""
    found = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    joined, k = b" ".join(found), min(SHINGLE, len(found))
    ends = list(accumulate(found, lambda at, w: at + 1 + len(w), initial=-1))
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(joined[a + 1 : b], SEED) for a, b in zip(ends, ends[k:])], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp): t is a hash of the text, fp a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "t", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return arrow_rows(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("t"), text.cast("binary").alias("raw")), run, "doc_id bigint, t bigint, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``BITS`` bits; ``fps`` has distinct fp."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    one = F.lit(1).cast("bigint")
    ball = F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key")))
    flips = [F.when(high.bitwiseAND(F.lit(1 << i)) == 0, F.struct(F.lit(0).alias("seg"), high.bitwiseOR(F.lit(1 << i)).alias("key"))) for i in range(32)]
    table = fps.select(F.col("fp").alias("b"), F.explode(ball).alias("at")).select("b", "at.seg", "at.key")
    probes = fps.select(F.col("fp").alias("a"), high.alias("h"), F.explode(F.concat(ball, F.array_compact(F.array(*flips)))).alias("at"))
    probes = probes.select("a", "at.seg", "at.key", ((F.col("at.seg") == 1) | (F.col("at.key") == F.col("h"))).alias("same"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    once = (F.col("a") < F.col("b")) | (~F.col("same") & (F.col("a") != F.col("b")))
    # A pair that agrees in the low segment is that segment's alone.
    once = once & ((F.col("p.seg") == 1) | (F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(0xFFFFFFFF)) != 0))
    on = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & near & once
    return probes.alias("p").join(table.alias("t"), on).select("a", "b")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The settled fingerprints, and (fp, root) with one root for each component."""
    fps = settle(fingerprints(docs), "fingerprints")
    distinct = fps.select("fp").distinct()
    roots = distinct.join(components(links(distinct)), F.col("fp") == F.col("node"), "left")
    return fps, roots.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of ``docs``."""
    fps, roots = grouped(docs)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    named = first.join(first.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of least doc_id (null
    last), then of least text hash; of repeated rows, any one.

    What is decided is which keys go or are repeated; only rows that a filter takes for such
    ones are shuffled, and repeated rows are one before they are.
    """
    fps, roots = grouped(docs)
    key, order = ["i", "none", "t"], F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    best = fps.groupBy("fp").agg(F.min(order).alias("o")).join(roots, "fp").groupBy("root").agg(F.min("o").alias("o"))
    chosen = best.select(F.coalesce("o.doc_id", F.lit(0)).alias("i"), F.col("o.none").alias("none"), F.col("o.t").alias("t"), F.lit(True).alias("keep"))
    keys = fps.groupBy(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), "t").agg(F.count("*").alias("n"))
    marked = keys.join(chosen, key, "left").select(*key, F.coalesce("keep", F.lit(False)).alias("keep"), "n").filter("not keep or n > 1").drop("n")
    marked = settle(marked, "going")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    rows = likely(rows.withColumn("maybe", F.lit(False)), marked, *key, flag="maybe")
    # Rows that the filter takes wrongly have no mark and keys of their own, so they stay as well.
    kept = rows.filter("maybe").groupBy(*key).agg(F.first("row").alias("row")).join(marked, key, "left").filter("keep is null or keep")
    return rows.filter("not maybe").select("row.*").unionByName(kept.select("row.*"))
