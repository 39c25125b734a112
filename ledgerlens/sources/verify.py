"""Proving events: an id is the SHA-256 of its event, a signature its author's.

Signatures are checked many at once (``schnorr.all_verified``), in a step of its own after the
events were read: in parallel, however few partitions the source has, and on nobody's deadline.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.sources.schnorr import all_verified
from ledgerlens.sources.storage import ship

#: Signatures checked at once.
TOGETHER = 1024


def event_id(e: dict) -> str:
    text = json.dumps([0, e["pubkey"], e["created_at"], e["kind"], e["tags"], e.get("content") or ""], separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def proven(events: list[dict]) -> list[bool]:
    """Whether each event's id and signature are its own."""
    out, signed = [False] * len(events), {}
    for i, e in enumerate(events):
        try:
            if e["id"] == event_id(e):
                signed[i] = bytes.fromhex(e["pubkey"]), bytes.fromhex(e["id"]), bytes.fromhex(e["sig"])
        except (KeyError, TypeError, ValueError, UnicodeEncodeError):
            continue
    for i, good in zip(signed, all_verified(signed.values()), strict=True):
        out[i] = good
    return out


def authentic(events: DataFrame) -> DataFrame:
    """The events (with ``RAW``'s columns) that are what they claim to be, and rows without an id,
    which tell of failures, as they are."""
    ship(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                batch = whole.slice(at, TOGETHER)
                rows = batch.select(["id", "pubkey", "kind", "created_at", "tags", "content", "sig"]).to_pylist()
                good = proven(rows)
                yield batch.filter(pa.array([ok or r["id"] is None for ok, r in zip(good, rows, strict=True)], pa.bool_()))

    if not events.isStreaming:  # a relay is one partition
        events = events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return events.mapInArrow(run, events.schema)
