"""Reading events, and typing their tags once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.tags import parse_amount, parse_premium, tag, tag_values
from ledgerlens.schema import EVENT, RAW, SUBTYPE, TYPED
from ledgerlens.sources.relay import read_live
from ledgerlens.sources.verify import authentic


@dataclass(frozen=True)
class RelayStatus:
    """How one source of events (a path of dumped events) answered."""

    relay: str
    ok: bool
    message: str = ""


def read_relays(spark: SparkSession, relays: Sequence[str], form: str = "json", author: str | None = None, marker: str | None = None, verify: bool = False) -> tuple[DataFrame | None, list[RelayStatus]]:
    """The events of every readable source (a path, or a ws:// or wss:// address), and each
    source's status.

    A source that fails is reported and left out; the frame is None only if all fail.  The
    schema is given, never inferred, so a malformed line is null instead of an error.  Live
    relays are asked for one author's events and one marker's, if given; what they send is
    kept.  With an author, paths are read here and now, each by itself, and that author's
    events are kept, so that a file that cannot be read to its end is a failed source too;
    without one, only missing paths are found here.  Live events are proven by their ids and
    signatures, with ``verify`` dumped ones as well; what is not proven is left out and told.
    """
    frames, said = [], []
    live = [r for r in relays if r.startswith(("ws://", "wss://"))]
    if live:
        tags = {"z": ",".join(SUBTYPE.values()), **({"y": marker} if marker else {})}
        # Relays are asked once, before anything is proven: their deadlines are for the network.
        got = read_live(spark, live, [author] if author else None, list(SUBTYPE), verify=False, **tags).persist()
        failed = {r["relay"]: r["first"] for r in got.filter("id is null").groupBy("relay").agg(F.min(F.col("tags")[0][1]).alias("first")).collect()}
        real = authentic(got).persist()
        forged = _lost(got, real)
        said += [RelayStatus(r, r not in failed, failed.get(r) or _told(forged.get(r, 0))) for r in live]
        if len(failed) < len(live):
            frames.append(real.select(*EVENT.fieldNames()))
    for relay in [r for r in relays if r not in live]:
        try:
            frame, message = spark.read.schema(RAW if verify else EVENT).format(form).load(relay), ""
            if author:
                frame, message = _kept(frame, author)
            frame = frame.withColumn("relay", F.lit(relay))
            if verify:
                real = authentic(frame).persist()
                message = "; ".join(m for m in (message, _told(_lost(frame, real).get(relay, 0))) if m)
                frame = real
            frames.append(frame.select(*EVENT.fieldNames()))
            said.append(RelayStatus(relay, True, message))
        except (PySparkException, Py4JJavaError) as e:
            java = getattr(e, "java_exception", None)
            said.append(RelayStatus(relay, False, (str(java) if java is not None else str(e)).splitlines()[0]))
        except ValueError as e:
            said.append(RelayStatus(relay, False, str(e)))
    if not frames:
        return None, said
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.filter("id is not null"), said


def _lost(before: DataFrame, after: DataFrame) -> dict[str, int]:
    """By source, how many events ``after`` lacks."""
    rows = before.select("relay", "id", F.lit(1).alias("n")).unionByName(after.select("relay", "id", F.lit(-1).alias("n"))).filter("id is not null")
    return {r["relay"]: r["n"] for r in rows.groupBy("relay").agg(F.sum("n").alias("n")).collect()}


def _told(forged: int) -> str:
    return f"{forged} events without a valid id and signature are left out" if forged else ""


def _kept(frame: DataFrame, author: str) -> tuple[DataFrame, str]:
    """One author's events, read to the end in one scan, and what to say of malformed lines."""
    seen = Observation()
    mine = frame.observe(seen, F.count(F.lit(1)).alias("lines"), F.count("id").alias("events")).filter(F.col("pubkey") == author).persist()
    try:
        mine.count()
    except Exception:
        mine.unpersist()
        raise
    lines, events = seen.get["lines"], seen.get["events"]
    if lines and not events:
        mine.unpersist()
        raise ValueError(f"none of {lines} lines is an event")
    return mine, f"{lines - events} of {lines} lines are malformed" if lines > events else ""


def typed(events: DataFrame) -> DataFrame:
    """Events with their tags as flat columns, strictly parsed.

    ``inline`` of one struct gives the row itself; what it differs in from a plain select is that
    filters on z, y or d stay above it.  Else each of them is copied below, together with all that
    makes the tags, and an event's tags are made and searched once more for every filter.  Filters
    on the other columns still reach the scan.
    """
    parsed = F.struct(
        *[tag("tags", c).alias(c) for c in ("z", "y", "d", "s", "f", "bond_enabled")],
        parse_amount(tag("tags", "amt")).alias("amt"),
        parse_premium(tag("tags", "premium")).alias("premium"),
        tag_values("tags", "pm").alias("pm"),
    )
    flat = events.select("id", "pubkey", F.col("kind").cast("int").alias("kind"), F.col("created_at").cast("bigint").alias("created_at"), "relay", F.inline(F.array(parsed)))
    return flat.select(*TYPED.fieldNames())


def write_typed(events: DataFrame, path: str) -> None:
    """Typed events on disk, partitioned by kind, so that scans of one kind read only it."""
    typed(events).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TYPED).parquet(path).select(*TYPED.fieldNames())

