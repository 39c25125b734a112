"""Reports that follow a stream of events (optional; the batch report stays the reference).

The stream keeps each order's latest state; rolling figures move with the clock, not with
events, so they are computed from the states at each batch, never kept in streaming state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators import state
from ledgerlens.schema import EVENT, ORDER, SUBTYPE
from ledgerlens.sources.events import typed
from ledgerlens.sources.relay import stream_live


def event_stream(spark: SparkSession, path: str, form: str = "json", marker: str = "", delay: str | None = None) -> DataFrame:
    """Typed events in scope.  With ``delay``, one row an id among events that come within it of
    each other, for whatever counts events; latest states need none, so without ``delay`` no
    state is kept for ids, which would grow for ever."""
    events = state.in_scope(typed(spark.readStream.schema(EVENT).format(form).load(path)), marker)
    if delay is None:
        return events
    return events.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"]).drop("at")


def relay_events(spark: SparkSession, relays: list[str], authors: list[str] | None = None, marker: str = "") -> DataFrame:
    """Typed events in scope of live relays, as they come; ids and signatures are proven."""
    live = stream_live(spark, relays, authors, list(SUBTYPE), z=",".join(SUBTYPE.values()), y=marker)
    return state.in_scope(typed(live), marker)


NEWEST = ("id", "created_at", "s", "amt", "f", "pm", "premium")


def latest_orders_stream(events: DataFrame) -> DataFrame:
    """The latest state of each order so far (update mode); late and repeated arrivals change
    nothing.  The state is one row an order."""
    orders = events.filter((F.col("kind") == ORDER) & F.col("d").isNotNull())
    newest = F.max_by(F.struct(*NEWEST), F.struct("created_at", "id"))
    return orders.groupBy("pubkey", "d").agg(newest.alias("o")).select("pubkey", "d", "o.*")


def into(path: str) -> Callable[[DataFrame, int], None]:
    """For ``follow``: each batch's changed states as files of their own below ``path``, so that
    nothing passes the driver and a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def states(spark: SparkSession, path: str) -> DataFrame:
    """The states that ``into`` has written so far: of each order the latest."""
    return state.latest(spark.read.parquet(path), "pubkey", "d").drop("batch")


def follow(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Run a state stream over what there is, giving ``each(batch, number)`` what changed."""
    writer = rows.writeStream.outputMode("update").trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).start()
