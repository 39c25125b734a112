"""From published events to the facts that count: scope, clock, ids, latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.schema import DEV_FEE, DISPUTE, INFO, ORDER, SUBTYPE, SUCCESS


def in_scope(events: DataFrame, marker: str, pubkey: str | None = None) -> DataFrame:
    """Events whose z tag fits their kind and whose first y value is the protocol's marker;
    of one author, if given.  All tests are on flat columns, so they reach the scan."""
    fits = F.lit(False)
    for kind, z in SUBTYPE.items():
        fits = fits | ((F.col("kind") == kind) & (F.col("z") == z))
    out = events.filter(F.col("kind").isin(*SUBTYPE)).filter(fits & (F.col("y") == marker))
    return out.filter(F.col("pubkey") == pubkey) if pubkey else out


def classified(events: DataFrame, marker: str) -> DataFrame:
    """Events by tags alone, whatever their kind: "dev-fee" or "order"; others go."""
    group = F.when((F.col("z") == SUBTYPE[DEV_FEE]) & (F.col("y") == marker), "dev-fee").when(F.col("z") == SUBTYPE[ORDER], "order")
    return events.withColumn("event_type", group).filter("event_type is not null")


def not_future(events: DataFrame, as_of: int | Column) -> DataFrame:
    """Events up to the report's instant; this comes before any choice of a latest state."""
    return events.filter(F.col("created_at") <= as_of)


def unique_events(events: DataFrame) -> DataFrame:
    """One row an event id, however many relays delivered it."""
    return events.dropDuplicates(["id"])


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last state of each key: greatest created_at, then greatest id.

    row_number = 1 plans a top-1 before the shuffle as well, and its sort can spill.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return events.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def order_states(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("kind") == ORDER) & F.col("d").isNotNull())


def dispute_states(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("kind") == DISPUTE) & F.col("d").isNotNull())


def own_info(rows: DataFrame) -> DataFrame:
    """Info events of nodes about themselves."""
    return rows.filter((F.col("kind") == INFO) & (F.col("d") == F.col("pubkey")))


def latest_orders(events: DataFrame) -> DataFrame:
    return latest(order_states(events), "pubkey", "d")


def latest_disputes(events: DataFrame) -> DataFrame:
    return latest(dispute_states(events), "pubkey", "d")


def latest_info(events: DataFrame) -> DataFrame:
    return latest(own_info(events), "pubkey")


def fact_key() -> Column:
    """What tells an event's states apart from others of its node and kind: an order's, dispute's
    or info event's d (without one it stands alone), a dev-fee's id."""
    return F.when(F.col("kind") == DEV_FEE, F.col("id")).otherwise(F.coalesce("d", F.concat(F.lit("id:"), "id")))


def facts(events: DataFrame, as_of: int | Column) -> DataFrame:
    """The latest state of every key of every kind, by one scan and one shuffle.

    Orders and disputes are keyed by d, info events by d as well, dev-fees by their id; an
    order or dispute without d stands alone (it shows that the node exists, no more).  Events
    need not be distinct: of several with one id, one is the latest.  ``order_states``,
    ``dispute_states``, ``own_info`` and ``dev_fees`` of this table are what the ``latest_``
    functions give on distinct events, without another window.
    """
    return latest(not_future(events, as_of).withColumn("__key", fact_key()), "pubkey", "kind", "__key").drop("__key", "relay", "z", "y")


def dev_fees(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == DEV_FEE)


def successes(orders: DataFrame) -> DataFrame:
    """Orders whose latest state is a success."""
    return orders.filter(F.col("s") == SUCCESS)
