"""Figures of every node at many instants at once, from one scan of the events.

An order's or dispute's state holds from its event to the next one's.  Of the states between two
instants only the last can be seen, so events are reduced to one a key and step first (a partial
aggregate, whatever a key's number of events).  What is left is an interval of instants, which is
one change at its begin and one, of the other sign, at its end; changes are summed by node and
instant and then along the instants.  A rolling window ends an interval earlier, no more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import metrics, state
from ledgerlens.schema import ACTIVE, DAY, DISPUTE, ORDER, RESOLVED, SUCCESS

ROLLING = (7, 30, 90)
MEASURES = ("total_successful_trades", "total_volume_sats", *[f"trades_last_{n}d" for n in ROLLING], "total_disputes", "resolved_disputes", "active_disputes")


@dataclass(frozen=True)
class Schedule:
    """The instants first, first + step, ... , ``count`` of them, in epoch seconds."""

    first: int
    step: int
    count: int

    @property
    def last(self) -> int:
        return self.first + self.step * (self.count - 1)

    def reached(self, at: Column) -> Column:
        """The number of the first instant that is not before ``at``."""
        return F.greatest(F.expr("0L"), _whole(at - self.first + self.step - 1, self.step))

    def beyond(self, at: Column) -> Column:
        """The number of the first instant after ``at``."""
        return F.greatest(F.expr("0L"), _whole(at - self.first, self.step) + 1)


def _whole(a: Column, b: int) -> Column:
    return F.floor((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def history(events: DataFrame, schedule: Schedule) -> DataFrame:
    """pubkey, as_of and ``MEASURES`` for each instant from a node's first event on, with the
    disputes of other statuses and the ratio to trades.  ``events`` are typed and in scope."""
    # Other events show that the node is there, no more; so they have no key, and one a step is left.
    key = F.when(F.col("kind").isin(ORDER, DISPUTE), state.fact_key())
    rows = state.not_future(events, schedule.last).withColumn("key", key).withColumn("slot", schedule.reached(F.col("created_at")))
    newest = F.max_by(F.struct("created_at", "s", "amt", "d"), F.struct("created_at", "id"))
    rows = rows.groupBy("pubkey", "kind", "key", "slot").agg(newest.alias("e")).select("pubkey", "kind", "slot", "key", "e.*")
    by = Window.partitionBy("pubkey", "kind", "key").orderBy("slot")
    rows = rows.withColumn("end", F.coalesce(F.lead("slot").over(by), F.lit(schedule.count))).withColumn("is_first", F.lag("slot").over(by).isNull())

    trade = (F.col("kind") == ORDER) & F.col("d").isNotNull() & F.coalesce(F.col("s") == SUCCESS, F.lit(False))
    dispute = (F.col("kind") == DISPUTE) & F.col("d").isNotNull()
    amount = F.coalesce(F.col("amt"), F.lit(0)).cast("decimal(38,0)")

    def change(at: Column, when: Column, **measures: Column | int) -> Column:
        values = [(measures[m] if isinstance(measures.get(m), Column) else F.lit(measures.get(m, 0))).cast("decimal(38,0)").alias(m) for m in MEASURES]
        return F.when(when, F.struct(at.alias("slot"), *values))

    def rolled(n: int) -> Column:
        return F.least(F.col("end"), schedule.beyond(F.col("created_at") + n * DAY))

    one = {f"trades_last_{n}d": F.when(rolled(n) > F.col("slot"), 1).otherwise(0) for n in ROLLING}
    resolved, active = (dispute & F.coalesce(F.col("s").isin(*x), F.lit(False)) for x in (RESOLVED, ACTIVE))
    changes = [
        change(F.col("slot"), F.lit(True)),  # the node is there
        change(F.col("slot"), trade, total_successful_trades=1, total_volume_sats=amount, **one),
        change(F.col("end"), trade, total_successful_trades=-1, total_volume_sats=-amount),
        *[change(rolled(n), trade & (rolled(n) > F.col("slot")), **{f"trades_last_{n}d": -1}) for n in ROLLING],
        change(F.col("slot"), dispute & F.col("is_first"), total_disputes=1),
        *[change(at, test, **{name: by_}) for name, test in (("resolved_disputes", resolved), ("active_disputes", active)) for at, by_ in ((F.col("slot"), 1), (F.col("end"), -1))],
    ]
    sums = rows.select("pubkey", F.inline(F.array_compact(F.array(*changes)))).filter(F.col("slot") < schedule.count)
    sums = sums.groupBy("pubkey", "slot").agg(*[F.sum(m).alias(m) for m in MEASURES])
    # One row a node and instant with a change: bounded by the schedule.
    along = Window.partitionBy("pubkey").orderBy("slot")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    out = sums.select("pubkey", "slot", (F.coalesce(F.lead("slot").over(along), F.lit(schedule.count)) - 1).alias("to"), *[F.sum(m).over(upto).alias(m) for m in MEASURES])
    out = out.select("pubkey", F.explode(F.sequence("slot", "to")).alias("slot"), *MEASURES)
    volume = F.col("total_volume_sats")
    counts = [F.col(m).cast("bigint").alias(m) if m != "total_volume_sats" else volume for m in MEASURES]
    out = out.select("pubkey", (F.lit(schedule.first) + F.col("slot") * schedule.step).alias("as_of"), *counts)
    rest = F.col("total_disputes") - F.col("resolved_disputes") - F.col("active_disputes")
    return out.withColumns({"unknown_disputes": rest, "disputes_per_100_trades": metrics.ratio_100("total_disputes", "total_successful_trades")})
