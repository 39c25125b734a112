"""The activity grid: gap-free buckets per node."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.median import exact_medians
from ledgerlens.functions.scalars import bucket, utc_day

STEP = {"daily": "interval 1 day", "monthly": "interval 1 month", "yearly": "interval 1 year"}


def activity_grid(fees: DataFrame, trades: DataFrame, as_of: int, view: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """pubkey, bucket (its first day), trades, volume and median, chronologically.

    Without ``since``, a node's grid begins at its earliest history (first dev-fee or trade);
    without ``until``, it ends in the bucket that holds ``as_of``.  Range ends snap to their
    bucket; an empty range stays empty.
    """
    first = fees.select("pubkey", "created_at").unionByName(trades.select("pubkey", "created_at")).groupBy("pubkey").agg(F.min("created_at").alias("first"))
    unit = {"daily": "day", "monthly": "month", "yearly": "year"}[view]
    snap = (lambda c: c) if unit == "day" else (lambda c: F.trunc(c, unit))
    begin = F.lit(since) if since else utc_day(F.col("first"))
    end = F.lit(until) if until else utc_day(F.lit(as_of))
    spine = first.withColumn("b", begin).withColumn("e", end).filter("b <= e")
    # The later of both ends guards sequence(), which may be folded before the filter runs.
    last = F.greatest(snap(F.col("b")), snap(F.col("e")))
    spine = spine.select("pubkey", F.explode(F.sequence(snap(F.col("b")), last, F.expr(STEP[view]))).alias("bucket"))
    inside = trades.withColumn("day", utc_day(F.col("created_at")))
    if since:
        inside = inside.filter(F.col("day") >= snap(F.lit(since)))
    if until:
        inside = inside.filter(snap(F.col("day")) <= snap(F.lit(until)))
    inside = inside.withColumn("bucket", bucket(F.col("created_at"), view))
    sums = inside.groupBy("pubkey", "bucket").agg(F.count("*").alias("trades"), F.coalesce(F.sum("amt"), F.lit(0)).alias("volume_sats"))
    medians = exact_medians(inside, ["pubkey", "bucket"], "amt", "median_trade_sats")
    out = spine.join(sums, ["pubkey", "bucket"], "left").join(medians, ["pubkey", "bucket"], "left")
    return out.select("pubkey", "bucket", F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("volume_sats", F.lit(0)).alias("volume_sats"), "median_trade_sats")
