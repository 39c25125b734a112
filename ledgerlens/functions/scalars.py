"""Scalar functions of the report, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import DAY

# Activity labels with the most days since the last trade that each allows.
INACTIVE, LOW_ACTIVITY, ACTIVE = "INACTIVE", "LOW ACTIVITY", "ACTIVE"
ACTIVE_DAYS, LOW_ACTIVITY_DAYS = 7, 30
# The older score's points and what earns them in full (a year, 1 BTC, 100 trades),
# and the least scores of its colour bands.
AGE_POINTS, VOLUME_POINTS, TRADE_POINTS = 30.0, 40.0, 30.0
FULL_DAYS, FULL_BTC, FULL_TRADES = 365.0, 1.0, 100.0
GREEN, YELLOW = 70, 40
# Satoshis in a bitcoin, and the idle days beyond which a gap is marked.
SATS, LONG_GAP = 1e8, 7


def timestamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def utc_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss 'UTC'")


def utc_day(epoch: Column) -> Column:
    """The UTC calendar day, by whole division, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / DAY).cast("int"))


def whole(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint")


def relative_time(epoch: Column, now: Column) -> Column:
    """Age in words (fixed wording).  Ages of 365 to 729 days read "1 years ago"."""
    age = now - epoch
    days = whole(age, DAY)

    def told(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(age < 0, "in the future")
        .when(age < 3600, "less than an hour ago")
        .when(age < 7200, "1 hour ago")
        .when(days < 1, told(whole(age, 3600), "hours"))
        .when(days == 1, "1 day ago")
        .when(days < 7, told(days, "days"))
        .when(days < 14, "1 week ago")
        .when(days < 30, told(whole(days, 7), "weeks"))
        .when(days < 60, "1 month ago")
        .when(days < 365, told(whole(days, 30), "months"))
        .otherwise(told(whole(days, 365), "years"))
    )


def status_label(days_since_last: Column) -> Column:
    label = F.when(days_since_last > LOW_ACTIVITY_DAYS, INACTIVE).when(days_since_last > ACTIVE_DAYS, LOW_ACTIVITY)
    return label.when(days_since_last.isNotNull(), ACTIVE)


def to_btc(sats: Column) -> Column:
    return sats.cast("double") / SATS


def legacy_trust_score(days: Column, sats: Column, trades: Column) -> Column:
    """0..100: points for age, volume and trades, each in full from a limit on; null counts as 0."""
    parts = (
        (days.cast("double") / FULL_DAYS, AGE_POINTS),
        (to_btc(sats) / FULL_BTC, VOLUME_POINTS),
        (trades.cast("double") / FULL_TRADES, TRADE_POINTS),
    )
    points = [F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)) * most for share, most in parts]
    return F.greatest((points[0] + points[1] + points[2]).cast("bigint"), F.lit(0).cast("bigint"))


def score_band(score: Column) -> Column:
    return F.when(score >= GREEN, "green").when(score >= YELLOW, "yellow").otherwise("red")


def gap_warning(days: Column) -> Column:
    return F.when(days > LONG_GAP, F.format_string("no trade for %d days in a row", days))


def bucket(epoch: Column, view: str) -> Column:
    """First day of the UTC day, month or year that holds an instant."""
    unit = {"daily": "day", "monthly": "month", "yearly": "year"}[view]
    return F.trunc(utc_day(epoch), unit) if unit != "day" else utc_day(epoch)


def json_text(c: Column) -> Column:
    """A value that is neither a struct nor a list, as JSON."""
    made = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(made, F.lit(6), F.length(made) - 6)


def json_number(c: Column) -> Column:
    """A double as JSON, in plain digits from 1e-6 to 1e21, as DuckDB (and JavaScript) write it;
    ``to_json`` has exponents below 1e-3 and from 1e7 on."""
    plain = lambda places: F.regexp_replace(c.cast(f"decimal(38,{places})").cast("string"), r"(\.\d+?)0*$", "$1")
    size = F.abs(c)
    short = (size >= 1e-3) & (size < 1e7) | (c == 0)
    exponent = F.regexp_replace(F.regexp_replace(json_text(c), r"\.0E", "E"), r"E(-?\d+)$", "e$1")
    return F.when(short, c.cast("string")).when((size >= 1e-6) & (size < 1e15), plain(22)).when((size >= 1e15) & (size < 1e21), plain(1)).otherwise(exponent)
