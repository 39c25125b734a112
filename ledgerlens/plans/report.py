"""The whole report of every node, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StructType

from ledgerlens.functions.median import exact_medians
from ledgerlens.functions.scalars import gap_warning, json_number, json_text, legacy_trust_score, relative_time, score_band, status_label, to_btc
from ledgerlens.operators import metrics, state
from ledgerlens.schema import DEV_FEE
from ledgerlens.sources.storage import settle

SCHEMA_VERSION = 1
#: Labels of a kind that one abridged document lists.
LABELS = 1000

#: Metric -> (label, meaning, direction), shown beside each value.
MEANING = {
    "first_seen_at": ("First seen", "time of the oldest dev-fee payment", "older is better"),
    "days_active": ("Days active", "days since first seen, or since the first trade", "more is better"),
    "total_successful_trades": ("Successful trades", "orders whose latest state is success", "more is better"),
    "total_volume_sats": ("Total volume (sats)", "sum of the amounts of successful trades", "more is better"),
    "last_successful_trade_at": ("Last trade", "time of the latest successful trade", "more recent is better"),
    "days_since_last_trade": ("Days since last trade", "whole days since that trade", "fewer is better"),
    "trades_last_7d": ("Trades, 7 days", "successful trades of the last 7 times 24 hours", "more is better"),
    "trades_last_30d": ("Trades, 30 days", "successful trades of the last 30 times 24 hours", "more is better"),
    "trades_last_90d": ("Trades, 90 days", "successful trades of the last 90 times 24 hours", "more is better"),
    "active_days_last_30d": ("Active days of 30", "UTC days with a trade among the last 30", "more is better"),
    "max_consecutive_inactive_days_last_30d": ("Longest idle run", "most UTC days in a row without a trade among the last 30", "fewer is better"),
    "min_trade_sats": ("Smallest trade (sats)", "least amount of a successful trade", "neutral"),
    "max_trade_sats": ("Largest trade (sats)", "greatest amount of a successful trade", "neutral"),
    "mean_trade_sats": ("Mean trade (sats)", "volume over trades with an amount", "neutral"),
    "median_trade_sats": ("Median trade (sats)", "middle amount, the typical size", "neutral"),
    "std_dev_trade_sats": ("Deviation (sats)", "population standard deviation of amounts", "neutral"),
    "coefficient_of_variation": ("Variation", "deviation over the median, from two amounts on", "lower is steadier"),
    "disputes_per_100_trades": ("Disputes per 100 trades", "100 times disputes over successful trades", "lower is better"),
    "total_disputes": ("Disputes", "distinct disputes", "fewer is better"),
    "resolved_disputes": ("Disputes resolved", "settled, refunded or released", "informative"),
    "active_disputes": ("Disputes active", "initiated or in progress", "informative"),
    "unknown_disputes": ("Disputes of other status", "all other statuses", "informative"),
    "premium_baseline": ("Premium baseline (%)", "median premium over market price, from two on", "neutral"),
    "premium_dispersion": ("Premium dispersion (points)", "population standard deviation of premiums", "lower is steadier"),
    "bond_enabled": ("Bond required", "the node's own setting; unknown where it does not say", "informative"),
}
COUNTS = ("total_successful_trades", "total_volume_sats", "trades_last_7d", "trades_last_30d", "trades_last_90d", "active_days_last_30d", "total_disputes", "resolved_disputes", "active_disputes", "unknown_disputes")


def latest_states(events: DataFrame, as_of: int, every_fee: bool = False) -> DataFrame:
    """The latest states of typed events in scope, written once and then read by columns, so
    that an event is scanned and shuffled once, however many groups of metrics follow.

    Of dev-fees a report reads the time of a node's first alone, which one partial aggregate finds;
    so they are one row a node here or, with ``every_fee`` (to count them), one short row an id.
    """
    past = state.not_future(events, as_of)
    by = ["pubkey", "kind", "id"] if every_fee else ["pubkey", "kind"]
    fees = state.dev_fees(past).groupBy(*by).agg(F.min("created_at").alias("created_at"))
    rest = state.facts(past.filter(F.col("kind") != DEV_FEE), as_of)
    return settle(rest.unionByName(fees, allowMissingColumns=True), "latest-states")


def node_metrics(events: DataFrame, as_of: int) -> DataFrame:
    """One row per node with every metric.  ``events`` are typed and in scope."""
    return metrics_of(latest_states(events, as_of), as_of)


def metrics_of(events: DataFrame, as_of: int) -> DataFrame:
    """One row per node with every metric, of its ``latest_states``.

    Each group of metrics is reduced to one row a node before groups meet, so the joins below
    are over nodes and keep nodes that lack a group.
    """
    trades = state.successes(state.order_states(events))
    disputes = metrics.disputes_split(state.dispute_states(events))
    nodes = events.select("pubkey").distinct()
    out = nodes.join(metrics.longevity(state.dev_fees(events), trades, as_of), "pubkey", "left")
    out = out.join(metrics.trade_summary(trades, as_of), "pubkey", "left")
    out = out.join(exact_medians(trades, ["pubkey"], "amt", "median_trade_sats"), "pubkey", "left")
    out = out.join(metrics.premium_medians(trades, "premium_middle"), "pubkey", "left")
    out = out.join(disputes, "pubkey", "left")
    out = out.join(metrics.bond_policy(state.own_info(events)), "pubkey", "left")
    out = metrics.with_variation(out)
    enough = F.col("n_premiums") >= 2
    out = out.withColumns({
        "premium_baseline": F.when(enough, F.col("premium_middle")),
        "premium_dispersion": F.when(enough, F.col("premium_spread")),
        "disputes_per_100_trades": metrics.ratio_100("total_disputes", "total_successful_trades"),
        "max_consecutive_inactive_days_last_30d": F.coalesce("max_consecutive_inactive_days_last_30d", F.lit(metrics.WINDOW_DAYS)),
        **{c: F.coalesce(c, F.lit(0)) for c in COUNTS},
    })
    return out.select("pubkey", *MEANING)


LEGACY = ("legacy_trust_score", "score_band", "legacy_status", "last_trade_age", "volume_btc")


def legacy_columns(report: DataFrame, as_of: int) -> DataFrame:
    """The report with the older score, activity label and age in words."""
    score = legacy_trust_score(F.col("days_active"), F.col("total_volume_sats"), F.col("total_successful_trades"))
    return report.withColumns({
        "legacy_trust_score": score,
        "score_band": score_band(score),
        "legacy_status": status_label(F.col("days_since_last_trade")),
        "last_trade_age": relative_time(F.col("last_successful_trade_at"), F.lit(as_of)),
        "volume_btc": to_btc(F.col("total_volume_sats")),
    })


def recommendations() -> Column:
    """Plain statements from a node's own numbers; never a comparison with other nodes."""
    trades = F.col("total_successful_trades")
    notes = F.array(
        F.when(trades == 0, F.lit("No successful trade is recorded: nothing here tells how this node completes trades.")),
        F.when((trades > 0) & (F.col("days_since_last_trade") > 30), F.format_string("The last successful trade was %d days ago; check that the node still answers.", F.col("days_since_last_trade"))),
        F.when(F.col("active_disputes") > 0, F.format_string("%d dispute(s) still open, of %d in all.", F.col("active_disputes"), F.col("total_disputes"))),
        F.when((trades > 0) & (F.col("total_disputes") > 0), F.format_string("%d dispute(s) against %d successful trade(s).", F.col("total_disputes"), trades)),
        F.when((trades > 0) & (trades < 10), F.format_string("Only %d successful trade(s): the figures rest on a small sample.", trades)),
        F.when(trades > 0, gap_warning(F.col("max_consecutive_inactive_days_last_30d"))),
        F.when(F.col("coefficient_of_variation") > 1, F.lit("Trade sizes vary by more than the node's own median trade.")),
    )
    found = F.array_compact(notes)
    return F.when(F.size(found) == 0, F.array(F.lit("Nothing notable to flag."))).otherwise(found)


SECTIONS = {
    "longevity": ("first_seen_at", "days_active"),
    "cumulative": ("total_successful_trades", "total_volume_sats"),
    "liveness": ("last_successful_trade_at", "days_since_last_trade", "trades_last_7d", "trades_last_30d", "trades_last_90d"),
    "consistency": ("active_days_last_30d", "max_consecutive_inactive_days_last_30d"),
    "trade_statistics": ("min_trade_sats", "max_trade_sats", "mean_trade_sats", "median_trade_sats"),
    "size_consistency": ("std_dev_trade_sats", "coefficient_of_variation"),
    "disputes": ("disputes_per_100_trades", "total_disputes", "resolved_disputes", "active_disputes", "unknown_disputes"),
    "premium": ("premium_baseline", "premium_dispersion"),
}


def whole(report: DataFrame, fetch: DataFrame, fiat: DataFrame, methods: DataFrame, grid: DataFrame) -> DataFrame:
    """The report as one nested row a node: fetch, activity, stats, recommendations.

    Lists are whole: every label of ``fiat`` (by label) and of ``methods`` (by rank), every bucket
    of ``grid``.  So a node's row, and the task that makes it, are as large as its lists.
    """
    def listed(rows: DataFrame, name: str, *cols: str) -> DataFrame:
        return rows.groupBy("pubkey").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    fetched = fetch.select("pubkey", F.struct(*[c for c in fetch.columns if c != "pubkey"]).alias("fetch"))
    stats = F.struct(*[F.struct(*cols).alias(name) for name, cols in SECTIONS.items()], F.struct("bond_enabled").alias("bond_policy"), F.coalesce("fiat", F.array()).alias("fiat"), F.coalesce("payment_methods", F.array()).alias("payment_methods"))
    out = report.join(fetched, "pubkey", "left")
    out = out.join(listed(fiat, "fiat", "f", "mentions", "share"), "pubkey", "left")
    out = out.join(listed(methods, "payment_methods", "rank", "method", "mentions", "share"), "pubkey", "left")
    out = out.join(listed(grid, "activity", "bucket", "trades", "volume_sats", "median_trade_sats"), "pubkey", "left")
    return out.select("pubkey", F.lit(SCHEMA_VERSION).alias("schema_version"), "fetch", F.coalesce("activity", F.array()).alias("activity"), stats.alias("stats"), recommendations().alias("recommendations"))


def nested(report: DataFrame, fetch: DataFrame, fiat: DataFrame, methods: DataFrame, grid: DataFrame) -> DataFrame:
    """``whole``, abridged to the ``LABELS`` labels of a kind with most mentions.  No query and no
    command makes abridged documents."""
    if "rank" not in fiat.columns:
        fiat = metrics.ranked(fiat, "pubkey", F.col("mentions").desc(), F.col("f"))
    return whole(report, fetch, fiat.filter(F.col("rank") <= LABELS), methods.filter(F.col("rank") <= LABELS), grid)


def _json(c: Column, kind: DataType) -> Column:
    """A column as JSON text, null where it is null."""
    if isinstance(kind, StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), F.coalesce(_json(c[f.name], f.dataType), F.lit("null"))) for f in kind]
        made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        texts = F.transform(c, lambda x: F.coalesce(_json(x, kind.elementType), F.lit("null")))
        made = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    elif isinstance(kind, DoubleType):
        made = json_number(c)
    elif isinstance(kind, (IntegerType, LongType)):
        made = c.cast("string")
    else:
        made = json_text(c)
    return F.when(c.isNotNull(), made)


def as_json(report: DataFrame) -> DataFrame:
    """Complete JSON documents: every key always there, null where a number is not known.

    Text is put together here, not by ``to_json``, which writes small and large numbers otherwise.
    """
    return report.select("pubkey", _json(F.struct(*report.columns), report.schema).alias("json"))
