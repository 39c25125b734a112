"""Worked cases of every rule, on tiny frames."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars
from ledgerlens.functions.median import exact_medians
from ledgerlens.operators import grid, metrics, state
from ledgerlens.plans import report
from ledgerlens.schema import DAY, EVENT
from ledgerlens.sources.events import typed

AS_OF = 1_700_000_000
NODE, M = "aa" * 32, "demo"


def event(id_, kind, at, *tags, pubkey=NODE, y=(M,), z=None, relay="r1"):
    z = z or {8383: "dev-fee-payment", 38383: "order", 38385: "info", 38386: "dispute"}[kind]
    return (id_, pubkey, kind, at, [["z", z], ["y", *y], *[list(t) for t in tags]], relay)


def order(id_, at=AS_OF, s="success", d=None, amt=None, **more):
    tags = [("d", d or id_)] + ([("s", s)] if s is not None else []) + ([("amt", amt)] if amt is not None else [])
    return event(id_, 38383, at, *tags, *more.pop("tags", ()), **more)


@pytest.fixture
def events(spark):
    return lambda *rows: state.unique_events(state.in_scope(typed(spark.createDataFrame(list(rows), EVENT)), M))


def trades(df, as_of=AS_OF):
    return state.successes(state.latest_orders(state.not_future(df, as_of)))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_ties_go_to_the_greatest_id(events):
    pair = lambda a, b: events(order("aa", s=a, d="o"), order("ab", s=b, d="o"))
    assert trades(pair("success", "canceled")).count() == 0
    assert trades(pair("canceled", "success")).count() == 1


def test_later_state_wins_and_the_future_does_not_count(events):
    assert trades(events(order("a", 100, d="o"), order("b", 200, "canceled", d="o"))).count() == 0
    assert trades(events(order("a", AS_OF - 10, d="o"), order("b", AS_OF + 1, "canceled", d="o"))).count() == 1


def test_amounts_are_parsed_strictly(events):
    texts = ["5", " 5", "+7", "-1", "5.7", "1e3", "", str(2**64 - 1), str(2**64), None]
    got = one(metrics.cumulative(trades(events(*[order(f"o{i}", amt=t) for i, t in enumerate(texts)]))))
    assert got["total_successful_trades"] == 10 and int(got["total_volume_sats"]) == 18446744073709551627


@pytest.mark.parametrize(
    "amounts, median, mean, sd, cv",
    [([1, 2, 4, 9], 3, 4.0, 3.082207, 1.027402), ([1, 2], 1, 1.5, 0.5, 0.5), ([5], 5, 5.0, 0.0, None), ([0, 0], 0, 0.0, 0.0, None), ([], None, None, None, None)],
)
def test_trade_statistics(events, amounts, median, mean, sd, cv):
    t = trades(events(order("none"), *[order(f"o{i}", amt=str(a)) for i, a in enumerate(amounts)]))
    a, b = one(metrics.trade_stats(t)), one(metrics.size_consistency(t))
    near = lambda x: x if x is None else pytest.approx(x, abs=1e-6)
    assert (a["min_trade_sats"], a["max_trade_sats"]) == ((min(amounts), max(amounts)) if amounts else (None, None))
    assert a["median_trade_sats"] == median and a["mean_trade_sats"] == near(mean)
    assert b["std_dev_trade_sats"] == near(sd) and b["coefficient_of_variation"] == near(cv)


def test_medians_of_many_groups_equal_sorting(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.xxhash64("id") % 100_000).alias("v")).withColumn("v", F.abs("v"))
    rows = [(r.k, r.v) for r in df.collect()]
    want = {}
    for k in range(7):
        v = sorted(x for g, x in rows if g == k)
        want[k] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) // 2
    assert {r.k: r.m for r in exact_medians(df, ["k"], "v", "m").collect()} == want


def test_rolling_windows_include_both_ends(events):
    ages = [0, 7 * DAY, 7 * DAY + 1, 30 * DAY, 90 * DAY, 90 * DAY + 1]
    got = one(metrics.rolling_counts(trades(events(*[order(f"o{i}", AS_OF - a) for i, a in enumerate(ages)])), AS_OF))
    assert (got["trades_last_7d"], got["trades_last_30d"], got["trades_last_90d"]) == (2, 4, 5)


@pytest.mark.parametrize("ages, want", [([], (0, 30)), ([30], (0, 30)), ([0], (1, 29)), ([29], (1, 29)), ([29, 10], (2, 18))])
def test_activity_of_thirty_days(events, ages, want):
    df = events(order("x", s="pending"), *[order(f"o{i}", AS_OF - a * DAY) for i, a in enumerate(ages)])
    got = one(metrics.filled_activity(df.select("pubkey").distinct(), trades(df), AS_OF))
    assert (got["active_days_last_30d"], got["max_consecutive_inactive_days_last_30d"]) == want


def dispute(id_, s, d=None, at=AS_OF):
    return event(id_, 38386, at, ("d", d or id_), *([("s", s)] if s else []))


@pytest.mark.parametrize("n_disputes, n_trades, want", [(3, 150, 2.0), (0, 150, 0.0), (0, 0, None), (2, 0, None)])
def test_dispute_ratio(events, n_disputes, n_trades, want):
    df = events(order("p", s="pending"), *[dispute(f"d{i}", "settled") for i in range(n_disputes)], *[order(f"o{i}") for i in range(n_trades)])
    assert one(metrics.dispute_ratio(df.select("pubkey").distinct(), state.latest_disputes(df), trades(df)))["disputes_per_100_trades"] == want


def test_dispute_outcomes(events):
    df = events(dispute("a", "initiated", "d1", 1), dispute("b", "settled", "d1", 2), dispute("c", "in-progress"), dispute("d", "weird"), dispute("e", None))
    got = one(metrics.disputes_split(state.latest_disputes(df)))
    assert [got[k] for k in ("total_disputes", "resolved_disputes", "active_disputes", "unknown_disputes")] == [4, 1, 1, 2]


def test_currencies_leave_out_empty_ones(events):
    t = trades(events(*[order(f"o{i}", tags=[("f", f)]) for i, f in enumerate(["USD", "USD", "EUR", ""])]))
    assert {r.f: round(r.share, 6) for r in metrics.fiat_shares(t).collect()} == {"USD": 0.666667, "EUR": 0.333333}


def test_payment_methods_are_kept_byte_for_byte(events):
    t = trades(events(*[order(f"o{i}", tags=[("pm", *p)]) for i, p in enumerate([("SEPA", "Bank transfer"), ("SEPA", " Bank transfer"), ("SEPA", "")])]))
    got = {r.method: (r.share, r["rank"]) for r in metrics.payment_shares(t).collect()}
    assert got == {"SEPA": (0.6, 1), " Bank transfer": (0.2, 2), "Bank transfer": (0.2, 3)}


def test_premiums(events):
    made = lambda *p: one(metrics.premium_signal(trades(events(*[order(f"o{i}", tags=[("premium", x)] if x else []) for i, x in enumerate(p)]))))
    got = made("-1", "0", "4", "x", "1.5", None)
    assert got["n_premiums"] == 3 and got["premium_baseline"] == 0.0 and got["premium_dispersion"] == pytest.approx(2.160247, abs=1e-6)
    assert (made("3")["premium_baseline"], made("3")["premium_dispersion"]) == (None, None)


def test_longevity(events):
    fee = event("f", 8383, AS_OF - 10 * DAY)
    got = lambda df: metrics.longevity(state.dev_fees(df), trades(df), AS_OF).collect()
    (r,) = got(events(fee, order("o", AS_OF - 20 * DAY)))
    assert (r.first_seen_at, r.days_active) == (AS_OF - 10 * DAY, 10.0)
    (r,) = got(events(order("a", AS_OF - 5 * DAY), order("b", AS_OF - DAY)))
    assert (r.first_seen_at, r.days_active) == (None, 5.0)
    assert got(events(order("a", s="pending"))) == []


def info(id_, at, bond, d=NODE):
    return event(id_, 38385, at, ("d", d), *([("bond_enabled", bond)] if bond else []))


@pytest.mark.parametrize("rows, want", [([info("a", 100, "true"), info("b", 200, "false")], [False]), ([info("a", 1, "yes")], [None]), ([info("a", 1, "true", "other")], []), ([], [])])
def test_bond_policy(events, rows, want):
    got = metrics.bond_policy(state.latest_info(events(order("o"), *rows))).collect()
    assert [r.bond_enabled for r in got] == want


def test_relative_times(spark):
    d = DAY
    cases = [(-1, "in the future"), (1800, "less than an hour ago"), (3600, "1 hour ago"), (5 * 3600, "5 hours ago"), (d, "1 day ago"), (6 * d, "6 days ago"), (7 * d, "1 week ago"), (14 * d, "2 weeks ago"), (29 * d, "4 weeks ago"), (30 * d, "1 month ago"), (60 * d, "2 months ago"), (364 * d, "12 months ago"), (365 * d, "1 years ago"), (730 * d, "2 years ago")]
    df = spark.createDataFrame([(i, AS_OF - age) for i, (age, _) in enumerate(cases)], "i int, at bigint")
    got = {r.i: r.t for r in df.select("i", scalars.relative_time(F.col("at"), F.lit(AS_OF)).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]


def test_legacy_score_and_labels(spark):
    df = spark.createDataFrame([(728.2, 15_420_000, 156), (None, None, None), (-50.0, 0, 0)], "d double, v bigint, n bigint")
    assert [r.s for r in df.select(scalars.legacy_trust_score(F.col("d"), F.col("v"), F.col("n")).alias("s")).collect()] == [66, 0, 0]
    days = spark.createDataFrame([(0,), (7,), (8,), (30,), (31,), (None,)], "d int")
    assert [r.s for r in days.select(scalars.status_label(F.col("d")).alias("s")).collect()] == ["ACTIVE", "ACTIVE", "LOW ACTIVITY", "LOW ACTIVITY", "INACTIVE", None]


def test_scope(events, spark):
    rows = [order("a", y=("other",)), order("b", y=(M, "x")), order("c", y=()), order("d", pubkey="bb" * 32), order("e", z="info")]
    raw = typed(spark.createDataFrame(rows, EVENT))
    assert sorted(r.id for r in state.in_scope(raw, M).collect()) == ["b", "d"]
    assert [r.id for r in state.in_scope(raw, M, NODE).collect()] == ["b"]


def test_tag_lookup_takes_the_first_match(events, spark):
    raw = spark.createDataFrame([("a", NODE, 38383, 1, [["z", "order"], ["y", M], ["d"], ["d", "o"], ["s", "success"], ["s", "canceled"], [], ["pm"]], "r"), ("b", NODE, 38383, 1, None, "r")], EVENT)
    got = {r.id: r for r in typed(raw).collect()}
    assert got["a"].d is None and got["a"].s == "success" and got["a"].pm == [] and got["b"].z is None


def test_grid_has_empty_buckets(events):
    t = trades(events(order("a", 1_673_000_000, amt="5"), order("b", 1_678_000_000, amt="8")))
    got = grid.activity_grid(state.dev_fees(events(order("x"))), t, 1_680_000_000, "monthly").orderBy("bucket").collect()
    assert [(str(r.bucket), r.trades, int(r.volume_sats), r.median_trade_sats) for r in got] == [("2023-01-01", 1, 5, 5), ("2023-02-01", 0, 0, None), ("2023-03-01", 1, 8, 8)]
    day = lambda *a: grid.activity_grid(t.limit(0), t, 1_680_000_000, "daily", *a).count()
    assert day(date(2023, 1, 1), date(2023, 1, 31)) == 31 and day(date(2023, 2, 1), date(2023, 1, 1)) == 0


def test_ids_count_once_over_relays(events):
    rows = [order("a"), order("a", relay="r2"), order("b", d="a"), dispute("x", "settled"), info("i", 1, "true"), event("f", 8383, 1)]
    got = one(metrics.fetch_summary(events(*rows)))
    assert [got[k] for k in ("dev_fee_events", "order_events", "unique_orders", "unique_disputes", "info_found")] == [1, 2, 1, 1, True]


def test_histogram_and_totals_count_events_without_d(events):
    df = events(order("a", 5, None), order("b", 7, "success"), event("c", 38383, 3, ("s", "success")), event("f", 8383, 1))
    assert {r.status: r.n_events for r in metrics.status_histogram(df).collect()} == {"(missing)": 1, "success": 2}
    got = one(metrics.event_totals(df))
    assert [got[k] for k in ("dev_fee_events", "order_events", "unique_orders", "first_order_at", "last_order_at")] == [1, 3, 2, 3, 7]


def test_report_is_complete_without_data(events):
    df = events(dispute("x", "settled"))
    got = one(report.node_metrics(df, AS_OF))
    assert list(got) == ["pubkey", *report.MEANING] and got["total_disputes"] == 1 and got["disputes_per_100_trades"] is None
    t = trades(df)
    whole = report.nested(report.node_metrics(df, AS_OF), metrics.fetch_summary(df), metrics.fiat_shares(t), metrics.payment_shares(t), grid.activity_grid(state.dev_fees(df), t, AS_OF, "daily"))
    doc = json.loads(report.as_json(whole).first()["json"])
    assert doc["stats"]["trade_statistics"] == {k: None for k in report.SECTIONS["trade_statistics"]} and doc["activity"] == []
    assert doc["recommendations"][0].startswith("No successful trade")


def test_row_order_and_copies_change_nothing(events):
    rows = [order(f"o{i}", AS_OF - i * DAY, amt=str(i * 10), d=f"k{i % 5}") for i in range(12)]
    a, b = (one(report.node_metrics(events(*r), AS_OF)) for r in (rows, [*reversed(rows), *rows]))
    assert a == b


def test_tag_filter_reaches_the_scan(spark, tmp_path):
    from ledgerlens.sources.events import read_typed, write_typed

    write_typed(spark.createDataFrame([order("a"), dispute("x", "settled")], EVENT), f"file://{tmp_path}/silver")
    df = state.in_scope(read_typed(spark, f"file://{tmp_path}/silver"), M, NODE)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(y,demo)" in plan and "PartitionFilters: [kind" in plan and df.count() == 2


def test_facts_give_the_same_latest_states(events):
    df = events(order("a", 1, d="o"), order("b", 2, "canceled", d="o"), order("c", AS_OF + 5, d="o"), event("n", 38383, 3, ("s", "success")), dispute("x", "initiated", "o", 1), dispute("y", "settled", "o", 2), info("i", 1, "true"), info("j", 2, "false"), info("k", 3, "true", "other"), event("f", 8383, 1), event("g", 8383, 2))
    past, facts = state.not_future(df, AS_OF), state.facts(df, AS_OF)
    pairs = ((state.latest_orders, state.order_states), (state.latest_disputes, state.dispute_states), (state.latest_info, state.own_info), (state.dev_fees, state.dev_fees))
    for f, g in pairs:
        assert sorted(r.id for r in f(past).collect()) == sorted(r.id for r in g(facts).collect())
    assert facts.filter("id = 'n'").count() == 1


def test_nested_reports_hold_the_flat_figures(spark, sf_dir):
    from ledgerlens.queries import QUERIES

    flat = {r.pubkey: r.asDict() for r in QUERIES["node_report"](spark, sf_dir).collect()}
    docs = {r.pubkey: json.loads(r.json) for r in QUERIES["report_json"](spark, sf_dir).collect()}
    assert docs.keys() == flat.keys()
    for pubkey, doc in docs.items():
        for group, names in report.SECTIONS.items():
            for n in names:
                a, b = doc["stats"][group][n], flat[pubkey][n]
                assert a == b or float(a) == pytest.approx(float(b), abs=1e-3), (pubkey, n)
        assert doc["stats"]["bond_policy"]["bond_enabled"] == flat[pubkey]["bond_enabled"]
        assert sum(b["trades"] for b in doc["activity"]) == flat[pubkey]["total_successful_trades"]
        assert doc["stats"]["fiat"] == [] or sum(f["share"] for f in doc["stats"]["fiat"]) == pytest.approx(1)
