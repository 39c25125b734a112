"""What shows only on larger tables."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import duckdb
import pytest

from ledgerlens import cli
from ledgerlens.operators import metrics, state
from ledgerlens.plans import params, report
from ledgerlens.queries import QUERIES, SQL, scoped
from ledgerlens.sources import adapters as A
from ledgerlens.streaming import kept
from tests.compare import duck_rows, spark_rows
from tests.test_goldens import AS_OF, event, order
from tests.test_incremental import NODES, as_rows, frame, some_events


def busy_tables(spark, path):
    """Node 1 trades on each of the last 30 days, node 2 on one of them."""
    today = datetime(2000, 7, 1)
    orders = [(i, 1, "F", 1000.5 + i, today - timedelta(days=i), "1-URGENT") for i in range(30)] + [(40, 2, "F", 10.0, today, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING"), (2, "MACHINERY")], "c_custkey bigint, c_mktsegment string").coalesce(1).write.parquet(f"{path}/customer.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["report_labels", "active_days_30d", "max_inactive_gap_30d"])
def test_a_node_without_an_idle_day(spark, tmp_path, name):
    path = busy_tables(spark, tmp_path)
    assert spark_rows(QUERIES[name](spark, path)) == duck_rows(SQL[name], path)


def test_a_large_bucket_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "TASK_ROWS", 10, raising=False)
    path, rows = str(tmp_path / "table"), some_events(random.Random(5), 200)
    for part in (rows[::2], rows[1::2]):
        kept.merge(path, frame(spark, part), AS_OF, buckets=2)
    assert as_rows(kept.kept(spark, path)) == as_rows(state.facts(frame(spark, rows), AS_OF))
    parts = [len(list(d.glob("*.parquet"))) for d in Path(path, "states").glob("bucket=[01]")]
    assert len(parts) == 2 and min(parts) > 1


def test_tags_are_made_once_whatever_filters_follow(spark, sf_dir):
    plan = state.latest_orders(scoped(A.order_events(spark, sf_dir)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[z,order]") == 1


def test_reports_keep_a_node_s_first_dev_fee(spark):
    rows = [event(f"f{i}", 8383, AS_OF - i % 7, pubkey=node) for i, node in enumerate(NODES * 10)] + [event("late", 8383, AS_OF + 5)]
    fees = [sorted((r.pubkey, r.created_at) for r in state.dev_fees(report.latest_states(frame(spark, rows * 2), AS_OF, every)).collect()) for every in (False, True)]
    assert fees[0] == [(n, min(r[3] for r in rows if r[1] == n)) for n in sorted(NODES)] and len(fees[1]) == 30


def test_what_was_fetched_by_latest_states(spark):
    rows = [*some_events(random.Random(6), 150), event("nd", 38383, 3, ("s", "success")), event("nx", 38386, 3), event("no", 38385, 3, pubkey=NODES[1])]
    past = state.not_future(frame(spark, rows * 2), AS_OF)
    want = {r.pubkey: r.asDict() for r in metrics.fetch_summary(past).collect()}
    assert {r.pubkey: r.asDict() for r in metrics.fetch_of_facts(report.latest_states(past, AS_OF, True), past).collect()} == want


def test_documents_list_every_label_as_their_sql_does(spark, sf_dir, tmp_path):
    """Node 1 has 1,500 currencies, 3,001 payment methods and ties among both; node 2 has few."""
    day = datetime(2000, 6, 1)
    orders = [(i, 1 + 50 * i, "F", 1000.5 + i, day - timedelta(days=i % 40), f"p{i}-q{i}-both") for i in range(1500)] + [(2000, 2, "F", 10.0, day, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(o[1], f"cur{o[0]}", float(o[0])) for o in orders]
    spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("lineitem", "supplier"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    rows = QUERIES["report_json"](spark, str(tmp_path))
    stats = {int(r.pubkey): json.loads(r.json)["stats"] for r in rows.collect()}
    assert [x["rank"] for x in stats[1]["payment_methods"]] == [*range(1, 3002)] and stats[1]["payment_methods"][0]["method"] == "both"
    assert [x["f"] for x in stats[1]["fiat"]] == sorted(f"cur{i}" for i in range(1500)) and len(stats[2]["fiat"]) == 1
    assert spark_rows(rows) == duck_rows(SQL["report_json"], str(tmp_path))


def test_the_command_s_report_lists_every_label(spark):
    rows = [order(f"o{i}", AS_OF - i, amt="5", tags=[("f", f"c{i}"), ("pm", f"m{i}")]) for i in range(1100)]
    made, _ = cli.node_report(frame(spark, rows), AS_OF, params.Range(None, None, "yearly"), date(2024, 1, 1))
    assert len(made["stats"]["fiat"]) == len(made["stats"]["payment_methods"]) == 1100
    assert sum(x["share"] for x in made["stats"]["payment_methods"]) == pytest.approx(1)


def test_documents_write_numbers_as_their_sql_does(spark):
    values = [0.0, 1.0, -0.5, 0.1, 1 / 3, 1e-3, 6.66667e-4, 5e-4, -2.5e-5, 1e-6, 9.99e-7, 1e-9, 1e7, 12345678.25, -1e10, 2.1e15, 1e16, 1.2345678901234567e19, 1e20, 1e21, 1.5e22, None]
    rows = spark.createDataFrame([(str(i), v, [v], f'a"b\\{i}/\n') for i, v in enumerate(values)], "pubkey string, x double, xs array<double>, t string")
    got = {int(r.pubkey): r.json for r in report.as_json(rows).collect()}
    with duckdb.connect() as c:
        want = [c.execute("SELECT CAST(to_json({'pubkey': ?::VARCHAR, 'x': ?::DOUBLE, 'xs': [?::DOUBLE], 't': ?::VARCHAR}) AS VARCHAR)", [str(i), v, v, f'a"b\\{i}/\n']).fetchall()[0][0] for i, v in enumerate(values)]
    assert [got[i] for i in range(len(values))] == want and [json.loads(x)["x"] for x in want] == values
