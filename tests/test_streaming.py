from __future__ import annotations

import json

from ledgerlens.operators import state
from ledgerlens.schema import EVENT
from ledgerlens.sources.events import typed
from ledgerlens.streaming.live import event_stream, follow, into, latest_orders_stream, states
from tests.test_goldens import order


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    rows = [order(f"e{i}", 1000 + i % 4, "success" if i % 3 else "pending", d=f"o{i % 5}", amt=str(i)) for i in range(20)]
    names = ("id", "pubkey", "kind", "created_at", "tags")
    for n in range(2):
        (tmp_path / f"{n}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows[n * 8 :]))
    out, check = str(tmp_path / "states"), str(tmp_path / "check")
    for n in range(2):  # events may come twice, and late
        source = tmp_path / "in"
        source.mkdir(exist_ok=True)
        (tmp_path / f"{n}.json").rename(source / f"{n}.json")
        follow(latest_orders_stream(event_stream(spark, str(source), marker="demo")), into(out), check).awaitTermination(60)
    got = sorted((r.d, r.id, r.s) for r in states(spark, out).collect())
    batch = state.latest_orders(typed(spark.createDataFrame(rows, EVENT)))
    assert got == sorted((r.d, r.id, r.s) for r in batch.collect())


def test_ids_are_distinct_within_the_delay(spark, tmp_path):
    rows = [order(f"e{i % 6}", 1000 + i % 6, d=f"o{i % 6}") for i in range(12)]
    names = ("id", "pubkey", "kind", "created_at", "tags")
    (tmp_path / "0.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
    seen = []
    follow(event_stream(spark, str(tmp_path), marker="demo", delay="1 hour"), lambda batch, _: seen.extend(batch.collect())).awaitTermination(60)
    assert sorted(r.id for r in seen) == [f"e{i}" for i in range(6)]
