from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, embedding array<float>, uid string, raw int, shard string, score double, anchor int"


def brute(rows, k=5, low=80):
    """Hard negatives of (vec_id, label, whole vector), straight from the definition."""
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (a, label, v) in enumerate(rows):
        if a is None or a % 100:
            continue
        told = [(score(v, u), b, other) for j, (b, other, u) in enumerate(rows) if j != i]
        best = sorted([t for t in told if t[2] == label], key=order)[:k]
        against = sorted([t for t in told if t[2] != label], key=order)
        for s, p, _ in best:
            hit = [t for t in against if low * s <= 100 * t[0] <= 100 * s][:k]
            out += [(a, p, n, q, s, t) for n, (t, q, _) in enumerate(hit, 1)]
    return sorted(out, key=repr)


def whole(rows):
    """What takes part of (vec_id, label, floats), as the contract says."""
    out = []
    for i, label, v, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        out.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def some(rnd, n, width, labels=4, spread=0.3):
    centres = rnd.normal(size=(6, width))
    rows = [(i, int(rnd.integers(labels)), [float(x) for x in np.float32(centres[rnd.integers(6)] + spread * rnd.normal(size=width))]) for i in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "u", 1, "s", 0.5, 3) for r in rows], SCHEMA)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("leaf, rows, width", [(4, 700, 3), (16, 900, 12), (256, 900, 40)])
def test_mining_by_brute_force(spark, monkeypatch, leaf, rows, width):
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "SHARD_ROWS", 128)
    monkeypatch.setattr(H, "ANCHORS", 3)
    rnd = np.random.default_rng(leaf)
    made = some(rnd, rows, width)
    assert answers(H.mined_embeddings(frame(spark, made))) == brute(whole(made))


def test_odd_rows(spark):
    rnd = np.random.default_rng(9)
    made = some(rnd, 330, 5)
    made += [(made[200][0], *made[200][1:]), (made[5][0], *made[5][1:]), (made[5][0], *made[5][1:])]  # repeated rows, an anchor's copy among them
    made += [(400 + i, 2, [1.0] * 5) for i in range(40)]  # one vector many times: ties
    made += [(500, None, [1.0] * 5), (600, 1, None), (700, 1, [1.0, None, 2.0, 3.0, 4.0]), (800, 1, [float("nan")] * 5), (900, 1, [float("inf")] * 5), (None, 2, [0.9] * 5), (None, 1, [1.1] * 5)]
    made += [(1000, 2, []), (1100, 2, [1.0, 1.0]), (1200, 2, [0.5] * 8), (1201, 3, [0.5] * 8), (1300, 9, [0.0] * 5), (-100, 2, [-1.0] * 5), (-100, 77, [2.0] * 5)]
    want = brute(whole(made))
    assert answers(H.mined_embeddings(frame(spark, made))) == want
    assert {r[0] for r in want} >= {0, 100, 200, 300, 400, 1100} and not {r[0] for r in want} & {500, 600, 700, 800, 900}
    assert H.mined_embeddings(frame(spark, made).limit(0)).collect() == []
    assert H.mined_embeddings(frame(spark, [(100, 1, [1.0])])).collect() == []
    with pytest.raises(ValueError, match="exact"):
        H.mined_embeddings(frame(spark, [(100, 1, [1e30])]))


def test_other_parameters(spark):
    made = whole(some(np.random.default_rng(2), 400, 6))
    df = spark.createDataFrame(made, "vec_id bigint, label int, vector array<bigint>")
    assert answers(H.mined(df, F.col("vec_id") % 100 == 0, k=2, low=95)) == brute(made, 2, 95)


def test_the_tree_skips_what_an_annulus_excludes():
    """On rows in clusters many leaves are never visited, and bounds hold for every row."""
    rnd = np.random.default_rng(1)
    x = np.floor(256 * (rnd.normal(size=(40, 8))[rnd.integers(40, size=20_000)] + 0.02 * rnd.normal(size=(20_000, 8))))
    tree = H.Tree(x)
    anchors = x[:50]
    top, bottom = tree.bounds(anchors)
    for leaf, (_, a, b) in enumerate(tree.leaves):
        score = anchors @ tree.rows[a:b].T
        assert (score.max(axis=1) <= top[:, leaf]).all() and (score.min(axis=1) >= bottom[:, leaf]).all()
    assert sorted(tree.order) == [*range(len(x))]
    best = np.sort(anchors @ x.T, axis=1)[:, -6]
    assert (top >= best[:, None]).mean() < 0.6


def test_the_table_by_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "label", "embedding").collect()]
    assert answers(H.mined_embeddings(df)) == brute(whole(rows))
