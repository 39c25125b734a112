from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import common, graph
from ledgerlens.llm import line_dedup as L
from ledgerlens.llm import simhash as S
from ledgerlens.llm import substring_dedup as D
from tests.llm.cases import SCHEMA, documents, ids_and_texts, words

BIG = 1 << 62


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines_by_brute_force(rows, order):
    """{(id, text): (lines, equal, near, kept text)}; equal rows count once."""
    out, seen = {}, []
    for i, t in sorted({(i, t) for i, t in rows}, key=order):
        kept, equal, near = [], 0, 0
        if t is None:
            out[i, t] = (0, 0, 0, None)
            continue
        for line in t.split("\n"):
            tok = line.split(" ")
            if not words(line):
                kept.append(line)
            elif any(line == x for x, _ in seen):
                equal += 1
            elif len(tok) >= L.MIN_TOKENS and any(len(y) >= L.MIN_TOKENS and within_one(tok, y) for _, y in seen):
                near += 1
            else:
                kept.append(line)
            if words(line):
                seen.append((line, tok))
        out[i, t] = (len(t.split("\n")), equal, near, "\n".join(kept))
    return out


def test_lines_equal_brute_force(spark):
    docs = documents(spark)
    rows = ids_and_texts(docs)
    hashed = {t: h for t, h in docs.select("text", F.xxhash64("text")).collect()}
    want = lines_by_brute_force(rows, lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    assert sum(v[2] for v in want.values()) > 5
    got = sorted(((r.doc_id, r.n_lines, r.n_equal_removed, r.n_near_removed, r.kept_sha256) for r in L.line_digests(docs).collect()), key=repr)
    assert got == sorted(((i, *want[i, t][:3], hashlib.sha256((want[i, t][3] or "").encode()).hexdigest()) for i, t in rows), key=repr)
    stage = L.without_repeats(docs)
    assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
    assert sorted((repr((r.doc_id, r.text)) for r in stage.collect())) == sorted(repr((i, want[i, t][3])) for i, t in rows)
    assert L.line_digests(docs.limit(0)).count() == 0


def test_a_common_line_with_many_variants(spark):
    base = [f"t{i}" for i in range(12)]
    rows = []
    for i in range(400):
        w = list(base)
        k = i % 12
        w[k : k + 1] = ([f"r{i}"], [], [w[k], f"n{i}"])[i % 3] if i else [w[k]]
        rows.append((i, " ".join(w)))
    want = lines_by_brute_force(rows, lambda r: r[0])
    got = {r.doc_id: (r.n_equal_removed, r.n_near_removed) for r in L.line_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: want[i, t][1:3] for i, t in rows} and sum(v[1] for v in got.values()) > 250


def test_running_xors_of_long_arrays(spark):
    for n in (0, 1, 2, 3, 10, 1000):
        x = [xxhash.xxh64_intdigest(str(i)) >> 2 for i in range(n)]
        df = spark.createDataFrame([(x,)], "v array<bigint>")
        want = [int(v) for v in np.bitwise_xor.accumulate(np.array(x, np.int64))] if n else []
        assert L.with_runs(df, "v", "r").first().r == want


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_prefilter_lets_no_key_go(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.range(2000).withColumn("text", F.lit("t"))
    wanted = spark.createDataFrame([(i,) for i in range(0, 2000, 37)], "id bigint")
    got = {r.id for r in common.likely(rows, wanted, "id").collect()}
    assert set(range(0, 2000, 37)) <= got and (bits == 64 or len(got) < 200)
    told = common.likely(rows.withColumn("hit", F.lit(None).cast("boolean")), wanted, "id", flag="hit").collect()
    assert len(told) == 2000 and {r.id for r in told if r.hit} == got
    assert common.likely(rows, wanted.limit(0), "id").count() == 0


def test_a_line_in_most_documents_is_split(spark):
    """The join back to the lines is the only one of its stage, so AQE may split a hot line."""
    rows = [(i, "a line that most documents have, word for word\n" + " ".join(f"w{i}x{j}" for j in range(9))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        seen = L.occurrences(docs)
        marked = seen.groupBy("a", "b", "n").agg(F.min(F.struct("none", "d", "th", "ln")).alias("first"), F.count("*").alias("times")).filter("times > 1")
        met = L.met(seen, common.settle(marked.withColumn("hit", F.lit(None).cast("boolean")), "marked"))
        met.write.format("noop").mode("overwrite").save()
        assert met.count() == 3000 - 1
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k in keys:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def substrings_by_brute_force(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (BIG if i is None else i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, bucket", [(D.BLOCK, D.BUCKET), (400, 40)])
def test_substrings_equal_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "BUCKET", bucket)
    rnd = random.Random(5)
    passages = [" ".join(f"p{rnd.randrange(9)}" for _ in range(60)) for _ in range(4)]
    more = [(1000 + i, " ".join([f"u{i}"] * (i % 4) + passages[i % 4].split()[i % 9 : 50 + i % 7] + [f"v{i}"])) for i in range(80)]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string")).union(spark.createDataFrame([(-5, passages[0]), (2000, passages[0] + "\n" + passages[0])], "doc_id bigint, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in D.substring_digests(docs).collect()), key=repr)
    want = substrings_by_brute_force(ids_and_texts(docs))
    assert got == want and sum(r[2] for r in want) > 1000
    spans = D.remove_repeats(docs.filter("doc_id = 2000 or doc_id = -5")).filter("id = 2000").first().spans
    assert spans == [0, 120]
    assert D.substring_digests(docs.limit(0)).count() == 0


def test_packing():
    rnd = np.random.default_rng(1)
    for h in (np.sort(rnd.integers(0, 1 << 64, 999, np.uint64)), np.array([0], np.uint64), np.array([(1 << 64) - 1], np.uint64), np.arange(5, dtype=np.uint64)):
        x = rnd.integers(0, 1 << 32, len(h), np.uint32)
        a, b = D.unpack(D.pack(h, x))
        assert (a == h).all() and (b == x).all()
        for buckets in (1, 3, 1000):
            found = D.runs(h, buckets)
            assert len(found) <= len(h) and [k for _, i, j in found for k in range(i, j)] == [*range(len(h))]
            assert all((int(v) >> 32) * buckets >> 32 == b for b, i, j in found for v in h[i:j])


def test_windows_that_agree_in_64_bits_only_are_told_apart():
    h, x = np.array([5, 5, 5, 3, 5], np.uint64), np.array([1, 2, 1, 7, 2], np.uint32)
    order, new = D.in_order(h, x)
    assert order.tolist() == [3, 0, 2, 1, 4] and new.tolist() == [True, True, False, True, False]


def test_blocks_have_about_equal_bytes(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 40_000)
    rows = [(i, "word " * (4000 if i < 20 else 20)) for i in range(4000)] + [(None, "x"), ((1 << 63) - 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rows_, size = D._blocks(docs)
    assert size == 20 * 20_000 + 3980 * 100 + 2
    blocks = rows_.groupBy("block").agg(F.sum(F.octet_length("raw")).alias("b"), F.count("*").alias("n")).collect()
    assert max(r.b for r in blocks) <= 4 * 40_000 and len(blocks) > 10
    got = {r.doc_id: r.n_words for r in D.substring_digests(docs).collect()}
    assert got[None] == 1 and got[(1 << 63) - 1] == 1 and len(got) == len(rows)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
def test_words_hashed_in_chunks(monkeypatch, chunk):
    rnd = random.Random(chunk)
    texts = ["", " ", "a", " a ", "abcdefghij" * 9, "\n\tx  y\x0b", "é" * 20 + " ü"]
    texts += ["".join(rnd.choice("ab \n\u00e9") for _ in range(200)) for _ in range(20)]
    want = []
    for text in texts:
        start, end, value = D.chunk_words(np.frombuffer(text.encode(), np.uint8))
        want.append((start.tolist(), end.tolist(), D.mixed(value + (end - start).astype(np.uint64)).tolist()))
    monkeypatch.setattr(D, "CHUNK", chunk)
    assert [tuple(x.tolist() for x in D.word_hashes(t.encode())) for t in texts] == want
    assert [[t.encode()[a:b].decode() for a, b in zip(s, e)] for t, (s, e, _) in zip(texts, want)] == [words(t) for t in texts]
    monkeypatch.setattr(D, "CHUNK", 16 * chunk)
    for t, (s, e, _) in zip(texts, want):
        assert D.joined(t.encode(), np.array(s, np.int32), np.array(e, np.int32)).decode() == " ".join(words(t))


def test_rows_without_id_need_no_common_block(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4000)
    monkeypatch.setattr(D, "BUCKET", 500)
    rnd = random.Random(8)
    passages = [" ".join(f"p{rnd.randrange(40)}" for _ in range(40)) for _ in range(6)]
    rows = [(i, f"a{i} {passages[i % 4]} b{i}") for i in range(60)]
    # Without id: passages that ids have, passages that none has, equal texts, empty and null ones.
    rows += [(None, f"c{i} {passages[i % 6]} d{i}") for i in range(60)] + [(None, passages[5])] * 50 + [(None, ""), (None, None)] * 40
    for table in (rows, [r for r in rows if r[0] is None]):
        docs = spark.createDataFrame(table, "doc_id bigint, text string")
        blocks = {r.block for r in D._blocks(docs)[0].filter("none").select("block").distinct().collect()}
        assert len(blocks) > 5 and min(blocks) >= D.UNKNOWN
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in D.substring_digests(docs).collect()), key=repr)
        assert got == substrings_by_brute_force(table)


def test_a_long_text_in_bounded_memory():
    """50 MB of text as a block of its own, its windows found and its words joined again."""
    import tracemalloc

    rnd = np.random.default_rng(3)
    raw = b" ".join(b"w%d" % x for x in rnd.integers(0, 100_000, 7_600_000).tolist())
    assert len(raw) > 50_000_000
    tracemalloc.start()
    order, spans, owner, h, x, index = D.prepared([1], [raw], 13)
    start, end, n = spans[0]
    assert n == 7_600_000 - 12 == len(index) and len(h) == n and (np.diff(h) > 0).all()
    assert D.joined(raw, start, end) == raw
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000_000, peak


def brute_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(3, len(w))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = documents(spark)
    rows = ids_and_texts(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), BIG), BIG if d is None else d)
    want = sorted(((d, f"{fps[i]:016x}", least[root(i)] if least[root(i)] < BIG else None) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=repr) == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(i) for i in range(len(rows))})
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_links_equal_all_pairs(spark):
    rnd = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            y = x
            for _ in range(rnd.randrange(1, 4)):
                y ^= 1 << rnd.choice((0, 5, 31, 32, 40, 63, rnd.randrange(64)))
            fps.add(y)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = sorted(tuple(sorted((r.a, r.b))) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect())
    assert len(got) == len(set(got))
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(500, 600)] + [(7, 7), (8, 9), (9, 8)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in [1, *range(500, 600)]}, 8: 8, 9: 8}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_schema_of_cases(spark):
    assert len(documents(spark).columns) == len(SCHEMA.split(","))


def test_texts_and_lines_above_a_megabyte(spark):
    rnd = random.Random(6)
    line = " ".join(f"{rnd.randrange(60_000):055d}" for _ in range(20_000))
    near = line.replace(" ", " extra ", 1)
    many = "\n".join([f"line {i % 7} of some words that come again" + " and again" * 3 for i in range(20_000)])
    rows = [(1, line), (2, line), (3, "x" * 1_200_000), (4, many), (5, near)]
    assert all(len(t) > 1 << 20 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_equal_removed, r.n_near_removed) for r in L.line_digests(docs).collect()}
    # Of the seven lines, each but the first differs from it in one token.
    assert got == {1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 0, 0), 4: (20_000, 19_993, 6), 5: (1, 0, 1)}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in D.substring_digests(docs).collect()}
    assert cut[1] == (20_000, 0) and cut[2] == (20_000, 20_000) and cut[3] == (1, 0) and cut[4] == (280_000, 0) and cut[5] == (20_001, 19_999)
    fp = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert fp[1] == fp[2] and all(fp[i][0] == f"{brute_fingerprint(t):016x}" for i, t in rows)
