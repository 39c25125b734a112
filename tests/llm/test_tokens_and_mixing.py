from __future__ import annotations

import hashlib
import json
import random
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, common, mixing, token_counts
from tests.llm.cases import documents, ids_and_texts, words


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(bpe.NAME))
    t.no_padding()
    t.no_truncation()
    return t


def test_digests_equal_the_library(spark, library):
    docs = documents(spark)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs).collect()), key=repr)
    counted = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()), key=repr)
    want, n = [], []
    for i, t in ids_and_texts(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        n.append((i, len((t or "").encode()), len(ids), len(ids) > 2048))
    assert got == sorted(want, key=repr) and counted == sorted(n, key=repr)
    assert bpe.bpe_digests(docs.limit(0)).count() == 0 and token_counts.token_counts(docs.limit(0)).count() == 0
    general = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode_documents(documents(spark, False)).collect()}
    assert all(general[i] == (library.encode(t or "", add_special_tokens=False).ids, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in ids_and_texts(documents(spark, False)))


def test_random_texts(library):
    path = public_tokenizers.path(bpe.NAME)
    code, count = bpe.Coder(path), token_counts.Counter(path, token_counts.proven(path))
    rnd = random.Random(11)
    near = [chr(c) for c in range(0x180)] + list("abcdefghrstlmv' ") * 20
    wide = near + [chr(c) for c in (0x300, 0x301, 0x3A3, 0x130, 0x1100, 0x1161, 0x200B, 0x1F600, 0xFEFF, 0x2028, 0x1E9E, 0xAC00)] * 6
    for n in range(3000):
        s = "".join(rnd.choice(wide if n % 2 else near) for _ in range(rnd.randrange(50)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert bpe.encode(path, s) == ids and count.count(s) == len(ids), s
        assert code.decode(ids) == library.decode(ids, skip_special_tokens=False)


def slow_merge(symbols, pairs):
    while True:
        found = [(pairs[p][0], i) for i in range(len(symbols) - 1) if (p := (symbols[i], symbols[i + 1])) in pairs]
        if not found:
            return symbols
        i = min(found)[1]
        symbols = [*symbols[:i], pairs[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]


def test_segment_tree_takes_the_leftmost_lowest_rank():
    rnd = random.Random(4)
    pairs = {}
    for _ in range(40):
        pairs.setdefault((rnd.randrange(8), rnd.randrange(8)), (len(pairs), rnd.randrange(8)))
    ranks, made = {a << bpe.PAIR | b: r for (a, b), (r, _) in pairs.items()}, [m for _, m in pairs.values()]
    for _ in range(3000):
        s = [rnd.randrange(8) for _ in range(rnd.randrange(24))]
        assert bpe.merge(list(s), ranks, made) == slow_merge(s, pairs)
    for _ in range(60):  # more than one level of nodes
        s = [rnd.randrange(8) for _ in range(rnd.randrange(17, 700))]
        assert bpe.merge(list(s), ranks, made) == slow_merge(s, pairs)
    assert bpe.merge([1, 2] * 20_000, {1 << bpe.PAIR | 2: 0}, [3]) == [3] * 20_000


def test_proven_tokens_are_whole(library):
    code = bpe.Coder(public_tokenizers.path(bpe.NAME))
    whole = token_counts.whole_tokens(code)
    assert len(whole) > 30_000
    for w in random.Random(1).sample(sorted(whole), 500):
        assert len(code.tokens(w.encode())) == 1


def test_caches_are_bounded_in_bytes_together():
    room = bpe.Room(4000)
    a, b = bpe.Cache(len, room, {"k": 9}), bpe.Cache(len, room)
    assert [a[x] for x in ("k", "a", "bb", "ccc", "dddd", "k", "a")] == [9, 1, 2, 3, 4, 9, 1]
    weigh = lambda c: sum(bpe.ENTRY + sys.getsizeof(k) + sys.getsizeof(v) for k, v in c.items())
    for i in range(300):
        assert a["x" * (i % 90)] == b["y" * (i % 70)] + i % 90 - i % 70
        assert weigh(a) + weigh(b) <= 4500 and weigh(a.old) + weigh(b.old) <= 4500
    assert a["z" * 10_000] == 10_000 and "z" * 10_000 not in a  # too long to keep


def test_a_worker_keeps_one_stage_at_a_time():
    made = []
    assert common.held("a", lambda: made.append("a") or 1) == 1 and common.held("a", lambda: made.append("a")) == 1
    assert common.held("b", lambda: 2) == 2 and list(common._HELD) == ["b"]
    assert common.held("a", lambda: made.append("again") or 3) == 3 and made == ["a", "again"]


def test_other_vocabulary_rules_are_errors(tmp_path):
    spec = json.loads(open(public_tokenizers.path(bpe.NAME), encoding="utf-8").read())
    bpe.check_rules(spec)
    changes = [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", {"type": "ByteLevel"}), ("added_tokens", [{"id": 1, "content": "x", "lstrip": True}])]
    for key, value in changes:
        with pytest.raises(ValueError):
            bpe.check_rules({**spec, key: value})
    for key, value in (("ignore_merges", True), ("dropout", 0.1), ("end_of_word_suffix", None), ("type", "Unigram")):
        with pytest.raises(ValueError):
            bpe.check_rules({**spec, "model": {**spec["model"], key: value}})
    with pytest.raises((ValueError, KeyError)):
        bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))


def test_very_long_texts(spark, library):
    """More than a megabyte of words, and one pre-token of many thousand letters."""
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 12))) for _ in range(170_000)), "".join(rnd.choice("abcdefgh") for _ in range(60_000)), "“" + "ünd " * 3000]
    assert len(texts[0]) > 1 << 20
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in bpe.bpe_digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert counted[i] == len(ids)


def test_restoring_undoes_bytes_and_word_ends():
    path = public_tokenizers.path(bpe.NAME)
    for text, want in (("Hello wörld 你好!", "hello wörld 你好 !"), ("a<|endoftext|>b", "a <|endoftext|> b"), ("", "")):
        assert bpe.Coder(path).restore(bpe.encode(path, text)) == want


def plan_by_hand(sizes):
    """Targets by the rule, one round of resharing after another."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    return target


def test_targets_and_taken_words(spark):
    docs = documents(spark)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    sizes, src = {}, {}
    for r in docs.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want = plan_by_hand(sizes)
    by_size = {(v, round(want[s], 6)) for s, v in sizes.items()}
    assert {(r.source_size, round(r.target, 6)) for r in rows} == by_size
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size, round(r.target, 6)] = taken.get((r.source_size, round(r.target, 6)), 0) + r.taken
    assert all(abs(v - k[1]) <= 1 for k, v in taken.items()), (taken, src)
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)
    again = mixing.mixture(docs.repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert mixing.mixture(docs.limit(0)).count() == 0
    empty = mixing.mixture(docs.filter("text is null or text = ''")).collect()
    assert empty and all((r["size"], r.target, r.taken, r.position) == (0, 0.0, 0, None) for r in empty)


def place_by_hand(q, knots):
    """Where the schedule's integral reaches the share q of its whole, by bisection."""
    def area(t):
        return sum((min(t, b[0]) - a[0]) * (2 * a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if t > a[0])

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < q * area(1.0) else (low, mid)
    return low


@pytest.mark.parametrize("bucket, least", [(mixing.BUCKET, mixing.BUCKETS), (7, 1), (1000, 1)])
def test_every_taken_and_position_by_brute_force(spark, monkeypatch, bucket, least):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "BUCKETS", least)
    docs = documents(spark)
    rows = mixing.keyed(docs, F.col("source").alias("__s"), F.col("doc_id").alias("__d")).collect()
    sizes = {}
    for r in rows:
        sizes[r["__s"]] = sizes.get(r["__s"], 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = plan_by_hand(sizes)
    buckets = max(mixing.BUCKETS, -(-len({(r.i, r.no_id, r.s, r.no_source, r.t) for r in rows}) // bucket))
    want = []
    for n, s in enumerate(names):
        mine = sorted((r for r in rows if r["__s"] == s), key=lambda r: (r.h % buckets, r.h, r.i, r.no_id, r.t))
        begin, rounds = 0, int(round(target[s]) // sizes[s]) if sizes[s] else 0
        rest = round(target[s]) - rounds * sizes[s]
        for r in mine:
            extra = min(max(rest - begin, 0), r["size"])
            taken = rounds * r["size"] + extra
            q = (begin + (r["size"] if rounds else extra) / 2) / target[s] if taken else None
            want.append((r["__d"], r["size"], sizes[s], taken, None if q is None else round(place_by_hand(q, mixing.SCHEDULES[n % 3]), 6)))
            begin += r["size"]
    got = [(r.doc_id, r["size"], r.source_size, r.taken, None if r.position is None else round(r.position, 6)) for r in mixing.mixture(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_running_sums_are_two_level(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v bigint").repartition(5)
    got = {r.k: (r.before, r.n) for r in mixing.running(df.withColumn("one", F.lit(1)), [F.col("k")], before="v", n="one").collect()}
    at, want = 0, {}
    for n, (k, v) in enumerate(sorted(rows)):
        want[k] = (at, n)
        at += v
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_targets_of_random_sources(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice((0, 1, 5, 5, 5, 100, 3000)) for i in range(9)} | {None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plan_by_hand(sizes)
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes)


def test_inverse_of_schedules(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.25, 2.0), (1.0, 0.0))):
        area = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if t > a[0])
        qs = [i / 40 for i in range(41)]
        got = [r.t for r in spark.createDataFrame([(q,) for q in qs], "q double").select(mixing.invert(F.col("q"), knots).alias("t")).collect()]
        assert got == sorted(got)
        assert all(area(t) / area(1.0) == pytest.approx(q, abs=1e-9) for q, t in zip(qs, got))


def test_training_sequence(spark):
    docs = documents(spark).filter("doc_id is not null")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    taken = {}
    for i, t in ids_and_texts(out):
        taken[i] = taken.get(i, 0) + len(words(t))
    want = {}
    for r in mixing.mixture(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {i: n for i, n in want.items() if n}
    whole = {}
    for i, t in ids_and_texts(docs):
        whole.setdefault(i, []).append(words(t))
    assert all(any(words(t) == w[: len(words(t))] for w in whole[i]) for i, t in ids_and_texts(out))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_whole_tokens_are_looked_up_in_any_stretch():
    counter = token_counts.Counter(public_tokenizers.path(bpe.NAME), token_counts.proven(public_tokenizers.path(bpe.NAME)))
    merged = []
    tokens = counter.coder.tokens
    counter.mapped.make = lambda m: merged.append(m) or len(tokens(bpe.unmapped(m)))
    assert counter.count("the house “stands” at the river — and the water") > 8
    assert not {"the", "house", "stands", "at", "river", "and", "water"} & set(merged)
    assert all(len(tokens(bpe.unmapped(m))) == 1 for m in random.Random(2).sample(sorted(counter.mapped.start), 300))
