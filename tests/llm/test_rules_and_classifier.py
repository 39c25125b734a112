from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import compression_classifier as C
from ledgerlens.llm import quality_rules as Q
from tests.llm.cases import documents, ids_and_texts, labels, words


def counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_counts_equal_brute_force(spark):
    docs = documents(spark)
    extra = spark.createDataFrame([(900, "a b c d e f g h " * 3 + "z"), (901, "q\nq\n \nq\nr"), (902, "x " * 500)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    rows = docs.select("doc_id", "text", "lang").union(extra)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.features(rows).collect()), key=repr)
    want = [(i, *(c := counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in ids_and_texts(rows)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("n, p, alpha", [(0, 0.05, 0.01), (50, 0.05, 0.01), (300, 0.0125, 0.003), (5000, 0.0125, 0.003), (200_000, 0.01, 0.001)])
def test_critical_value_is_exact(spark, n, p, alpha):
    k, term, total = -1, (1 - p) ** n, 0.0
    if term > 0:
        for i in range(n + 1):
            total += term
            if total > alpha:
                break
            k, term = i, term * (n - i) / (i + 1) * p / (1 - p)
        assert n > 60 or all(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(j + 1)) <= alpha for j in range(k + 1))
        got = spark.range(1).select(Q.critical(F.lit(n).cast("bigint"), p, F.lit(alpha)).alias("k")).first().k
        assert got == k
    else:
        got = spark.range(1).select(Q.critical(F.lit(n).cast("bigint"), p, F.lit(alpha)).alias("k")).first().k
        assert 0 < got < n * p


def test_critical_value_of_very_many(spark):
    n, p, alpha = 5_000_000, 0.01, 0.001
    total, k = 0.0, int(n * p) - 3000
    while True:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
        if total > alpha:
            break
        k += 1
    got = spark.range(1).select(Q.critical(F.lit(n).cast("bigint"), p, F.lit(alpha)).alias("k")).first().k
    assert got == k - 1


def test_false_rejections_stay_within_the_risk(spark):
    """Many strata, each a replicate with the same true loss at each step, tested at the level
    that one stratum alone would have: a safe step beyond the risk is rare."""
    rnd, m, n = random.Random(9), 300, 250
    rows = []
    for lang in range(m):
        for _ in range(n):  # P(ratio > c) = 1 - c^(1/16): 4 % at the cutoff 500, 5.6 % at 400
            rows.append((len(rows), str(lang), 1, int(1000 * rnd.random() ** 16)))
        rows += [(len(rows) + j, str(lang), 0, rnd.randrange(1000)) for j in range(30)]  # stricter is always better
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, quality int, n_symbols bigint")
    counted = frame.withColumns({"base_failed": F.lit(False), "word_chars": F.lit(1000), **{c: F.lit(0) for c in ("n_upper", "n_dup_lines", "n_repeat_words")}, **{c: F.lit(1) for c in ("n_lines", "n_words")}})
    got = [r.cut_symbols for r in Q.cutoffs(counted.drop("quality"), frame.select("doc_id", "quality"), "lang", 0.05, 0.05 * m).collect()]
    true_loss = lambda c: 1 - ((c + 1) / 1000) ** (1 / 16)
    wrong = sum(c is not None and true_loss(c) > 0.05 for c in got)
    assert len(got) == m and sum(c is not None for c in got) > 250
    assert 0 <= wrong <= 0.05 * m + 3 * math.sqrt(m * 0.05 * 0.95)


def test_rules_act_on_the_tables(real):
    out = Q.apply_rules(*real)
    assert out.filter("cut_symbols is not null").count() > 0
    assert out.filter("not kept and not base_failed").count() > 0
    lost = out.filter("not base_failed").join(real[1].filter("quality = 1"), "doc_id").agg(F.avg(F.when(F.col("kept"), 0).otherwise(1))).first()[0]
    assert lost < Q.RISK


def test_longest_text_and_longest_line(spark):
    docs = spark.createDataFrame([(1, "word " * 250_000, "en"), (2, "\n".join(["same line of words"] * 60_000), "en"), (3, "x" * 1_200_000, "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.features(docs).collect()}
    assert got == {1: (250_000, 1_000_000, 0, 0, 250_000), 2: (240_000, 900_000, 0, 59_999, 240_000), 3: (1, 1_200_000, 0, 0, 0)}


def test_cutoffs_hold_their_risk_and_catch_junk(spark):
    good = [(i, " ".join(f"word{j}x{i}" for j in range(40)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"word{j}***" for j in range(40)), "en") for i in range(50)]
    docs = spark.createDataFrame([*good, *bad, (9000, "short", "xx"), (9001, None, None)], "doc_id bigint, text string, lang string")
    known = labels(spark, [*((i, 1, 0) for i, *_ in good), *((i, 0, 0) for i, *_ in bad), (1, 0, 0), (7, None, 0), (None, 1, 0)])
    out = {r.doc_id: r for r in Q.apply_rules(docs, known).collect()}
    assert len(out) == docs.count() and all(out[i].kept for i, *_ in good) and not any(out[i].kept or out[i].base_failed for i, *_ in bad)
    assert out[9000].base_failed and not out[9001].kept
    few = {r.doc_id: r for r in Q.apply_rules(docs, labels(spark, [(i, 1, 0) for i in range(30)])).collect()}
    assert all(few[i].kept for i, *_ in [*good, *bad])  # too few labels: nothing is rejected
    assert Q.apply_rules(docs.limit(0), known).count() == 0 and Q.apply_rules(documents(spark), labels(spark)).count() == documents(spark).count()


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")


def test_scores_follow_from_dictionaries_and_curve(spark, real):
    """Brute force: each text cut and compressed with the model's two dictionaries, by hand."""
    import zstandard

    docs, known = real
    model = C.fit(docs, known)
    got = {r.doc_id: r.score for r in C.scored(docs, model).select("doc_id", "score").collect()}
    tools = [zstandard.ZstdCompressor(level=C.LEVEL, dict_data=zstandard.ZstdCompressionDict(model[k]), write_dict_id=False, write_content_size=False, write_checksum=False) for k in ("bad", "good")]
    offset, slope = model["curve"]
    for i, t in ids_and_texts(docs):
        raw = (t or "").encode()
        b, g = (sum(len(z.compress(raw[a : a + C.PIECE])) for a in range(0, max(len(raw), 1), C.PIECE)) for z in tools)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-offset - slope * (b - g) / max(len(raw), 1))), abs=1e-9)
    assert slope > 0


def test_samples_leave_no_text_out_for_its_length(spark):
    rows = [(i, ("good words stand here " if i % 2 else "b#d w*rds st$nd th%re ") * (4000 if i < 8 else 20)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"q": F.lit("x"), "part": F.lit("y"), "raw": F.lit("z")})
    known = labels(spark, [(i, i % 2, 0) for i in range(400)])
    taken = {r.doc_id for r in C.samples(docs, known).collect()}
    assert taken == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    model = C.fit(docs, known)
    assert model and all(p.predicted == p.doc_id % 2 for p in C.classify(docs, known).collect())


def test_every_piece_of_long_texts_is_trained_on(spark, monkeypatch):
    """Megabyte texts: all pieces reach a dictionary, in groups of bounded size, and what only
    the last piece of the longest text says is known afterwards."""
    seen, made = [], C.dictionary
    rnd = random.Random(1)
    text = lambda n, words: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(150_000 if i < 6 else 60, ["good", "words", "stand", "here", "always"] if i % 2 else ["b#d", "w*rds", "st$nd", "th%re"])) for i in range(300)]
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), labels(spark, [(i, i % 2, 0) for i in range(300)])
    sample = C.samples(docs, known)
    sizes = {r.doc_id: r.n for r in sample.filter("part = 'dict'").selectExpr("doc_id", "octet_length(raw) as n").collect()}
    assert max(sizes.values()) > 700_000
    for q in (0, 1):
        found = C.sampled_pieces(sample, q)
        assert found.agg(F.sum(F.octet_length("piece"))).first()[0] == sum(n for i, n in sizes.items() if i % 2 == q)
        assert found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id < 6").agg(F.min("n")).first()[0] in (None, *range(300, 600))
    whole = C.trained(C.sampled_pieces(sample, 1))
    monkeypatch.setattr(C, "GROUP_BYTES", 200_000)
    monkeypatch.setattr(C, "dictionary", lambda f: seen.append(sum(map(len, f))) or made(f))
    grouped = C.trained(C.sampled_pieces(sample, 1))
    assert whole and grouped and seen[-1] <= 200_000
    monkeypatch.undo()
    model = C.fit(docs, known)
    assert all(p.predicted == p.doc_id % 2 for p in C.classify(docs, known).collect()) and model
    monkeypatch.setattr(C, "GROUP_BYTES", 200_000)
    assert all(p.predicted == p.doc_id % 2 for p in C.classify(docs, known).collect())
    assert C.samples(docs, known, 10, 7).groupBy("part", "q").count().orderBy("part", "q").collect()[0]["count"] == 10
    assert C.dictionary([b"x"] * 3) == b"xxx" and C.dictionary([b"ab" * 1000] * 200) and C.trained(C.sampled_pieces(sample.limit(0), 1)) is None


def test_classifier_is_accurate_on_held_out_rows(real):
    docs, known = real
    out = C.classify(docs, known)
    rows = out.join(known, "doc_id").filter("held_out").select("predicted", "quality", "score").collect()
    assert len(rows) > 60 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.93
    assert all(r.predicted for r in rows if r.quality == 1) or sum(not r.predicted for r in rows if r.quality == 1) <= 3


def test_scores_ignore_held_out_labels_and_other_columns(real):
    docs, known = real
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    rows = lambda d, k: {r.doc_id: r.score for r in C.classify(d, k).collect()}
    assert rows(docs, known) == rows(other, flipped)


def test_held_out_follows_crc32(spark):
    got = {r.doc_id: r.held_out for r in C.classify(documents(spark).filter("doc_id is not null"), labels(spark)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}


def test_cases_of_the_filter(spark, real):
    docs = documents(spark)
    kept = C.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() == docs.count()  # no labels: nothing goes
    out = C.classify(docs, real[1])
    assert out.count() == docs.count() and C.classify(docs.limit(0), labels(spark)).count() == 0
    assert C.keep_good(*real).count() < real[0].count()
