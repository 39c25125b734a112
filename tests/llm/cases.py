"""Small documents with everything that may go wrong in them, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Score double, line string, size int, row string, bucket string, rank int"


def some_texts(n=60, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "***", "!!", "é", "你好", "🙂"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 5, 12, 13, 14, 40, 90)))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        if rnd.random() < 0.5:  # a near copy: one word changed, dropped or added
            w = t.split(" ")
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice(([], [w[i], "new"], ["other"]))
            out.append("\n".join([rnd.choice(base), " ".join(w)]))
    return out


def documents(spark, extra=True):
    """Rows of ``SCHEMA``: ties, repeats, nulls, blanks, long texts, and clashing column names."""
    texts = [*some_texts(), None, "", " \n\t ", "\n\n", "one", "one", "two words", "a" * 5000, "ab " * 3000, "x\r\ny\x0bz\x85q r", "The <|endoftext|> end", "nów ﻿  "]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "s3", "", None)[i % 5], len(t or ""), 0.5, "l", 1, "r", "b", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (4, "another text of the same id", "en", "s1", 1, None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows if extra else rows[: len(texts)], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame([*rows], "doc_id bigint, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")


def ids_and_texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
