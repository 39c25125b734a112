"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

Every rule is a ratio of two counts of a text, compared with a cutoff: the text is rejected
where a ratio lies above its cutoff.  All rules move together along one path of steps, from the
mildest cutoffs to the strictest, so that a step is one decision about all rules.

Labelled rows are cut in two by the CRC-32 of their doc_id.  From the first half a stratum
(language) learns its path: a rule's cutoffs are ``FACTORS`` times the highest ratio of a good
text there.  The second half is held out from that and tests the steps.  A step is safe when the
hypothesis "its rules together reject more than ``risk`` of the stratum's good texts" falls
to the exact binomial test at level ``delta / strata`` (Bonferroni over strata).  Within a
stratum the steps are tested along the path up to the first failure (fixed sequence testing),
which needs no further correction; and since the hypotheses are about the rules' joint
rejections, neither risk nor level is divided among rules.  So with probability 1 - delta, no
stratum loses more than ``risk`` of its good texts, whichever safe step is then chosen: the
one with the largest difference between the shares of bad and of good texts that it rejects,
of equal ones the mildest.  A stratum can be tested from log(delta / strata) / log(1 - risk)
good texts in the second half on (86 for four strata); one with fewer, or without a good text in
the first half, gets no cutoffs and rejects nothing.

Cases: a null text has no words and fails the base rules; texts of any length are counted
whole; a null language is a stratum of its own; a document with several labels counts as good
only if all say so; repeated rows and ties are judged one by one, alike; an empty table gives
an empty result; other columns of ``docs``, whatever their names, are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import settle, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: rule -> (numerator, denominator) of its ratio.
RULES = {"symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Steps of a path, mildest first: percent of the highest ratio that the learning half's good
#: texts have, after ``MARGIN`` thousandths were added to it, so that no cutoff begins at zero.
FACTORS = (400, 300, 250, 200, 170, 150, 135, 125, 115, 108, 100, 95, 90, 85, 80, 75, 70, 65, 60, 55, 50, 40, 30, 20)
STEPS, MARGIN = len(FACTORS), 10
RISK, DELTA = 0.05, 0.05
#: Strata up to this many are sent to every task (some 100 bytes each); more are joined by shuffle.
SMALL_STRATA = 20_000


def repeated_words(hashed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``hashed`` with n_repeat_words: words covered by windows that occur twice or more.

    ``hashes`` has one entry a window, or is null where none repeats.  Sorting (hash, position)
    brings equal windows together; the union of the intervals [p, p + window) over the sorted
    positions p is the sum of min(window, gap to the next p).  The sorted pairs are a column
    of their own: inside a lambda, an expression would be computed anew for each element.
    """
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda p, i: F.coalesce(F.get("pairs", i)["h"] == p["h"], F.lit(False))
    hit = F.sort_array(F.array_compact(F.transform("pairs", lambda p, i: F.when(beside(p, i - 1) | beside(p, i + 1), p["i"]))))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("hit", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])
    return hashed.withColumn("pairs", pairs).withColumn("hit", hit).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hashes", "pairs", "hit")


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` and the counts of each text, one row for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    blank = r"^[\x20\x09-\x0D]*$"
    first = docs.select(*keep, text.alias("t"), words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: ~x.rlike(blank)).alias("lines"))
    windows = F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    second = first.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        windows.alias("hashes"),
    )
    third = second.withColumn("hashes", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.col("hashes")))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return repeated_words(third).withColumn("base_failed", base)


def critical(n: Column, p: float, alpha: Column) -> Column:
    """The largest k with P(Binomial(n, p) <= k) <= alpha, or -1.

    Terms are carried as logarithms, so that (1 - p)^n may be smaller than any double.  From
    k = n * p on the sum is beyond any useful alpha, so the sequence stops there; with a mean
    above 10,000 it begins 40 deviations below the mean, before which no double is left.
    """
    mean, odds = n * p, F.log(F.lit(p / (1 - p)))
    begin = F.when(mean > 10_000, F.floor(mean - 40 * F.sqrt(mean * (1 - p)))).otherwise(0).cast("long")
    top = F.greatest(F.ceil(mean).cast("long"), F.lit(0).cast("long"))

    def log_factorial(x: Column) -> Column:  # Stirling's series; x is in the thousands
        return x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)

    b = begin.cast("double")
    far = log_factorial(n.cast("double")) - log_factorial(b) - log_factorial(n - b) + b * F.log(F.lit(p)) + (n - b) * F.log(F.lit(1 - p))
    term = F.when(begin > 0, far).otherwise(n * F.log(F.lit(1 - p)))
    zero = F.struct(term.alias("term"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        total = a["sum"] + F.exp(a["term"])
        after = a["term"] + F.log(F.greatest(n - i, F.lit(1)).cast("double") / (i + 1)) + odds
        return F.struct(after.alias("term"), total.alias("sum"), F.when(total <= alpha, i).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(begin, top), zero, step, lambda a: a["k"])


def over(rule: str, cutoff: Column | int) -> Column:
    top, below = RULES[rule]
    return F.col(top) * 1000 > F.col(below) * cutoff


def ratio(rule: str) -> Column:
    """The least cutoff, in thousandths, that lets a text pass."""
    top, below = map(F.col, RULES[rule])
    return F.when(below == 0, F.lit(0).cast("long")).otherwise(F.floor((top * 1000 + below - 1) / below))


def cutoff(highest: Column, factor: Column) -> Column:
    return F.floor((highest + MARGIN) * factor / 100)


def passed(rule: str) -> Column:
    """How many steps of its stratum's path a text passes by a rule: as cutoffs fall, the number
    of the first step that rejects it."""
    return F.size(F.filter(F.array(*map(F.lit, FACTORS)), lambda f: F.col(f"r_{rule}") <= cutoff(F.col(f"m_{rule}"), f)))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum that can be tested: the best safe step's cutoffs, or nulls.

    What a step rejects are the texts whose first rejecting step is not later, so counts of a
    stratum's texts by that step, and running sums over its steps, tell all.  A step that
    rejects no other texts than the one before is never better, so it needs no row.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good")).select(F.col("doc_id").alias("__id"), "good")
    held = counted.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("__id"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    held = settle(held.select(F.col(stratum).alias("__stratum"), (F.col("good") == 1).alias("good"), half.alias("half"), *[ratio(r).alias(f"r_{r}") for r in RULES]), "quality-labelled")
    paths = settle(held.filter("half = 0 and good").groupBy(F.col("__stratum").alias("__of")).agg(*[F.max(f"r_{r}").alias(f"m_{r}") for r in RULES]), "quality-paths")
    small = paths.count() <= SMALL_STRATA
    tests = held.filter("half = 1").join(F.broadcast(paths) if small else paths, F.col("__stratum").eqNullSafe(F.col("__of")))
    step = F.least(*[passed(r) for r in RULES])
    found = tests.groupBy("__stratum", *[f"m_{r}" for r in RULES], step.alias("step")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    found = settle(found, "quality-steps")
    whole = Window.partitionBy("__stratum")
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    lost = found.select("__stratum", *[f"m_{r}" for r in RULES], "step", F.sum("g").over(upto).alias("k"), F.sum("b").over(upto).alias("kb"), F.sum("g").over(whole).alias("n"), F.sum("b").over(whole).alias("nb")).filter("n > 0")
    strata = lost.select("__stratum").distinct().count()
    # k never falls along the path, so all steps up to a safe one are safe.
    most = critical(F.col("n"), risk, F.lit(delta / max(strata, 1)))
    gain = F.col("kb") * F.col("n") - F.col("k") * F.col("nb")  # times n * nb
    best = F.max(F.when((F.col("step") < STEPS) & (F.col("k") <= most) & (gain > 0), F.struct(gain.alias("gain"), (-F.col("step")).alias("mild"))))
    chosen = lost.groupBy("__stratum", *[f"m_{r}" for r in RULES]).agg((-best["mild"]).alias("step"))
    return chosen.select("__stratum", *[cutoff(F.col(f"m_{r}"), F.get(F.array(*map(F.lit, FACTORS)), F.col("step"))).cast("int").alias(f"cut_{r}") for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts of each document, whether the base rules fail it, and whether it is kept."""
    counted = settle(features(docs, ("doc_id", stratum)), "quality-counts")
    cut = settle(cutoffs(counted, labels, stratum, risk, delta), "quality-cutoffs")
    small = cut.count() <= SMALL_STRATA
    judged = counted.join(F.broadcast(cut) if small else cut, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(over(r, F.col(f"cut_{r}")), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), *[f"cut_{r}" for r in RULES])
