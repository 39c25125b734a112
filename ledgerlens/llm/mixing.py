"""Mixing sources to target weights along a time-varying curriculum.

Targets: the mix has ``SHARE`` times the words of all documents; sources, in the order of
their names (null last), weigh 3, 1, 2, repeating; no source gives more than ``CAP`` times
its own size, and what exceeds that is shared anew by weight.  The fixed point needs one sort
of the sources by cap over weight: the capped ones are those before the first whose cap lies
above its share of what the earlier ones left.

Taking: a source's documents stand in the order of a hash.  Whole rounds take every document
once; the rest is taken from the front, the last document in part (its first words), so that
the taken words equal the rounded target.

Curriculum: each source has a weight schedule over training time 0..1, linear between knots.
Its integral, scaled to the target, is the cumulative demand for the source's words; the
inverse at the middle of a document's stretch of words is the document's position.  Documents
are then range-sorted by position.

How it scales: running sums are two-level, over documents and over sources alike.  A source's
documents are dealt by hash into buckets whose number follows from the number of documents
(about ``BUCKET`` each, were they one source's); sums run within a bucket and over the bucket
totals, so no task holds a source.  Only ids, hashes and sizes take part; the stage then meets
its rows once, by document.

Cases: a null text has size 0 and takes 0; sources of size 0 have target 0; rows of equal
doc_id, source and text stand side by side in the order and share their place in it; texts of
any length count whole; an empty table stays empty; other columns, whatever their names, pass
through the stage unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, forget, likely, settle, words

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents of a bucket, about, and the least number of buckets, so that a hot source is always dealt out.
BUCKET, BUCKETS = 4_096, 64
#: Weight schedules as (time, height) knots, one for each of ``WEIGHTS``: early, late, and peaking midway.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)))


def invert(q: Column, knots: tuple) -> Column:
    """The time at which the schedule's integral reaches the share ``q`` (0..1) of its whole."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(area), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, h0), (t1, h1), part in zip(knots, knots[1:], area):
        rest = F.greatest(q * whole - before, F.lit(0.0))
        slope = (h1 - h0) / (t1 - t0)
        # h0 * x + slope * x^2 / 2 = rest, in the form that stays exact for small slopes
        below = h0 + F.sqrt(F.greatest(F.lit(h0 * h0) + 2 * slope * rest, F.lit(0.0)))
        x = F.coalesce(2 * rest / F.nullif(below, F.lit(0.0)), F.lit(0.0))
        before += part
        pieces.append((before, t0 + x))
    for upto, t in reversed(pieces):
        out = F.when(q * whole <= upto, t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def running(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """``rows`` with the sum of each column over all rows that stand before in ``order``, which
    must be total.  Sorted partitions are summed first, then each within itself, so no task
    holds all rows; the totals are one row a partition."""
    ranked = settle(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__at", 33))
    total = ranked.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__part", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = ranked.join(F.broadcast(total), "__part")
    return out.select(*rows.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, c in sums.items()])


def targets(totals: DataFrame) -> DataFrame:
    """Of sources (source, source_size): their rank modulo the weights, and their target.

    The capped sources come first in the order of cap over weight: those whose cap lies within
    what the earlier ones leave to their weight.
    """
    name = [F.col("source").asc_nulls_last()]
    ordered = running(totals.withColumn("one", F.lit(1)), name, place="one").drop("one")
    ordered = ordered.withColumn("kind", (F.col("place") % len(WEIGHTS)).cast("int")).drop("place")
    ordered = ordered.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("kind") + 1))
    ordered = ordered.withColumn("cap", CAP * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    ordered = settle(running(ordered, [F.col("ratio"), *name], caps="cap", weights="w"), "sources")
    every = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    level = (SHARE * every["size"] - F.col("caps")) / (every["w"] - F.col("weights"))
    ordered = ordered.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("ratio"))
    free = ordered.filter(~F.col("capped")).agg(F.min_by("level", F.struct("ratio", -F.col("level")))).first()[0]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(free).cast("double") * F.col("w"))
    return ordered.select("source", "kind", "source_size", target.alias("target"))


#: A document's key, without nulls, so that equal keys meet by plain equality.
KEY = ("i", "no_id", "s", "no_source", "t")


def keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    """``KEY`` (i: doc_id, s: source, t: a hash of the text), the order h, the size, and the
    carried columns."""
    text, doc_id, source = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("bigint"), F.col("source").cast("string")
    t = F.xxhash64(text)
    size = F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1))).cast("bigint")
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), t, F.lit("mix"))
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("i"), doc_id.isNull().alias("no_id"), F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("no_source"), t.alias("t"), h.alias("h"), size.alias("size"), *carried)


def planned(docs: DataFrame) -> DataFrame:
    """Each distinct ``KEY`` with its rows (many), their size, source, and where they begin
    among the source's words."""
    slim = keyed(docs).groupBy(*KEY, "h", "size").agg(F.count("*").alias("many"))
    slim = settle(slim, "sizes")
    buckets = max(BUCKETS, -(-slim.count() // BUCKET))
    slim = slim.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    at = ["s", "no_source", "bucket"]
    sums = settle(slim.groupBy(*at).agg(F.sum(F.col("size") * F.col("many")).alias("words")), "bucket-sizes")
    source = sums.groupBy("s", "no_source").agg(F.sum("words").alias("source_size"))
    source = targets(source.select(F.when(~F.col("no_source"), F.col("s")).alias("source"), "source_size"))
    source = source.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"), "kind", "source_size", "target")
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("s", "no_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settle(sums.select(*at, ahead.alias("ahead")).join(source, ["s", "no_source"]), "bucket-starts")
    forget(docs.sparkSession, sums)
    within = Window.partitionBy(*at).orderBy("h", "i", "no_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("many")).over(within), F.lit(0))).join(starts, at)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0)
    return placed.select(*KEY, "size", "many", "kind", "source_size", "target", (F.col("ahead") + F.col("inner")).alias("begin"), rounds.cast("int").alias("rounds"))


def shared(rows: DataFrame) -> DataFrame:
    """What the mix takes of each row: its ``begin`` becomes that of the ``nth`` of its key."""
    rows = rows.withColumn("begin", F.col("begin") + F.col("nth") * F.col("size"))
    rest = F.round("target").cast("bigint") - F.col("rounds") * F.col("source_size")
    extra = F.least(F.greatest(rest - F.col("begin"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("extra", extra.cast("bigint"))
    return rows.withColumn("taken", F.col("rounds") * F.col("size") + F.col("extra"))


def position(start: Column, length: Column) -> Column:
    q = F.when(F.col("target") > 0, (start + length / 2) / F.col("target")).otherwise(0.0)
    out = invert(q, SCHEDULES[-1])
    for i in range(len(SCHEDULES) - 1):
        out = F.when(F.col("kind") == i, invert(q, SCHEDULES[i])).otherwise(out)
    return out


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the position of the first copy (null if
    none is taken), range-sorted by it."""
    rows = shared(planned(docs).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1))))
    first = F.when(F.col("rounds") > 0, F.col("size")).otherwise(F.col("extra"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(F.col("begin"), first)))
    rows = rows.withColumn("doc_id", F.when(~F.col("no_id"), F.col("i")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The training sequence: a row for each copy taken, in the order of positions, with the
    columns of ``docs``; a copy taken in part has its first words only."""
    plan = settle(planned(docs), "mix-plan")
    rows = keyed(docs, F.struct("*").alias("row")).select(*KEY, "row", F.lit(False).alias("repeated"))
    rows = likely(rows, plan.filter("many > 1").select(*KEY), *KEY, flag="repeated")
    # Rows of one key differ in other columns at most; a hash of these tells their order, and
    # equal rows are one, with their number, until they have met their plan.
    equal = rows.filter("repeated").groupBy(*KEY, F.xxhash64("row").alias("other")).agg(F.first("row").alias("row"), F.count("*").alias("times"))
    ahead = F.coalesce(F.sum("times").over(Window.partitionBy(*KEY).orderBy("other").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    single = rows.filter("not repeated").select(*KEY, "row", F.lit(0).cast("bigint").alias("first"), F.lit(1).cast("bigint").alias("times"))
    rows = single.unionByName(equal.select(*KEY, "row", ahead.alias("first"), "times")).join(plan, [*KEY])
    rows = shared(rows.withColumn("nth", F.explode(F.sequence("first", F.col("first") + F.col("times") - 1))))
    whole = F.when((F.col("rounds") > 0) & (F.col("size") > 0), F.sequence(F.lit(0), F.col("rounds") - 1)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(F.transform(whole, lambda c: F.struct(c.alias("n"), F.col("size").alias("words"))), F.when(F.col("extra") > 0, F.array(F.struct(F.col("rounds").alias("n"), F.col("extra").alias("words")))).otherwise(F.array().cast("array<struct<n:int,words:bigint>>")))
    rows = rows.withColumn("copy", F.explode(copies))
    rows = rows.withColumn("position", position(F.col("copy.n") * F.col("source_size") + F.col("begin"), F.col("copy.words")))
    part = F.array_join(F.slice(words(F.col("row.text")), 1, F.col("copy.words").cast("int")), " ")
    text = F.when(F.col("copy.words") == F.col("size"), F.col("row.text")).otherwise(part)
    out = rows.withColumn("new", text).orderBy("position", "no_id", "i", "t", "nth", "copy.n")
    return out.select(*[(F.col("new") if c == "text" else F.length("new").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
