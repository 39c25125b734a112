"""Line dedup by a deletion-neighbourhood join (native: DataFrame functions only).

A line's tokens are what stands between single spaces.  A line goes if an earlier line of
the corpus (by doc_id, then text hash, then line number) is equal, or, where both have at
least ``least`` tokens (a parameter, ``MIN_TOKENS`` by default: in shorter lines one token is
too much of the meaning), within an edit distance of ``BOUND`` = 1 token (one replaced,
inserted or deleted).  Whether that earlier line is itself removed does not matter.  Lines
without a visible character stay.

1. Equal lines meet by hash; the earliest of each is a distinct line.
2. Only lines that can have a neighbour go on: one edit leaves the first or the second half
   of a line as it is, so the line shares a prefix or a suffix of half its tokens (for token
   counts one more or less) with its neighbour.  This drops no neighbour.
3. Their deletion variants are emitted as hashed keys: the line itself, the line less each
   token, and for replacements the line less a token with that token's place.  A side of the
   line that must be equal is not varied.  Keys are XORs of token hashes with their places,
   so a line's variants cost one pass over it.
4. Equal variants are joined to the earliest line that has them, never pair by pair: lines
   that share a replacement key are all within one edit of each other; a line that is
   another's deletion is within one edit of it.
5. The edit distance of each line to its earliest neighbour is verified on the tokens.

Hot lines, prefixes and variants are reduced by partial aggregation before they are shuffled;
the one join back to the lines may be split where a line is in most documents.

Cases: a null text has no lines and stays null; empty texts stay empty; texts and lines of any
length are treated whole; repeated rows (equal
doc_id and text) count as one document and are treated alike; rows without a doc_id come
last; an empty table stays empty; other columns pass through the stage unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import forget, likely, settle

MIN_TOKENS, BOUND = 8, 1
WHOLE, DELETED, REPLACED = 0, 1, 2


def _keyed(docs: DataFrame) -> DataFrame:
    """doc key (none, d, th) and lines of each text."""
    text = F.col("text")
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("d"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def occurrences(docs: DataFrame) -> DataFrame:
    """A row a line: place, two hashes that name it, token count, and its half keys."""
    rows = _keyed(docs).select("none", "d", "th", F.posexplode("lines").alias("ln", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    n, line = _tokens(F.col("line")), F.col("line")
    rows = rows.select("none", "d", "th", "ln", "line", n.alias("n"))
    n = F.col("n")
    half = [F.floor((n - 1) / 2), F.floor((n + 1) / 2)]  # n // 2 is one of them
    rest = [n - 1 - F.floor((n - 1) / 2), n + 1 - F.floor((n + 1) / 2)]  # and so is n - n // 2

    def side(tag: str, k: Column, sign: int) -> Column:  # the Python form of substring_index takes literals only
        return F.xxhash64(F.lit(tag), k, F.call_function("substring_index", line, F.lit(" "), (sign * k).cast("int")))

    keys = [side("p", k, 1).alias(f"p{i}") for i, k in enumerate(half)] + [side("s", k, -1).alias(f"s{i}") for i, k in enumerate(rest)]
    return rows.select("none", "d", "th", "ln", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), "n", *keys)


def with_runs(rows: DataFrame, values: str, runs: str) -> DataFrame:
    """``rows`` with the inclusive running XORs of an array, made in chunks of about its
    length's square root, so that n tokens cost n^1.5 small steps rather than n^2.  Steps are
    columns: inside a lambda, an expression would be computed anew for each element."""
    zero = F.lit(0).cast("bigint")

    def running(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<bigint>"), lambda a, v: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), zero).bitwiseXOR(v)))

    rows = rows.withColumn("width", F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1)))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / F.col("width")).cast("int") - 1, F.lit(0))), lambda c: running(F.slice(values, c * F.col("width") + 1, F.col("width"))))
    rows = rows.withColumn("chunks", chunks)
    rows = rows.withColumn("ends", running(F.transform("chunks", lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), zero))))
    flat = F.flatten(F.transform("chunks", lambda c, i: F.transform(c, lambda v: v.bitwiseXOR(F.coalesce(F.get("ends", i - 1), zero)))))
    return rows.withColumn(runs, flat).drop("width", "chunks", "ends")


def variants(lines: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """(key, role, rank) of the possible lines (rank, line, n, by_prefix, by_suffix)."""
    toks = lines.select("rank", "n", "by_prefix", "by_suffix", F.split("line", " ").alias("tok"))
    here = F.transform("tok", lambda t, i: F.xxhash64(t, i))
    left = F.transform("tok", lambda t, i: F.xxhash64(t, i).bitwiseXOR(F.xxhash64(t, i - 1)))
    step = toks.select("rank", "n", "by_prefix", "by_suffix", here.alias("here"), left.alias("moved"))
    step = with_runs(step, "moved", "runs")
    zero = F.lit(0).cast("bigint")
    step = step.withColumn("all", F.aggregate("here", zero, lambda a, v: a.bitwiseXOR(v))).withColumn("end", F.coalesce(F.try_element_at("runs", F.lit(-1)), zero))
    n = F.col("n")
    low = F.when(F.col("by_suffix"), F.lit(0)).otherwise(F.floor((n - 1) / 2))
    high = F.when(F.col("by_prefix"), n - 1).otherwise(F.least(F.floor((n + 1) / 2), n - 1))
    places = F.sequence(low.cast("int"), high.cast("int"))
    # The line less token i: those after it move one place to the left.
    less = lambda i: F.col("all").bitwiseXOR(F.get("here", i))
    deleted = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit("w"), n - 1, less(i).bitwiseXOR(F.col("end")).bitwiseXOR(F.get("runs", i))).alias("key"), F.lit(DELETED).alias("role")))
    replaced = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit("r"), n, i, less(i)).alias("key"), F.lit(REPLACED).alias("role")))
    whole = F.array(F.struct(F.xxhash64(F.lit("w"), n, F.col("all")).alias("key"), F.lit(WHOLE).alias("role")))
    deleted = F.when(n > least, deleted).otherwise(F.slice(deleted, 1, 0))  # its neighbour would be too short
    return step.select("rank", F.explode(F.concat(whole, deleted, replaced)).alias("v")).select("v.key", "v.role", "rank")


def within_one(a: Column, b: Column) -> Column:
    """Whether two token arrays are within one edit: what their common prefix and suffix
    leave over is one token at most on either side."""
    longest, shortest = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), F.lit(False))
        return F.when(at > 0, at - 1).otherwise(shortest)

    return (longest - shortest <= BOUND) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - BOUND)


def removed_lines(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """(none, d, th, ln, near): each line that goes; near is false for equal lines.  Lines of
    fewer than ``least`` tokens are near none."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if _repeats(docs):
        docs = docs.distinct()
    seen = settle(occurrences(docs), "lines")
    place = F.struct("none", "d", "th", "ln")
    name = ["a", "b", "n"]
    halves = ["p0", "p1", "s0", "s1"]
    first = seen.groupBy(*name).agg(F.min(place).alias("first"), F.count("*").alias("times"), *[F.first(h).alias(h) for h in halves])
    first = settle(first, "distinct-lines")
    long = first.filter(F.col("n") >= least)
    keys = long.select("a", F.explode(F.array(*[F.struct(F.col(h).alias("key"), F.lit(h[0] == "p").alias("prefix")) for h in halves])).alias("k")).select("a", "k.*").distinct()
    shared = keys.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y")).filter("x <> y").select("key")
    hit = keys.join(shared, "key").groupBy("a").agg(F.bool_or("prefix").alias("by_prefix"), F.bool_or(~F.col("prefix")).alias("by_suffix"))
    possible = long.select("a", "b", "n", "first.*").join(hit, "a")
    # Sorted by place, ids that only grow are ranks in the order of the corpus.
    ranked = settle(possible.orderBy("none", "d", "th", "ln").withColumn("rank", F.monotonically_increasing_id()), "possible-lines")
    wanted = ranked.groupBy("none", "d", "th").agg(F.collect_list(F.struct("ln", "rank", "n", "by_prefix", "by_suffix")).alias("want"))
    got = likely(_keyed(docs), ranked.select("none", "d", "th").distinct(), "none", "d", "th").join(wanted, ["none", "d", "th"]).select(F.explode(F.transform("want", lambda w: F.struct(w["rank"].alias("rank"), w["n"].alias("n"), w["by_prefix"].alias("by_prefix"), w["by_suffix"].alias("by_suffix"), F.get("lines", w["ln"]).alias("line")))).alias("l")).select("l.*")
    lines = settle(got, "possible-texts")
    emitted = settle(variants(lines, least), "variants")  # read twice below
    firsts = emitted.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("rank"))).alias(f"m{r}") for r in (WHOLE, DELETED, REPLACED)], F.max("rank").alias("top"))
    firsts = firsts.filter("(m0 is not null and m1 is not null) or m2 < top").select("key", "m0", "m1", "m2")
    partner = F.when(F.col("role") == WHOLE, F.col("m1")).when(F.col("role") == DELETED, F.col("m0")).otherwise(F.col("m2"))
    linked = emitted.join(firsts, "key").select("rank", partner.alias("to")).filter("to < rank").groupBy("rank").agg(F.min("to").alias("to"))
    mine, theirs = lines.select("rank", F.split("line", " ").alias("x")), lines.select(F.col("rank").alias("to"), F.split("line", " ").alias("y"))
    near = linked.join(mine, "rank").join(theirs, "to").filter(within_one(F.col("x"), F.col("y"))).select("rank")
    near = settle(ranked.join(near, "rank").select("a", "b", "n"), "near-lines")
    for table in (emitted, lines, ranked):
        forget(spark, table)
    # Distinct lines that lose anything, with their verdict, meet the lines in one join: two on
    # the same key would be one stage, in which a line that most documents have is not split.
    marked = first.join(near.withColumn("hit", F.lit(True)), name, "left").filter("times > 1 or hit")
    marked = settle(marked.select(*name, "first", "hit"), "marked-lines")
    gone = settle(met(seen, marked), "removed-lines")
    for table in (seen, first, near, marked):
        forget(spark, table)
    return gone


def met(seen: DataFrame, marked: DataFrame) -> DataFrame:
    """The lines that go: of the ``marked`` ones all but the first, and near ones altogether."""
    rows = seen.select("none", "d", "th", "ln", "a", "b", "n").join(marked, ["a", "b", "n"])
    same = F.struct("none", "d", "th", "ln") != F.col("first")
    return rows.filter(same | F.col("hit")).select("none", "d", "th", "ln", (~same).alias("near"))


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id occurs twice (a count over ids alone)."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def dedup_lines(docs: DataFrame, *carried: Column, least: int = MIN_TOKENS) -> DataFrame:
    """The carried columns of each row, its number of lines, those removed, and the kept text."""
    gone = removed_lines(docs, least).groupBy("none", "d", "th").agg(F.collect_list("ln").alias("gone"), F.count_if("near").alias("n_near"))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("d"), F.xxhash64("text").alias("th"), F.col("text").alias("__text"), *carried)
    rows = rows.join(gone, ["none", "d", "th"], "left").withColumn("__lines", F.split("__text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return rows.withColumn("__kept", kept)


def line_digests(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """doc_id, lines, lines removed as equal and as near ones, and the kept text's SHA-256."""
    out = dedup_lines(docs, F.col("doc_id").cast("bigint").alias("doc_id"), least=least)
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")
    near = F.coalesce("n_near", F.lit(0)).cast("bigint")
    lines = F.when(F.col("__text").isNull(), 0).otherwise(F.size("__lines")).cast("bigint")
    return out.select("doc_id", lines.alias("n_lines"), (removed - near).alias("n_equal_removed"), near.alias("n_near_removed"), F.sha2(F.coalesce("__kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with the kept text (and n_chars, where there is such a column)."""
    out = dedup_lines(docs, F.struct("*").alias("row"), least=least)
    return out.select(*[(F.col("__kept") if c == "text" else F.length("__kept").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
