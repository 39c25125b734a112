"""Repair of conversations' structure: the cheapest edits that make the roles take turns.

A conversation's rows, by turn (nulls first; then by role and by a digest of role and text), must
become a sequence of roles whose initials read ``(s?(ua)+)?``.  Edits, and the letters by which
they are told: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or
assistant row, anywhere) 3.  Blank rows and duplicates (role and text seen earlier in the
conversation) must be deleted; a truncated row (its last character that is no white space is none
of ``.!?``) costs 3 more unless it is deleted.  Of the cheapest edits those whose letters are
least in ASCII order are taken.

The edits are found by A* on the edit lattice, whose nodes are (rows consumed, state of the role
pattern) and whose arcs are edits.  The heuristic is the suffix sum of what no path avoids: 4 for
each row that must go, 3 for each truncated row.  The queue is keyed by (cost plus heuristic,
letters so far): the first node that accepts at the end is the answer, and the first visit of any
node is the best way to it.  Two ways to one node of equal cost are never a prefix of each other
(what the longer has on top would be Inserts, at 3 each), so the order of letters so far is that
of whole answers, and a conversation may be searched in blocks of ``BLOCK`` rows: what a block
hands on is the best way to each of the four states.  So a task holds one block, whatever the
conversation's length, beside the letters that the answer itself consists of.

Where the work is: the search sees no texts, only one row of some 60 bytes for each distinct row;
duplicates are found by an aggregation and a join on (conversation, digest), both of which Spark
can split.  Texts are shuffled once, to meet their conversation's letters, and pass as a stream.
The repaired rows of one conversation come from one task, as a stream, since their order is the
result.

Cases: null roles and texts are one space (so such texts are blank; such roles, like empty ones,
cannot be kept); a null conv_id is a conversation of its own; rows without a turn come first and
take no part in gaps; rows of one turn are ordered by role and digest; repeated rows are
duplicates; texts of any length are read whole; an empty table stays empty; columns other than
conv_id, turn, role and text, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, settle

RETURNED = "conv_id bigint, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "conv_id bigint, seq bigint, edit string, role string, text string"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: Rows searched at a time, and rows and characters of repaired text that leave together.
BLOCK, ROWS, CHARACTERS = 512, 2048, 4 << 20
BLANKS = "\t\n\x0b\x0c\r "
LEGAL = ("su", "ua", "au")
# States of the pattern: nothing yet, after s, after u, after a.  Where a kept initial leads ...
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# ... and a rerole or an insert, which gives the only role that may follow (s is only ever kept).
GIVEN, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)
FINE, CUT, GONE = 0, 1, 2
Way = tuple[int, str]


def least_edits(rows: list[tuple[str, int]], entries: dict[int, Way], last: bool) -> dict[int, Way]:
    """The best (cost, letters) to each state after ``rows`` (initial, fault), from the best ways
    to the states before them; if ``last``, only that of the state accepted first."""
    n, rest = len(rows), [0] * (len(rows) + 1)
    for i in reversed(range(n)):
        rest[i] = rest[i + 1] + (0, TRUNCATED, DELETE)[rows[i][1]]
    queue = [(cost + rest[0], letters, 0, state) for state, (cost, letters) in entries.items()]
    heapq.heapify(queue)
    seen, found = set(), {}
    while queue:
        key, letters, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = key - rest[i]
        if i == n:
            if not last:
                found[state] = cost, letters
            elif state in ACCEPTED:
                return {state: (cost, letters)}
        heapq.heappush(queue, (key + INSERT, letters + "I", i, GIVEN[state]))
        if i == n:
            continue
        initial, fault = rows[i]
        heapq.heappush(queue, (cost + DELETE + rest[i + 1], letters + "D", i + 1, state))
        if fault != GONE:
            cost += TRUNCATED * (fault == CUT) + rest[i + 1]
            heapq.heappush(queue, (cost + REROLE, letters + "R", i + 1, GIVEN[state]))
            if (after := KEPT[state].get(initial)) is not None:
                heapq.heappush(queue, (cost + KEEP, letters + "K", i + 1, after))
    return found


@dataclass
class Search:
    """One conversation as its rows stream by."""

    conv_id: int | None
    ways: dict[int, Way] = field(default_factory=lambda: {0: (0, "")})
    settled: list[str] = field(default_factory=list)
    block: list[tuple[str, int]] = field(default_factory=list)
    n: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first: int | None = None
    turn: int | None = None
    initial: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, repeated: bool, copies: int) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.turn = turn
        for _ in range(copies):
            if blank:
                self.blank += 1
            elif repeated:
                self.duplicate += 1
            elif cut:
                self.truncated += 1
            self.illegal += self.initial is not None and self.initial + initial not in LEGAL
            if len(self.block) == BLOCK:
                self.advance()
            self.block.append((initial, GONE if blank or repeated else CUT if cut else FINE))
            self.n, self.initial, repeated = self.n + 1, initial, True

    def advance(self, last: bool = False) -> None:
        ways = least_edits(self.block, self.ways, last)
        known = commonprefix([letters for _, letters in ways.values()])
        self.settled.append(known)
        self.ways = {state: (cost, letters[len(known) :]) for state, (cost, letters) in ways.items()}
        self.block = []

    def result(self) -> tuple:
        self.advance(True)
        cost = next(iter(self.ways.values()))[0]
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, self.n, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled)


def record_batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*values], kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def filled(conversations: DataFrame) -> DataFrame:
    """The four columns that count, without null roles and texts, and the digest of both."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def order(*first: str) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def edits(conversations: DataFrame) -> DataFrame:
    """One row per conversation (``RETURNED``): what is wrong with it, and the letters and the
    cost of its cheapest repair."""
    shown = F.rtrim("text", F.lit(BLANKS))
    blank, cut = shown == "", ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    rows = filled(conversations).select("conv_id", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies"))
    # A message's first turn, where it has several: rows of a later one are duplicates.
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = rows.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.count("*").alias("m")).filter("m > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("g"), "first")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left")
    repeated = F.coalesce(~at.eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    rows = rows.select("conv_id", "turn", "role", "digest", "blank", "cut", repeated.alias("repeated"), "copies")
    rows = rows.repartition("conv_id").sortWithinPartitions(*order()).select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "cut", "repeated", "copies")
    names = tuple(part.strip().split(" ")[0] for part in RETURNED.split(","))
    kinds = (*[pa.int64()] * 8, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        found.append(now.result())
                    now = Search(conv_id)
                now.add(*row)
                if len(found) >= ROWS:
                    yield record_batch(found, names, kinds)
                    found = []
        if now is not None:
            yield record_batch([*found, now.result()], names, kinds)

    return arrow_rows(rows, run, RETURNED)


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows (``REPAIRED``) by the letters of ``edits``: a conversation's rows come
    from one partition, in order; ``edit`` tells what made each (Keep, Rerole, Insert)."""
    rows = filled(conversations).select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    letters = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    both = rows.unionByName(letters).repartition("conv_id").sortWithinPartitions(*order("part")).select("conv_id", "part", "role", "text")
    names = tuple(part.strip().split(" ")[0] for part in REPAIRED.split(","))
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        audit, at, state, conv, seq = "", 0, 0, None, 0
        for batch in batches:
            for conv_id, part, role, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                edit = audit[at : at + 1] if part else ""
                while audit[at : at + 1] == "I":  # before this row, or at the end of the last conversation
                    yield conv, seq, "I", ROLE[state], ""
                    at, seq, state = at + 1, seq + 1, GIVEN[state]
                    edit = audit[at : at + 1] if part else ""
                if not part:
                    audit, at, state, conv, seq = text.as_py(), 0, 0, conv_id, 0
                    continue
                at += 1
                if edit == "R":
                    yield conv, seq, edit, ROLE[state], text.as_py()
                    seq, state = seq + 1, GIVEN[state]
                elif edit == "K":
                    yield conv, seq, edit, role, text.as_py()
                    seq, state = seq + 1, KEPT[state][role[:1]]
        for _ in audit[at:]:
            yield conv, seq, "I", ROLE[state], ""
            seq, state = seq + 1, GIVEN[state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in apply(batches):
            out.append(row)
            size += len(row[4])
            if len(out) >= ROWS or size >= CHARACTERS:
                yield record_batch(out, names, kinds)
                out, size = [], 0
        if out:
            yield record_batch(out, names, kinds)

    return arrow_rows(both, run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as ``repaired`` gives them, which this reads as a
    stream: role:text, joined by newlines.  Conversations without a row have none here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (pa.int64(), pa.string()), ("conv_id", "repaired_sha256")
        conv, sha, out = None, None, []
        for batch in batches:
            for conv_id, seq, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if seq == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = conv_id, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text.as_py()}".encode())
            if out:
                yield record_batch(out, names, kinds)
                out = []
        if sha is not None:
            yield record_batch([(conv, sha.hexdigest())], names, kinds)

    return arrow_rows(rows, run, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults of a known kind: by the CRC-32 of ``conv_id:turn`` modulo 20 a
    row is dropped (0), loses its text (1) or its ``.!?`` (2), is repeated (3) or becomes the
    user's (4).  Nulls read as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", "role", "text")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the damaged table: its faults, its repair and a digest of the
    repaired rows; a conversation that lost all its rows has zeros and nothing."""
    rows = damaged(conversations)
    found = settle(edits(rows), "conversation-edits")
    shas = digests(repaired(rows, found)).withColumnRenamed("conv_id", "sha_of")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(shas, F.col("id").eqNullSafe(F.col("sha_of")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
