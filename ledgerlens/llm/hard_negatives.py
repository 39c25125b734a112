"""Hard-negative mining: exact searches by vantage-point trees over norm-augmented vectors.

A score is an integer inner product.  With one more coordinate, sqrt(M - |x|^2) for rows (M the
greatest squared norm) and 0 for anchors, the distance from an anchor a to a row x is
sqrt(|a|^2 + M - 2 score): the higher the score, the nearer the row, and a window of scores is an
annulus around the anchor.  Rows are dealt to shards of bounded size by a hash of a row number;
each shard builds one tree.  A tree node keeps the least and greatest distance of its rows to its
parent's vantage point, so the triangle inequality bounds the distances, and by that the scores,
of a whole subtree.  A traversal visits leaves nearest first, in waves of doubling length, skips
what lies outside the annulus, and ends for a window when no leaf left can reach its k-th row so
far.  Visits of one leaf by several anchors are one matrix product.

Two searches run one after the other: the ``k`` best rows of the anchor's own label (windows
without ends), and, for the window that each of these opens, the ``k`` best rows of other labels.
What the shards find, k rows a window at most, is merged by rank.  Anchors go to every shard as
rows of the same sorted stream that brings the shard's rows, so a task holds one shard and
``ANCHORS`` anchors.  Nothing is collected or broadcast; the driver reads two numbers.

Results are exact: products are of whole numbers in double precision, so squared norms must stay
below 2^53 (an error tells otherwise); bounds are widened by more than their rounding errors.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part;
vectors of unlike lengths count as filled up with zeros, empty ones as zeros; rows are told
apart by an own number, so repeated rows and ids each take part (an anchor's copy is one of its
others); ties are broken by the smaller vec_id, null ids last; fewer rows than asked for give
fewer; an empty table gives no row; columns other than vec_id, label and the vector, whatever
their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, settle

K, LEAF, ANCHORS = 5, 256, 256
#: Bytes of a shard's vectors in double precision, and the rows below which none is split.
SHARD_BYTES, SHARD_ROWS = 32 << 20, 2048
#: Candidates that wait until they are merged into the best so far.
WAITING = 1 << 18
EXACT = 1 << 53
ANY = np.iinfo(np.int64).max
FOUND = "anchor bigint, w int, uid bigint, vec_id bigint, score bigint"


class Tree:
    """A vantage-point tree over a shard's whole-number vectors (rows, columns)."""

    def __init__(self, x: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", x, x)
        self.most = norms.max(initial=0.0)
        extra = np.sqrt(self.most - norms)
        self.order, self.leaves = np.arange(len(x)), []
        self.parent, self.vantage, self.span = [-1], [-1], [(0.0, 0.0)]
        todo = [(0, 0, len(x))]
        while todo:
            node, a, b = todo.pop()
            if b - a <= LEAF:
                self.leaves.append((node, a, b))
                continue
            rows = self.order[a:b]
            # The row farthest from the first one splits better than a random one.
            far = rows[np.argmin(x[rows] @ x[rows[0]] + extra[rows] * extra[rows[0]])]
            away = np.sqrt(np.maximum(2 * (self.most - x[rows] @ x[far] - extra[rows] * extra[far]), 0))
            half = (b - a) // 2
            cut = np.argpartition(away, half)  # halves by rank, so that equal rows split as well
            self.order[a:b], away = rows[cut], away[cut]
            for lo, hi in ((0, half), (half, b - a)):
                self.parent.append(node)
                self.vantage.append(far)
                self.span.append((away[lo:hi].min(), away[lo:hi].max()))
                todo.append((len(self.parent) - 1, a + lo, a + hi))
        self.rows = x[self.order]
        points, self.point = np.unique([max(v, 0) for v in self.vantage], return_inverse=True)
        self.points = x[points] if len(x) else x

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and the least score that each leaf can have for each anchor."""
        own = np.einsum("ij,ij->i", anchors, anchors) + self.most
        to = np.sqrt(np.maximum(own[:, None] - 2 * (anchors @ self.points.T), 0))
        slack = 1e-6 * (1 + np.sqrt(own))
        near, far = np.zeros((len(self.parent), len(anchors))), np.full((len(self.parent), len(anchors)), np.inf)
        for node in range(1, len(self.parent)):
            d, (least, most), up = to[:, self.point[node]], self.span[node], self.parent[node]
            near[node] = np.maximum(near[up], np.maximum(d - most, least - d) - slack)
            far[node] = np.minimum(far[up], d + most + slack)
        at = [node for node, _, _ in self.leaves]
        wide = 1 + 1e-9 * own[:, None]
        return (own[:, None] - near[at].T ** 2) / 2 + wide, (own[:, None] - far[at].T ** 2) / 2 - wide


@dataclass
class Shard:
    """A tree and what belongs to its rows; ``place`` orders them by vec_id, null last."""

    tree: Tree
    uid: np.ndarray
    vec_id: list
    label: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, uid: list[int], vec_id: list, label: list[int], raw: list[bytes]) -> Shard:
        tree = Tree(matrix(raw))
        order = tree.order
        place = np.empty(len(uid), np.int64)
        place[sorted(range(len(uid)), key=lambda i: (vec_id[i] is None, vec_id[i] or 0, uid[i]))] = np.arange(len(uid))
        return cls(tree, np.array(uid, np.int64)[order], [vec_id[i] for i in order], np.array(label, np.int64)[order], place[order])

    def search(self, anchors: np.ndarray, uid: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(anchor, window, row, score) of the k best rows of each window: ``low`` and ``high``
        are (anchors, windows) of scores, both ends included; rows of the same label or of
        others, never the anchor itself."""
        n, windows = low.shape
        width = max(anchors.shape[1], self.tree.rows.shape[1])
        anchors, rows = widened(anchors, width), widened(self.tree.rows, width)
        top, bottom = self.tree.bounds(anchors[:, : self.tree.points.shape[1]])
        if anchors.shape[1] > self.tree.points.shape[1]:  # coordinates that no row has count in the anchor's norm alone
            top, bottom = top + np.einsum("ij,ij->i", anchors, anchors)[:, None], bottom - np.einsum("ij,ij->i", anchors, anchors)[:, None]
        nearest = np.argsort(-top, axis=1, kind="stable")
        best = [np.zeros(0, np.int64)] * 3  # window of anchor, row, score
        # The k-th row so far, as a score and a place, of each window.
        kth, behind = np.full(n * windows, -ANY), np.full(n * windows, ANY)
        waiting, held = [best], 0

        def merged() -> None:
            nonlocal best, waiting, held
            group, row, score = (np.concatenate(c) for c in zip(*waiting, strict=True))
            by = np.lexsort((self.place[row], -score, group))
            group, row, score = group[by], row[by], score[by]
            rank = np.arange(len(group)) - np.searchsorted(group, group)
            kept, last = rank < k, rank == k - 1
            kth[group[last]], behind[group[last]] = score[last], self.place[row[last]]
            best = [group[kept], row[kept], score[kept]]
            waiting, held = [best], 0

        at, step = 0, 1
        while at < nearest.shape[1]:
            wave = nearest[:, at : at + step]
            who, col = np.nonzero(np.ones_like(wave, bool))
            leaf = wave[who, col]
            floor = np.maximum(low, kth.reshape(n, windows))
            reach = ((top[who, leaf, None] >= floor[who]) & (bottom[who, leaf, None] <= high[who])).any(axis=1)
            if not (top[np.arange(n), wave[:, 0], None] >= floor).any():
                break  # leaves come by falling top, so none that follows reaches a window
            who, leaf = who[reach], leaf[reach]
            by = np.argsort(leaf, kind="stable")
            who, leaf = who[by], leaf[by]
            for i, j in zip(*(e.tolist() for e in edges(leaf)), strict=True):
                _, a, b = self.tree.leaves[leaf[i]]
                some = who[i:j]
                score = anchors[some] @ rows[a:b].T
                floor = np.maximum(low[some], kth.reshape(n, windows)[some]).min(axis=1)
                fits = (score >= floor[:, None]) & (score <= high[some].max(axis=1)[:, None])
                fits &= (label[some][:, None] == self.label[None, a:b]) == same
                p, q = np.nonzero(fits & (uid[some][:, None] != self.uid[None, a:b]))
                value, p, q = score[p, q].astype(np.int64), some[p], q + a
                for w in range(windows):
                    group = p * windows + w
                    better = (value > kth[group]) | (value == kth[group]) & (self.place[q] < behind[group])
                    hit = better & (value >= low[p, w]) & (value <= high[p, w])
                    waiting.append([group[hit], q[hit], value[hit]])
                    held += int(hit.sum())
                if held > WAITING:
                    merged()
            merged()
            at, step = at + step, 2 * step
        group, row, score = best
        return group // windows, group % windows, row, score


def edges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    begin = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, int)
    return begin, np.r_[begin[1:], len(sorted_values)] if len(begin) else begin


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def matrix(raw: list[bytes]) -> np.ndarray:
    """Packed vectors as rows in double precision, shorter ones filled up with zeros."""
    out = np.zeros((len(raw), max(1, max(map(len, raw), default=0) // 4)))
    for i, r in enumerate(raw):
        out[i, : len(r) // 4] = np.frombuffer(r, "<i4")
    return out


def packed(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, raw, norm) of the rows that take part, written once: uid is a row's
    own number, norm its squared length."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<bigint>").alias("vector"))
    rows = rows.filter("label is not null and vector is not null").filter(F.forall("vector", lambda x: x.isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v.values.to_numpy() for v in batch.column(2)]
            raw = [v.astype("<i4").tobytes() for v in found]
            norm = [float(np.square(v.astype(float)).sum()) for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(norm, pa.float64())], ["vec_id", "label", "raw", "norm"])

    made = arrow_rows(rows, run, "vec_id bigint, label bigint, raw binary, norm double")
    return settle(made.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def shards(rows: DataFrame) -> int:
    """How many shards the rows need, from their number and the longest one."""
    n, most, norm = rows.agg(F.count("*"), F.max(F.octet_length("raw")), F.max("norm")).first()
    if norm is not None and norm >= EXACT:
        raise ValueError(f"a squared norm of {norm:g} is beyond exact arithmetic (2^53)")
    each = max(1, SHARD_BYTES // (2 * max(most or 0, 4)))
    spread = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_ROWS))
    return max(1, -(-n // each), spread)


def searched(rows: DataFrame, anchors: DataFrame, n: int, same: bool, low: float, k: int) -> DataFrame:
    """(``FOUND``) the best ``k`` rows of each window of each anchor.  ``anchors`` have uid, label,
    raw and ``tops``, the windows' upper ends; ``low`` times a top is its lower end (hundredths)."""
    nothing = F.lit(None).cast("array<bigint>")
    mine = rows.select(F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("part"), "uid", "vec_id", "label", "raw", nothing.alias("tops"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.lit(1).alias("part"), "uid", F.lit(None).cast("bigint").alias("vec_id"), "label", "raw", "tops")
    stream = mine.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "part")

    def answers(shard: Shard, group: list[tuple]) -> Iterator[pa.RecordBatch]:
        uid, label = (np.array([g[c] for g in group], np.int64) for c in (0, 1))
        windows = max(len(g[3]) for g in group)
        high = np.array([[*g[3], *[-ANY] * (windows - len(g[3]))] for g in group], np.int64)
        # -(-a // 100) rounds up; windows without ends and those that are not there stay as they are.
        least = np.where(np.abs(high) == ANY, np.where(high == ANY, -ANY, ANY), -(-np.where(np.abs(high) == ANY, 0, high) * int(low) // 100))
        a, w, row, score = shard.search(matrix([g[2] for g in group]), uid, label, least, high, same, k)
        columns = [pa.array(uid[a]), pa.array(w.astype(np.int32)), pa.array(shard.uid[row]), pa.array([shard.vec_id[r] for r in row], pa.int64()), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "w", "uid", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, shard, group = None, ([], [], [], []), None, []
        for batch in batches:
            for at, part, uid, vec_id, label, raw, tops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if group:
                        yield from answers(shard, group)
                    now, gathered, shard, group = at, ([], [], [], []), None, []
                if not part:
                    for to, value in zip(gathered, (uid, vec_id, label, raw), strict=True):
                        to.append(value)
                    continue
                if not gathered[0] and shard is None:
                    continue  # a shard without rows
                if shard is None:
                    shard, gathered = Shard.of(*gathered), ([], [], [], [])
                group.append((uid, label, raw, tops))
                if len(group) == ANCHORS:
                    yield from answers(shard, group)
                    group = []
        if group:
            yield from answers(shard, group)

    found = arrow_rows(stream, run, FOUND)
    by = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, anchor: Column, k: int = K, low: int = 80) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id and
    both scores.  ``vectors`` have vec_id, label and a ``vector`` of whole numbers; ``anchor``
    tells which rows ask.  Positives are the first ``k`` other rows of the anchor's label;
    negatives of a positive the first ``k`` rows of other labels that score between ``low``
    hundredths of the positive's score and that score."""
    rows = packed(vectors)
    n = shards(rows)
    asked = rows.filter(anchor)
    whole = F.array(F.lit(int(ANY)).cast("bigint"))
    positives = searched(rows, asked.withColumn("tops", whole), n, True, low, k)
    positives = settle(positives.select("anchor", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).getField("positive_score").alias("tops"))
    asked = asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "raw")
    windows = asked.join(tops, "anchor").withColumnRenamed("anchor", "uid")
    negatives = searched(rows, windows, n, False, low, k).select("anchor", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = negatives.join(positives, ["anchor", "w"]).join(asked.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """Embeddings as whole-number vectors: each component becomes floor(scale * x)."""
    whole = F.col("embedding").cast("array<double>")
    sound = embeddings.filter(F.col("embedding").isNotNull()).filter(F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return sound.select("vec_id", "label", F.transform(whole, lambda x: F.floor(x * scale)).alias("vector"))


def mined_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth row, after the labels of every seventh have moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(quantised(embeddings).withColumn("label", moved), F.col("vec_id") % 100 == 0)
