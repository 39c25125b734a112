"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts.  A text is cut
into pieces of ``PIECE`` bytes (all of it; long texts would otherwise outgrow the
dictionaries) and compressed with either.  The difference of the two sizes over the text's
length is the only input of the score: a logistic curve, fitted on other labelled texts,
turns it into the probability of label 1.

Learning uses labelled rows only where crc32(doc_id as text) mod 4 is not 2: remainders 0
and 1 build the dictionaries, remainder 3 fits the curve.  Samples are bounded by numbers of
labelled rows, whatever their length: ``DICT_ROWS`` texts of each class, of which every piece
is trained on, and ``FIT_ROWS`` texts for the curve, all taken in the order of a hash.  Where a
class's pieces are more than ``GROUP_BYTES``, they train in groups of so many, on the
executors, and the groups' dictionaries are the texts that the next one is trained on.  Scores
never see labels, lang, source or doc_id.

Cases: null and empty texts are scored as texts of no bytes (difference 0); texts of any
length are measured whole, and take part in samples like any other; a document with several
labels counts as good only if all say so; without labelled rows of both classes in both
samples every score is 1, so that nothing is rejected; repeated rows get equal scores; an
empty table stays empty; ``keep_good`` returns every column of ``docs``, whatever its name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, forget, held, settle, ship

PIECE, LEVEL, DICT_BYTES = 2048, 3, 112_640
#: Bounds of the samples, in labelled rows; bytes that one dictionary is trained on.
DICT_ROWS, FIT_ROWS, GROUP_BYTES = 1_500, 5_000, 16 << 20
CUT = 0.7


def pieces(raw: bytes | memoryview) -> list:
    return [raw[i : i + PIECE] for i in range(0, max(len(raw), 1), PIECE)]


def dictionary(found: list[bytes]) -> bytes:
    """A dictionary's bytes; small samples, which the trainer refuses, serve as they are."""
    size = min(DICT_BYTES, sum(map(len, found)) // 3)
    try:
        return zstandard.train_dictionary(max(size, 512), found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)


def measurer(good: bytes, bad: bytes) -> Callable[[bytes], float]:
    """The function from a text to its normalised difference of compressed sizes."""
    made = []
    for d in (bad, good):
        known = zstandard.ZstdCompressionDict(d)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_dict_id=False, write_content_size=False, write_checksum=False))

    def measure(raw: bytes) -> float:
        cut = pieces(raw)
        b, g = (sum([len(c.compress(p)) for p in cut]) for c in made)
        return (b - g) / max(len(raw), 1)

    return measure


def kept_measurer(good: bytes, bad: bytes) -> Callable[[bytes], float]:
    return held(("zstd", good, bad), partial(measurer, good, bad))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope of a ridge logistic regression on the standardised difference (Newton
    steps), in terms of the difference itself."""
    mid, scale = x.mean(), x.std() + 1e-9
    t = np.column_stack([np.ones(len(x)), (x - mid) / scale])
    w = np.zeros(2)
    keep = ridge * len(y) * np.diag([0.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        w -= np.linalg.solve((t * (p * (1 - p))[:, None]).T @ t + keep + 1e-6 * np.eye(2), t.T @ (p - y) + keep @ w)
    return float(w[0] - w[1] * mid / scale), float(w[1] / scale)


def probability(curve: tuple[float, float], difference: float) -> float:
    return 1 / (1 + math.exp(-min(max(curve[0] + curve[1] * difference, -30.0), 30.0)))


def remainder(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0))


def samples(docs: DataFrame, labels: DataFrame, dict_rows: int = DICT_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(part, doc_id, q, raw): labelled texts whose part is "dict" or "fit", by one scan of the
    texts.  The table of ids is bounded by the samples' sizes, so it is broadcast."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("r", remainder()).filter("r <> 2")
    known = settle(known, "labelled-ids")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = known.filter("r = 3").orderBy(*order).limit(fit_rows).withColumn("part", F.lit("fit"))
    for q in (1, 0):
        taken = taken.union(known.filter((F.col("r") < 2) & (F.col("q") == q)).orderBy(*order).limit(dict_rows).withColumn("part", F.lit("dict")))
    ids = taken.select(F.col("doc_id").alias("__id"), "q", "part")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    out = settle(texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("part", "doc_id", "q", "raw"), "labelled-texts")
    forget(docs.sparkSession, known)
    return out


def sampled_pieces(sample: DataFrame, q: int) -> DataFrame:
    """(h, doc_id, at, piece): all pieces of a class's sampled texts, with the hash whose order
    they are trained in: the trainer learns from the first three quarters and tunes itself by the
    rest, so both must be of one kind."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("raw") / PIECE).cast("int") - 1, F.lit(0))), lambda i: F.substring("raw", i * PIECE + 1, F.lit(PIECE)))
    rows = sample.filter((F.col("part") == "dict") & (F.col("q") == q)).select("doc_id", F.posexplode(cut).alias("at", "piece"))
    return rows.withColumn("h", F.xxhash64("doc_id", "at")).select("h", "doc_id", "at", "piece")


def trained(found: DataFrame) -> bytes | None:
    """The dictionary of all pieces (``sampled_pieces``), whatever their number; None without any
    byte of text."""
    ship(found.sparkSession)

    def group(rows):
        import pandas as pd  # where a sample is that large; other workers do without its memory

        rows = rows.sort_values(["h", "doc_id", "at"])
        made = dictionary([bytes(x) for x in rows["piece"]])
        return pd.DataFrame([(int(rows["h"].iloc[0]), int(rows["n"].iloc[0]), at, piece) for at, piece in enumerate(pieces(made))], columns=["h", "doc_id", "at", "piece"])

    passing = None
    while True:
        size = found.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
        if size <= GROUP_BYTES:
            rows = found.collect()
            break
        # By a hash, so groups are of like size; each is GROUP_BYTES or a little more.
        n = -(-size // GROUP_BYTES)
        dealt = found.withColumn("n", F.pmod(F.xxhash64("h", "at"), F.lit(n)))
        made = settle(dealt.repartition(n, "n").groupBy("n").applyInPandas(group, "h bigint, doc_id bigint, at bigint, piece binary"), "dictionaries")
        forget(found.sparkSession, passing)
        found = passing = made
    forget(found.sparkSession, passing)
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["at"], bytes(r["piece"])))
    return dictionary([bytes(r["piece"]) for r in rows]) if size else None


def fit(docs: DataFrame, labels: DataFrame, dict_rows: int = DICT_ROWS, fit_rows: int = FIT_ROWS) -> dict | None:
    """Dictionaries and curve as plain values; None without both classes in both samples.
    ``dict_rows`` and ``fit_rows`` bound the samples' labelled rows."""
    sample = samples(docs, labels, dict_rows, fit_rows)
    good, bad = (trained(sampled_pieces(sample, q)) for q in (1, 0))
    model = None
    if good and bad:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            measure = kept_measurer(good, bad)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([measure(t.as_py()) for t in batch.column(1)], pa.float64())], ["q", "x"])

        rows = sorted(arrow_rows(sample.filter("part = 'fit'").select("q", "raw"), run, "q int, x double", keeps=True).collect())
        y = np.array([r["q"] for r in rows], float)
        if len(y) and y.min() < y.max():
            model = {"good": good, "bad": bad, "curve": fit_curve(np.array([r["x"] for r in rows]), y)}
    forget(docs.sparkSession, sample)
    return model


def scored(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """``docs`` with the score of each text as one more column."""
    if model is None:
        return docs.withColumn(column, F.lit(1.0))
    ship(docs.sparkSession)
    good, bad, curve = model["good"], model["bad"], model["curve"]

    @F.arrow_udf("double")
    def score(raw: pa.Array) -> pa.Array:
        measure = kept_measurer(good, bad)
        return pa.array([probability(curve, measure(memoryview(r.as_buffer()))) for r in raw], pa.float64())

    return docs.withColumn(column, score(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, whether it is held out of learning, score, and the decision at ``CUT``."""
    out = scored(docs.select(F.col("doc_id").cast("bigint"), "text"), fit(docs, labels))
    return out.select("doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with the columns of ``docs``."""
    rows = scored(docs.select(F.struct("*").alias("row"), "text"), fit(docs, labels), "score")
    return rows.filter(F.col("score") >= CUT).select("row.*")
