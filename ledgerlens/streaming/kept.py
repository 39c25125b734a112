"""A table of latest states that is kept: batches of events are merged into it.

The table is partitioned by a bucket, a hash of (pubkey, kind, key), so a merge reads and rewrites
only the buckets that its batch touches, and a reader's plan is a scan, without a window or a
shuffle.  Events beyond the merge's instant must not hide earlier states; they wait in a bucket of
their own, all of them, until a later merge's instant has reached them.  Merging is idempotent and
takes late and repeated events in any order: the table equals ``state.facts`` of all events so
far at the last instant, which must not go back.

A merge writes its buckets beside the table first and then replaces the old ones.  If it is cut
off before, the table is as it was; if in between, the next merge (or ``recover``) finishes it.
Merges of one table must follow one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import state
from ledgerlens.schema import TYPED
from ledgerlens.sources.storage import exists, forget, remove, settle

BUCKETS, WAITING = 64, -1
KEY = ("pubkey", "kind", "key")
#: Rows that a task of a merge gets, about, however large a bucket is.
TASK_ROWS = 200_000
STATE = T.StructType([*[f for f in TYPED.fields if f.name not in ("relay", "z", "y")], T.StructField("key", T.StringType()), T.StructField("bucket", T.IntegerType())])


def _layout(spark: SparkSession, path: str, buckets: int) -> int:
    """The table's number of buckets, set by its first merge."""
    at = f"{path}/layout"
    if not exists(spark, f"{at}/_SUCCESS"):
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(at)
    return spark.read.parquet(at).first()["buckets"]


def _table(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/states"):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{path}/states")


def _counts(rows: DataFrame) -> dict[int, int]:
    """Rows by bucket: BUCKETS numbers and one at most."""
    return {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}


def _dealt(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` dealt out by bucket and, within it, by slices of its keys (of the ids of what waits),
    as many as the largest bucket needs for ``TASK_ROWS`` rows a task."""
    slices = max(1, -(-max(counts.values()) // TASK_ROWS))
    rows = rows.withColumn("waiting", F.when(F.col("bucket") == WAITING, F.col("id")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), *KEY, "waiting"), F.lit(slices)))
    return rows.repartition(len(counts) * slices, "bucket", "slice")


def _replace(spark: SparkSession, path: str) -> None:
    made = spark.read.schema(STATE).parquet(f"{path}/pending")
    made = _dealt(made, _counts(made)).select(*STATE.names).sortWithinPartitions("bucket", *KEY)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/states")
    remove(spark, f"{path}/pending")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a merge that was cut off."""
    if exists(spark, f"{path}/pending/_SUCCESS"):
        _replace(spark, path)


def merge(path: str, batch: DataFrame, as_of: int, buckets: int = BUCKETS) -> list[int]:
    """Merge typed events in scope into the table at ``path``; the buckets that were rewritten.
    ``buckets`` counts for the first merge only."""
    spark, path = batch.sparkSession, path.rstrip("/")
    recover(spark, path)
    n = _layout(spark, path, buckets)
    before = _table(spark, path)
    rows = batch.withColumn("key", state.fact_key()).select(*[c for c in STATE.names if c != "bucket"])
    rows = rows.unionByName(before.filter(F.col("bucket") == WAITING).drop("bucket"))
    bucket = F.when(F.col("created_at") > as_of, WAITING).otherwise(F.pmod(F.xxhash64(*KEY), F.lit(n))).cast("int")
    rows = settle(rows.withColumn("bucket", bucket), "batch")
    counts = _counts(rows)
    touched = sorted(counts)
    if touched:
        old = before.filter(F.col("bucket").isin(touched) & (F.col("bucket") != WAITING))
        for b, n in _counts(old).items():
            counts[b] += n
        # One shuffle: rows dealt by bucket and slice are dealt by bucket, slice and key as well.
        newest = Window.partitionBy("bucket", "slice", *KEY, "waiting").orderBy(F.col("created_at").desc(), F.col("id").desc())
        rows = _dealt(old.unionByName(rows), counts).withColumn("rank", F.row_number().over(newest)).filter("rank = 1").select(*STATE.names)
        rows.sortWithinPartitions("bucket", *KEY).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pending")
        _replace(spark, path)
    forget(spark, rows)
    return touched


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The latest states as they are: what ``state.order_states`` and its like choose from."""
    recover(spark, path.rstrip("/"))
    return _table(spark, path.rstrip("/")).filter(F.col("bucket") != WAITING).drop("bucket", "key")


def into_kept(path: str, clock: Callable[[], int], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``live.follow``: each batch of typed events in scope goes into the table at ``path``; a
    batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        merge(path, batch, clock(), buckets)

    return write
