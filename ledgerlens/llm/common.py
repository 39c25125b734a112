"""Helpers shared by the corpus operators: shared storage, sizes and word rules."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.storage import forget, settle, shared_dir

__all__ = ["arrow_rows", "forget", "held", "likely", "parts", "settle", "shared_dir", "ship", "words"]

#: Bits of a filter for each wanted row, and at most (2^20 words of 64 bits).
BITS_EACH, FILTER_BITS = 16, 1 << 26
#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


#: What this Python worker keeps between the tasks of one stage: one entry at most.
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, kept by this worker under ``key`` until a stage asks for another one.

    Workers outlive their stages, so what a former stage kept (caches, dictionaries) is dropped
    first and its memory given back to the machine.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
        _HELD[key] = make()
    return _HELD[key]


def parts(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` bytes, at least those of the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def likely(rows: DataFrame, wanted: DataFrame, *keys: str, flag: str | None = None) -> DataFrame:
    """The ``rows`` whose keys may be among those of ``wanted``, so that rows that no join needs
    are not shuffled; with ``flag`` all rows, and that column tells.

    The filter is a table of hashed bits in words of 64, ``BITS_EACH`` a wanted row: at most
    2^20 rows of 16 bytes, so it may be broadcast.  It lets no key go.  Where ``wanted`` needs
    more than that, all rows pass and the join alone decides.
    """
    n = wanted.count()
    if n * BITS_EACH > FILTER_BITS:
        return rows.withColumn(flag, F.lit(True)) if flag else rows
    bits = max(64, min(1 << (n * BITS_EACH).bit_length(), FILTER_BITS))
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    masks = wanted.select(word.alias("__word"), one.alias("one")).groupBy("__word").agg(F.bit_or("one").alias("__mask"))
    met = rows.join(F.broadcast(masks), word == F.col("__word"), "left" if flag else "inner")
    hit = F.getbit("__mask", bit) == 1
    if flag:
        return met.withColumn(flag, F.coalesce(hit, F.lit(False))).select(*rows.columns)
    return met.filter(hit).select(*rows.columns)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context, wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_ledgerlens_shipped", False):
        package = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as d:
            made = Path(d, "build", package.name)
            shutil.copytree(package, made, ignore=shutil.ignore_patterns("__pycache__"))
            # The file server keeps its own copy only where it is told to; so the zip stays for the session.
            out = tempfile.mkdtemp(prefix="ledgerlens-package-")
            context.addPyFile(shutil.make_archive(f"{out}/{package.name}", "zip", made.parent))
        context._ledgerlens_shipped = True


def arrow_rows(df: DataFrame, run: Callable, schema: str, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the workers.

    ``run`` asks for what it keeps between tasks by ``held`` (``keeps``); a stage that keeps
    nothing drops what a former one left.
    """
    ship(df.sparkSession)

    def task(batches: Iterator) -> Iterator:
        if not keeps:
            held(None, lambda: None)
        yield from run(batches)

    return df.mapInArrow(task, schema)
