"""Tables written once and read by several later steps, in a folder that all executors share."""

from __future__ import annotations

import re
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh path in ``base``, or else in the folder that ``spark.checkpoint.dir`` names.

    Every executor must see that folder.  Where there is neither, a temporary folder serves if
    executors are threads of this process; on a cluster that would lose rows, so it is an error.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_ledgerlens_dir", None) or "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark._ledgerlens_dir = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's switch for dropping a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_switch, _writing = threading.Lock(), weakref.WeakKeyDictionary()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The session's switch on while at least one thread writes; then it is as it was before the
    first of them."""
    with _switch:
        n, before = _writing.get(spark, (0, None))
        if not n:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing[spark] = n + 1, before
    try:
        yield
    finally:
        with _switch:
            n, before = _writing[spark]
            _writing[spark] = n - 1, before
            if n == 1:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_kept: ContextVar[list[str] | None] = ContextVar("settled", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``settle`` writes inside are deleted at the end; so whatever is computed from
    them must have been collected or written by then."""
    made: list[str] = []
    token = _kept.set(made)
    try:
        yield
    finally:
        _kept.reset(token)
        for path in made:
            remove(spark, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it.  The write's shuffle files, which
    nothing reads after it, go at once; the table stays, unless this is within ``scratch``."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if (made := _kept.get()) is not None:
        made.append(path)
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete the files of a table that ``settle`` gave and no later step reads."""
    at = getattr(df, "_settled_at", None)
    if at is not None:
        remove(spark, at)


def _located(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, at: str) -> bool:
    fs, path = _located(spark, at)
    return fs.exists(path)


def remove(spark: SparkSession, at: str) -> None:
    fs, path = _located(spark, at)
    fs.delete(path, True)


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
