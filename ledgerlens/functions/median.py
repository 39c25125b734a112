"""Exact medians of whole numbers whose groups may be of any size, from histograms that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_bin(value: Column) -> Column:
    """A number's bin: 64 to a doubling, at most some 4,200 of either sign; bins are in order."""
    number = value.cast("double")
    return (F.signum(number) * F.floor(F.log2(F.abs(number) + 1) * 64)).cast("int")


def exact_medians(df: DataFrame, keys: list[str], value: str, out: str, whole: bool = True) -> DataFrame:
    """``keys`` and the median of whole numbers: the middle one, or the middle of the two middle
    ones, rounded down if ``whole``.

    ``percentile`` keeps a group's distinct values in one task's memory.  Here values are
    counted first (partial aggregation), then ranked in two steps: over the logarithmic bins of
    a group, then within the bins that hold the middle ranks.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n")).withColumn("__bin", log_bin(F.col(value)))
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__n"))
    return _resolved(counts.join(_middle(bins, keys), [*keys, "__bin"]), keys, value, out, whole)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, bin and count: what medians over any union of ``keys`` begin with.  Histograms of
    new days are appended to those of old ones."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*keys, log_bin(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))


def medians_of(bins: DataFrame, df: DataFrame, keys: list[str], value: str, out: str, whole: bool = True) -> DataFrame:
    """``exact_medians`` of ``df`` by its ``histogram``: bins are summed over what is not among
    ``keys`` (days, say), and only rows in the bins that hold a middle rank are counted.
    ``bins`` and ``df`` must be of the same range."""
    sums = bins.groupBy(*keys, F.col("bin").alias("__bin")).agg(F.sum("n").alias("__n"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, log_bin(F.col(value)).alias("__bin"))
    counts = rows.join(_middle(sums, keys), [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__low", "__high", value).agg(F.count("*").alias("__n"))
    return _resolved(counts, keys, value, out, whole)


def _middle(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The bins that hold a middle rank, the ranks, and how many values are below the bin."""
    by = Window.partitionBy(*keys)
    upto = F.sum("__n").over(by.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = bins.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(by))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2)
    ranked = ranked.select(*keys, "__bin", (F.col("__upto") - F.col("__n")).alias("__before"), "__upto", low.alias("__low"), high.alias("__high"))
    return ranked.filter("(__before < __low and __low <= __upto) or (__before < __high and __high <= __upto)").drop("__upto")


def _resolved(found: DataFrame, keys: list[str], value: str, out: str, whole: bool) -> DataFrame:
    """The medians, of counted values in the middle bins."""
    within = F.sum("__n").over(Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    found = found.withColumn("__to", within).withColumn("__from", F.col("__to") - F.col("__n"))
    hit = lambda r: F.when((F.col("__from") < F.col(r)) & (F.col(r) <= F.col("__to")), F.col(value))
    middle = (F.max(hit("__low")) + F.max(hit("__high"))) / 2
    return found.groupBy(*keys).agg((F.floor(middle) if whole else middle.cast("double")).alias(out))
