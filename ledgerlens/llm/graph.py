"""Connected components of a link table, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import forget, settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the component's least node.

    Large-star and small-star rounds alternate: each node's larger, then its smaller
    neighbours are hung below the least node it sees, until no link changes.  Every round is
    written to the shared folder, so a lost executor costs one round at most.  The least
    neighbour is a partial aggregate and the join back may be split where a node has very
    many links, so no task needs all links of a node.  Links with a null end and links of a
    node to itself are none; repeated ones count once.
    """
    spark = links.sparkSession
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.max(F.xxhash64("v", "u")).alias("m")).first()
        if mark == seen:
            break
        seen = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.filter("u <> v").distinct(), "links")
        forget(spark, edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = settle(small.filter("u <> v").distinct(), "links")
        forget(spark, large)
    # Every link now runs from a node to its root.
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
