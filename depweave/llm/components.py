"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import keep


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) of each node of an edge ``a``, ``b``.

    Rounds grow with the logarithm of the nodes. Each round is written, so its input is never
    computed twice. The minimum of a node is an aggregate with partial sums, and it is joined back
    as a table of unique keys: a hub is hot on one side only, where AQE splits it.
    """
    edges = keep(
        edges.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
    )
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        large = keep(large.where(F.col("a") != F.col("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where(F.col("a") != F.col("b")).unionByName(least.withColumnRenamed("m", "b"))
        edges = keep(small.distinct())
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
