"""Degrees of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def endpoint_counts(edges: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree)`` of nodes with an edge, in one shuffle of partial counts."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def with_degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with ``in_degree``, ``out_degree`` and ``degree``; zero where no edge touches them."""
    return (
        files.join(endpoint_counts(edges), "id", "left")
        .withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
        .withColumn("out_degree", F.coalesce("out_degree", F.lit(0)).cast("long"))
        .withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    )
