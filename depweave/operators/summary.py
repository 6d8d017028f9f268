"""Repository summary: counts, hubs, connectors, folders, externals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import top_dir
from depweave.operators.scores import top_per_revision


def graph_stats(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("rev").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("out_degree").alias("edges"),
        F.sum("n_functions").alias("functions"),
        F.sum("n_classes").alias("classes"),
        F.sum("loc").alias("total_loc"),
    )


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("rev", "lang").agg(F.count(F.lit(1)).alias("files"))


def hubs(degrees: DataFrame, k: int = 10) -> DataFrame:
    """Files most files depend on."""
    found = degrees.where("in_degree > 0")
    return top_per_revision(found, k, F.desc("in_degree"), F.col("path")).select("rev", "path", "in_degree")


def connectors(degrees: DataFrame, k: int = 10) -> DataFrame:
    """Files that import most files."""
    found = degrees.where("out_degree > 0")
    return top_per_revision(found, k, F.desc("out_degree"), F.col("path")).select("rev", "path", "out_degree")


def orphans(degrees: DataFrame) -> DataFrame:
    return degrees.where("degree = 0").select("rev", "path", "lang")


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("rev", top_dir(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def external_packages(imports: DataFrame, k: int = 15) -> DataFrame:
    """Most used external packages of ``imports(raw)``, counted per import statement."""
    counted = imports.groupBy(F.col("raw").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "name").limit(k)


def degree_stats(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("rev").agg(
        F.round(F.avg("degree"), 2).alias("avg_degree"), F.max("degree").alias("max_degree")
    )
