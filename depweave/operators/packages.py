"""Workspace packages: which package a file belongs to, and what packages depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import dirname
from depweave.operators.skew import lookup

NO_PACKAGE = "(root)"


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Add ``package`` to files: the longest of ``packages(package)`` that holds the path.

    Packages are looked up once per folder, by the folders above it.
    """
    folder = dirname(F.col("path"))
    parts = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = files.select(folder.alias("folder")).distinct()
    found = folders.select("folder", F.explode(chain).alias("package")).join(packages, "package")
    longest = found.groupBy("folder").agg(F.max_by("package", F.length("package")).alias("package"))
    placed = lookup(files.withColumn("folder", folder), longest, "folder", how="left").drop("folder")
    return placed.withColumn("package", F.coalesce("package", F.lit(NO_PACKAGE)))


def package_dependencies(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``(rev, package, depends_on)`` over imports that cross packages."""
    ends = placed.select("id", "rev", "package")
    rows = edges.count()
    crossed = lookup(edges, ends.toDF("src", "rev", "package"), "src", rows=rows)
    crossed = lookup(crossed, ends.drop("rev").toDF("dst", "depends_on"), "dst", rows=rows)
    return crossed.where(F.col("package") != F.col("depends_on")).select("rev", "package", "depends_on").distinct()


def package_rollup(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Files, lines and sorted dependencies of every package that has files."""
    totals = placed.groupBy("rev", "package").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    needs = package_dependencies(placed, edges).groupBy("rev", "package")
    needs = needs.agg(F.sort_array(F.collect_set("depends_on")).alias("depends_on"))
    none = F.array().cast("array<string>")
    return totals.join(needs, ["rev", "package"], "left").withColumn("depends_on", F.coalesce("depends_on", none))
