"""The self-describing export of a graph, and writers of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators import codegraph
from depweave.schema import FILE_EDGE, FILE_NODE

SCHEMA_VERSION = "1.0.0"
TOOL = "depweave"


def export_lines(records: DataFrame, root: str) -> DataFrame:
    """``(section, json)``: one line per file, edge, symbol and containment, and one header.

    The document of a large graph does not fit in one value, so it is a set of JSON lines; every
    line carries its section.
    """
    nodes = codegraph.file_nodes(records)
    edges = codegraph.file_edges(nodes)
    symbols, contains = codegraph.derived_symbols(nodes)
    stats = nodes.groupBy("rev").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.size("functions")).alias("functions"),
        F.sum(F.size("classes")).alias("classes"),
    )
    counted = edges.groupBy("rev").agg(F.count(F.lit(1)).alias("edges"))
    header = stats.join(F.broadcast(counted), "rev", "left").fillna(0, ["edges"])
    header = header.select(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(TOOL).alias("tool"), F.lit(root).alias("root"),
        F.struct("files", "edges", "functions", "classes").alias("stats"),
    )

    def lines(section: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))

    parts = [
        lines("header", header),
        lines("nodes", nodes.select(*FILE_NODE.fieldNames())),
        lines("edges", edges.select(*FILE_EDGE.fieldNames())),
        lines("symbols", symbols.drop("rev")),
        lines("contains", contains.drop("rev")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_export(records: DataFrame, root: str, target: str) -> None:
    """Write the export as JSON lines, one folder per section."""
    export_lines(records, root).write.mode("overwrite").partitionBy("section").text(target)


def save_code_graph(nodes: DataFrame, edges: DataFrame, target: str) -> None:
    nodes.write.mode("overwrite").partitionBy("rev", "type").parquet(f"{target}/nodes")
    edges.write.mode("overwrite").partitionBy("rev", "type").parquet(f"{target}/edges")


def load_code_graph(spark, target: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{target}/nodes"), spark.read.parquet(f"{target}/edges")


def save_result(df: DataFrame, target: str, form: str = "json") -> None:
    """Write any result in a format Spark writes."""
    df.write.mode("overwrite").format(form).save(target)


def save_store(files: DataFrame, edges: DataFrame, target: str) -> None:
    """Store a graph for queries by other sessions: files with their degrees, and the edges."""
    from depweave.operators.degrees import with_degrees

    with_degrees(files, edges).write.mode("overwrite").partitionBy("rev").parquet(f"{target}/files")
    edges.write.mode("overwrite").parquet(f"{target}/edges")


def load_store(spark, target: str) -> tuple[DataFrame, DataFrame]:
    """Files with degrees, and edges; a filter on ``rev`` reads only that revision's files."""
    return spark.read.parquet(f"{target}/files"), spark.read.parquet(f"{target}/edges")
