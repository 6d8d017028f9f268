"""The dependency graph every operator works on: files and the imports between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The smallest long.
LEAST = -(1 << 63)
FILE_COLUMNS = ("rev", "id", "path", "lang", "loc", "size", "n_exports", "n_functions", "n_classes")


@dataclass(frozen=True)
class DepGraph:
    """``files(rev, id, path, lang, loc, size, n_exports, n_functions, n_classes)`` and
    ``edges(src, dst)``, where a row of ``edges`` says that file ``src`` imports file ``dst``.

    ``id`` is unique over all revisions, so the iterative operators never look at ``rev``; the
    aggregates group by it. Edges are distinct, have no loops and no unknown ends.
    """

    files: DataFrame
    edges: DataFrame

    @staticmethod
    def of(files: DataFrame, edges: DataFrame, rev: str = "head", trusted: bool = False) -> DepGraph:
        """Normalise the inputs; ``trusted`` skips the clean-up of edges known to be clean."""
        if "rev" not in files.columns:
            files = files.withColumn("rev", F.lit(rev))
        files = files.select(*FILE_COLUMNS)
        edges = edges.select("src", "dst")
        if not trusted:
            ids = files.select("id")
            edges = (
                edges.where(F.col("src") != F.col("dst"))
                .distinct()
                .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
                .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
                .select("src", "dst")
            )
        return DepGraph(files, edges)


def stack_revisions(graphs: dict[str, DepGraph]) -> DepGraph:
    """Put several revisions into one graph, so that each operator runs once for all of them.

    Ids become ``(rev, node)``. Long ids stay long, which joins and shuffles cost far less: each takes the revision's number in its
    last place, and a null id, which is a node of its own revision too, the smallest numbers.
    """
    files, edges = None, None
    whole = all(g.files.schema["id"].dataType == T.LongType() for g in graphs.values())
    for number, (rev, graph) in enumerate(graphs.items()):

        def key(c: str, rev: str = rev, number: int = number) -> Column:
            if whole:
                return F.coalesce(F.col(c).cast("long") * len(graphs) + number, F.lit(LEAST + number))
            return F.struct(F.lit(rev).alias("rev"), F.col(c).alias("node"))

        f = graph.files.withColumn("rev", F.lit(rev)).withColumn("id", key("id"))
        e = graph.edges.select(key("src").alias("src"), key("dst").alias("dst"))
        files = f if files is None else files.unionByName(f)
        edges = e if edges is None else edges.unionByName(e)
    return DepGraph(files, edges)
