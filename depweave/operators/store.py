"""Queries of the graph store: search, lookup, neighbourhood, subgraph, target resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.operators.reach import induced_edges, neighbourhood


def _contains(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text))


def search_path(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Files whose path contains the query, in path order; none for a blank query."""
    text = query.strip().lower()
    hits = files.where(_contains(F.col("path"), text) if text else F.lit(False))
    return hits.orderBy("path").limit(limit)


def search_path_short_first(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """As :func:`search_path` with the shortest paths first; wildcards have no special meaning."""
    text = query.strip().lower()
    hits = files.where(_contains(F.col("path"), text) if text else F.lit(False))
    return hits.orderBy(F.length("path"), "path").limit(limit)


def search_map(map_nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Map nodes whose path or name contains the query: cut to the limit, then shortest first."""
    text = query.strip().lower()
    hit = _contains(F.col("path"), text) | _contains(F.col("name"), text) if text else F.lit(False)
    return map_nodes.where(hit).orderBy("id").limit(limit).orderBy(F.length("path"), "id")


def filter_map(
    map_nodes: DataFrame,
    types: list[str],
    languages: list[str] | None = None,
    directory: str | None = None,
    min_degree: int = 0,
) -> DataFrame:
    """Map nodes that pass the type, language, folder and degree filters.

    A language filter lets directories through and drops other nodes without a language.
    """
    keep = F.col("type").isin(*types) & (F.col("degree") >= min_degree)
    if languages is not None:
        keep &= F.when(F.col("language").isNotNull(), F.col("language").isin(*languages)).otherwise(
            F.col("type") == "Directory"
        )
    if directory:
        keep &= under_folder(F.col("path"), directory)
    return map_nodes.where(keep)


def under_folder(path: Column, folder: str) -> Column:
    prefix = folder.removesuffix("/")
    return (path == prefix) | path.startswith(prefix + "/")


def file_detail(files: DataFrame, file_id) -> DataFrame:
    return files.where(F.col("id") == F.lit(file_id))


def subgraph(
    degrees: DataFrame,
    edges: DataFrame,
    folder: str | None = None,
    min_degree: int | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Files that pass the filters, and the edges among them; degrees are those of the whole graph.

    A folder alone needs no degrees: plain files do for ``degrees`` then.
    """
    nodes = degrees
    if folder:
        nodes = nodes.where(under_folder(F.col("path"), folder))
    if min_degree is not None:
        nodes = nodes.where(F.col("degree") >= min_degree)
    if limit is not None:
        nodes = nodes.orderBy(F.desc("degree"), "path").limit(limit)
    return nodes, induced_edges(edges, nodes)


def neighbors(
    files: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Files within ``depth`` hops of the seeds, seeds included, and the edges among them."""
    known = seeds.select("id").join(files.select("id"), "id", "left_semi")
    ids = neighbourhood(edges, known, direction, depth)
    return files.join(ids, "id", "left_semi"), induced_edges(edges, ids)


def resolve_target(files: DataFrame, target: str) -> DataFrame:
    """One row for the file a target text means: by id, by path, or by a path suffix."""
    text = target.removeprefix("file:").replace("\\", "/").removeprefix("./")
    path = F.col("path")
    rank = (
        F.when(F.col("id").cast("string") == target, 0)
        .when(path == text, 1)
        .when(path.endswith("/" + text) | F.endswith(F.lit(text), F.concat(F.lit("/"), path)), 2)
    )
    hits = files.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = hits.agg(F.min_by(F.struct("id", "path"), F.struct("_rank", "path")).alias("t"))
    return best.where(F.col("t").isNotNull()).select("t.id", "t.path")


def search_imports(files: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id, relation, path)``: what the seeds import and what imports them."""
    ids = seeds.select("id")
    out = edges.join(ids.toDF("src"), "src", "left_semi").select(
        F.col("src").alias("id"), F.lit("dependency").alias("relation"), F.col("dst").alias("other")
    )
    back = edges.join(ids.toDF("dst"), "dst", "left_semi").select(
        F.col("dst").alias("id"), F.lit("dependent").alias("relation"), F.col("src").alias("other")
    )
    named = files.select(F.col("id").alias("other"), "path")
    return out.unionByName(back).join(named, "other").select("id", "relation", "path")
