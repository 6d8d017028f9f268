"""Symbol search and the context of a change request."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import top_dir
from depweave.functions.tokens import STOP_WORDS
from depweave.operators.reach import induced_edges, neighbourhood

SYMBOL_LIMIT = 25
CONTEXT_FILES = 12


def request_keywords(text: str) -> list[str]:
    words = re.split("[^a-z0-9]+", text.lower())
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in STOP_WORDS))


def search_symbols(symbols: DataFrame, name: str, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """Symbols ``(id, name, ...)`` whose name contains the text.

    All hits are ranked before the cut: exact names, then shorter names, then by id.
    """
    text = name.strip().lower()
    lower = F.lower("name")
    hits = symbols.where(F.contains(lower, F.lit(text)) if text else F.lit(False))
    return hits.orderBy((lower == text).desc(), F.length("name"), "id").limit(limit)


def symbol_references(hits: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, reference)``: files that import the file of a hit."""
    ids = files.select(F.col("id").alias("file_id"), "path")
    at = hits.select("id", "path").join(ids, "path").select("id", F.col("file_id").alias("dst"))
    importing = ids.toDF("src", "reference")
    return edges.join(at, "dst").join(importing, "src").select("id", "reference")


def matching_files(analysis, symbols: DataFrame, words: list[str], limit: int = CONTEXT_FILES) -> DataFrame:
    """Best matching files with their degrees: two points per keyword in the path, one for a matching symbol."""
    path = F.lower("path")
    points = F.lit(0)
    for word in words:
        points = points + F.when(F.contains(path, F.lit(word)), 2).otherwise(0)
    matching = F.lit(False)
    for word in words:
        matching = matching | F.contains(F.lower("name"), F.lit(word))
    named = symbols.where(matching).select("path").distinct().withColumn("_named", F.lit(1))
    scored = analysis.degrees.join(named, "path", "left")
    scored = scored.withColumn("match", points + F.coalesce("_named", F.lit(0))).where("match > 0")
    return scored.orderBy(F.desc("match"), "path").limit(limit)


def related_files(analysis, best: DataFrame) -> DataFrame:
    """The :func:`matching_files` with their hotspot scores, which take the ranks of the whole graph."""
    return best.join(analysis.scores.select("id", F.col("score").alias("hotspot_score")), "id").select(
        "id",
        "path",
        "lang",
        "loc",
        "match",
        "hotspot_score",
        F.col("in_degree").alias("dependents"),
        F.col("out_degree").alias("imports"),
    )


def build_context(
    analysis,
    symbols: DataFrame,
    query: str,
    max_files: int = CONTEXT_FILES,
    churn: DataFrame | None = None,
    stability: DataFrame | None = None,
    parts: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """The parts of the graph a change request concerns, one DataFrame per part.

    ``parts`` names those that are wanted (all otherwise). Scores and summary take the whole graph's ranks and
    cycles, which the other parts do without.
    """
    best = matching_files(analysis, symbols, request_keywords(query) or ["\0"], max_files)
    paths = analysis.files.select("id", "path")

    @cache
    def related() -> DataFrame:
        return related_files(analysis, best)

    @cache
    def near() -> DataFrame:
        return neighbourhood(analysis.edges, best, "both", 1)

    def links() -> DataFrame:
        found = induced_edges(analysis.edges, near())
        return found.join(paths.toDF("src", "from"), "src").join(paths.toDF("dst", "to"), "dst").select("from", "to")

    def modules() -> DataFrame:
        return paths.join(near(), "id", "left_semi").select(top_dir(F.col("path")).alias("module")).distinct()

    def hotspots() -> DataFrame:
        return related().where("hotspot_score > 0").select("path", F.col("hotspot_score").alias("score"))

    def git_history() -> DataFrame:
        git = best.select("path")
        git = git.join(churn.select("path", "churn", "commits"), "path", "left") if churn is not None else git
        git = git.join(stability.select("path", "stability"), "path", "left") if stability is not None else git
        for name, default in (("churn", 0), ("commits", 0), ("stability", 100)):
            value = F.coalesce(name, F.lit(default)) if name in git.columns else F.lit(default)
            git = git.withColumn(name, value)
        return git.where("commits > 0")

    makers = {
        "related": related,
        "dependency_edges": links,
        "affected_modules": modules,
        "hotspots": hotspots,
        "summary": lambda: analysis.summary,
    }
    if churn is not None or stability is not None:
        makers["git"] = git_history
    return {name: make() for name, make in makers.items() if parts is None or name in parts}
