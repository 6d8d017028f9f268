"""Hotspot scores, God modules, unused files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.config import Thresholds
from depweave.functions.exprs import js_round, reasons
from depweave.functions.globs import matches_any

# What each signal adds to a hotspot score of at most one.
HOTSPOT_WEIGHTS = {
    "dependents": 0.30,
    "centrality": 0.25,
    "dependencies": 0.15,
    "loc": 0.15,
    "exports": 0.15,
}

# Reason given when a signal reaches half of its maximum, in order.
HOTSPOT_REASONS = {
    "dependents": "many dependents",
    "centrality": "high centrality",
    "dependencies": "many dependencies",
    "loc": "large file",
    "exports": "wide public API",
}
FALLBACK_REASON = "elevated combined risk"


def top_per_revision(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First ``k`` rows of every revision; Spark cuts each task to ``k`` rows before the shuffle."""
    over = Window.partitionBy("rev").orderBy(*order)
    return df.withColumn("_k", F.row_number().over(over)).where(F.col("_k") <= k).drop("_k")


def hotspot_scores(degrees: DataFrame, ranks: DataFrame) -> DataFrame:
    """Every file with its score from 0 to 100 and the reasons for it."""
    base = degrees.join(ranks.select("id", "pagerank"), "id").select(
        "rev",
        "id",
        "path",
        F.col("in_degree").alias("dependents"),
        F.col("pagerank").alias("centrality"),
        F.col("out_degree").alias("dependencies"),
        "loc",
        F.col("n_exports").alias("exports"),
    )
    floor = {name: F.lit(1e-9) if name == "centrality" else F.lit(1) for name in HOTSPOT_WEIGHTS}
    maxima = base.groupBy("rev").agg(
        *[F.greatest(F.max(name), floor[name]).alias(f"max_{name}") for name in HOTSPOT_WEIGHTS]
    )
    norm = {n: F.col(n) / F.col(f"max_{n}") for n in HOTSPOT_WEIGHTS}
    total = None
    for name, weight in HOTSPOT_WEIGHTS.items():
        term = norm[name] * F.lit(weight)
        total = term if total is None else total + term
    scored = base.join(F.broadcast(maxima), "rev").withColumn("raw_score", F.lit(100.0) * total)
    why = reasons(*[(F.round(norm[n], 12) >= 0.5, HOTSPOT_REASONS[n]) for n in HOTSPOT_WEIGHTS])
    scored = scored.withColumn("score", js_round(F.col("raw_score"))).withColumn(
        "reasons", F.when(F.size(why) > 0, why).otherwise(F.array(F.lit(FALLBACK_REASON)))
    )
    return scored.drop(*[f"max_{n}" for n in HOTSPOT_WEIGHTS])


def top_hotspots(scores: DataFrame, k: int = 10) -> DataFrame:
    return top_per_revision(scores.where("score > 0"), k, F.desc("score"), F.col("path"))


def most_central(ranks: DataFrame, files: DataFrame) -> DataFrame:
    """``(rev, path, pagerank)`` of the file with the highest rank, smallest path on a tie."""
    named = ranks.join(files.select("id", "path"), "id")
    best = named.groupBy("rev").agg(
        F.min_by(
            F.struct("path", "pagerank"), F.struct(-F.round("pagerank", 12), F.col("path"))
        ).alias("b")
    )
    return best.select("rev", "b.path", "b.pagerank")


def god_modules(degrees: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Files that exceed at least ``min_signals`` of five limits, with what they exceed."""
    signals = (
        ("loc", " LOC (> ", limits.loc),
        ("n_functions", " functions (> ", limits.functions),
        ("n_classes", " classes (> ", limits.classes),
        ("n_exports", " exports (> ", limits.exports),
        ("in_degree", " dependents (> ", limits.dependents),
    )
    why = reasons(
        *[
            (F.col(c) > limit, F.concat(F.col(c).cast("string"), F.lit(f"{text}{limit})")))
            for c, text, limit in signals
        ]
    )
    flagged = degrees.withColumn("reasons", why).where(F.size("reasons") >= limits.min_signals)
    return flagged.select(
        "rev", "id", "path", "reasons", "loc", "n_functions", "n_classes", "n_exports",
        F.col("in_degree").alias("dependents"),
    )


def unused_files(degrees: DataFrame, entry_globs: Iterable[str]) -> DataFrame:
    """Files that nothing imports and that are no entry point.

    Such a file cannot be reached from an entry point either, as its last step would be an
    import of it; no traversal is needed.
    """
    idle = degrees.where((F.col("in_degree") == 0) & ~matches_any(F.col("path"), entry_globs))
    why = reasons(
        (F.lit(True), "no dependents"),
        (F.col("n_exports") == 0, "no exports"),
        (F.col("out_degree") == 0, "no imports"),
        (F.lit(True), "unreachable from entry points"),
    )
    return idle.select("rev", "id", "path", why.alias("reasons"))
