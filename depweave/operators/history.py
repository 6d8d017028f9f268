"""Change history: per-file statistics, churn, stability, evolution, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.functions.exprs import churn_level, js_round, normalize_rename, top_dir
from depweave.operators.skew import global_rank, kth_smallest

RECENT_SHARE = 0.7


def file_history(changes: DataFrame, when: str = "ts") -> DataFrame:
    """Commits, lines, distinct authors and first and last change of every path."""
    return (
        changes.withColumn("path", normalize_rename(F.col("path")))
        .groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.sum("insertions").alias("insertions"),
            F.sum("deletions").alias("deletions"),
            F.countDistinct("author").alias("authors"),
            F.min(when).alias("first_date"),
            F.max(when).alias("last_date"),
        )
        .withColumn("churn", F.col("insertions") + F.col("deletions"))
    )


def _at_least_one(stats: DataFrame, name: str) -> Column:
    """Greatest value of a column, one if smaller, as a scalar subquery."""
    return stats.agg(F.greatest(F.lit(1), F.coalesce(F.max(name), F.lit(1)))).scalar()


def churn(stats: DataFrame) -> DataFrame:
    score = js_round(100 * F.col("churn") / _at_least_one(stats, "churn"))
    scored = stats.select("path", "commits", "churn", "authors", score.alias("score"))
    return scored.withColumn("level", churn_level(F.col("score")))


def stability(stats: DataFrame) -> DataFrame:
    """Inverse of volatility, which blends commits, authors and churn against their maxima."""
    volatility = (
        0.4 * (F.col("commits") / _at_least_one(stats, "commits"))
        + 0.3 * (F.col("authors") / _at_least_one(stats, "authors"))
        + 0.3 * (F.col("churn") / _at_least_one(stats, "churn"))
    )
    value = js_round(100 * (1 - volatility)).alias("stability")
    return stats.select("path", value, "commits", "authors", "churn")


def recent_cutoff(stats: DataFrame, share: float = RECENT_SHARE) -> Column | None:
    """First-change date at position ``floor(n * share)`` of the sorted dates, exactly."""
    dates = stats.where(F.col("first_date").isNotNull()).select("first_date")
    n = dates.count()
    if not n:
        return None
    k = int(n * share)
    kind = dates.schema["first_date"].dataType
    if isinstance(kind, T.StringType):
        ranked, _ = global_rank(dates, [F.col("first_date")])
        return F.lit(ranked.where(F.col("rank") == k).first()["first_date"])
    micros = dates.select(F.unix_micros(F.col("first_date").cast("timestamp")).alias("m"))
    return F.timestamp_micros(F.lit(kth_smallest(micros, "m", k))).cast(kind)


def churn_by_directory(stats: DataFrame) -> DataFrame:
    """Churn, files, earliest change and recently added files of every top-level folder."""
    cutoff = recent_cutoff(stats)
    recent = F.lit(False) if cutoff is None else F.col("first_date") >= cutoff
    return stats.groupBy(top_dir(F.col("path")).alias("module")).agg(
        F.sum("churn").alias("churn"),
        F.count(F.lit(1)).alias("files"),
        F.min("first_date").alias("oldest"),
        F.count_if(recent).alias("recent_files"),
    )


def evolution_insights(stats: DataFrame) -> DataFrame:
    """One row: what changes most, grows fastest, is most stable, is newest, is most volatile.

    Ties take the smallest name.
    """
    dirs = churn_by_directory(stats)
    name = F.col("module")
    age = F.coalesce(F.try_to_timestamp(F.col("oldest").cast("string")), F.timestamp_seconds(F.lit(0)))
    first = lambda cond, *key: F.min_by(F.when(cond, name), F.when(cond, F.struct(*key)))
    always = F.lit(True)
    best = dirs.agg(
        F.min_by(name, F.struct(-F.col("churn"), name)).alias("most_changed_module"),
        first(F.col("recent_files") > 0, -F.col("recent_files"), name).alias("fastest_growing_subsystem"),
        first(F.col("files") >= 2, F.col("churn") / F.col("files"), name).alias("most_stable_subsystem"),
        first(always, -F.unix_micros(age), name).alias("newest_layer"),
    )
    volatile = stats.agg(F.min_by("path", F.struct(-F.col("churn"), F.col("path")))).scalar()
    return best.withColumn("most_volatile_file", volatile)


def coupling_by_module(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``(module, coupling)``: edge ends per top-level folder, from degrees instead of edges."""
    from depweave.operators.degrees import endpoint_counts

    ends = endpoint_counts(edges).join(files.select("id", "path"), "id")
    return ends.groupBy(top_dir(F.col("path")).alias("module")).agg(
        F.sum(F.col("in_degree") + F.col("out_degree")).alias("coupling")
    )


def coupling_trends(start: DataFrame, end: DataFrame) -> DataFrame:
    """``(module, before, after, delta)`` over two coupling tables, zero where a side lacks one."""
    both = start.withColumnRenamed("coupling", "before").join(
        end.withColumnRenamed("coupling", "after"), "module", "full_outer"
    )
    both = both.fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def top_coupling_trends(trends: DataFrame, k: int = 5) -> DataFrame:
    up = trends.where("delta > 0").orderBy(F.desc("delta"), "module").limit(k)
    down = trends.where("delta < 0").orderBy("delta", "module").limit(k)
    return up.withColumn("direction", F.lit("increasing")).unionByName(
        down.withColumn("direction", F.lit("decreasing"))
    )


def sample_timeline(commits: DataFrame, steps: int, order: list[Column]) -> DataFrame:
    """Commits at ``steps`` evenly spaced positions, oldest to newest, both ends included.

    All commits are returned when there are no more than ``steps``; a single step takes the
    oldest. ``order`` sorts from the oldest to the newest.
    """
    ranked, n = global_rank(commits, order, "position")
    if n <= steps:
        return ranked
    gaps = max(1, steps - 1)
    wanted = sorted({(2 * i * (n - 1) + gaps) // (2 * gaps) for i in range(steps)})
    return ranked.where(F.col("position").isin(wanted))
