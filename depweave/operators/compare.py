"""Comparison of two revisions held in one graph under the names ``base`` and ``head``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.history import coupling_trends, top_coupling_trends
from depweave.operators.skew import global_rank
from depweave.functions.exprs import top_dir
from depweave.session import cut


def side(df: DataFrame, rev: str) -> DataFrame:
    return df.where(F.col("rev") == rev).drop("rev")


def keyed_except(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side whose key the right side lacks; duplicates on the left are kept."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def dependency_changes(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """``(change, from, to)`` for imports added or removed between the revisions."""
    pairs = analysis.edge_paths.select("rev", F.col("from_path").alias("from"), F.col("to_path").alias("to"))
    sides = pairs.groupBy("from", "to").agg(
        F.max(F.col("rev") == base).alias("b"), F.max(F.col("rev") == head).alias("h")
    )
    changed = sides.where(F.col("b") != F.col("h"))
    return changed.select(F.when(F.col("h"), "added").otherwise("removed").alias("change"), "from", "to")


def cycle_changes(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """Cycles of one revision whose set of files is no cycle of the other."""
    signed = analysis.cycle_signatures
    keys = ["length", "first_file", "sig_a", "sig_b"]
    new = keyed_except(side(signed, head), side(signed, base), keys)
    gone = keyed_except(side(signed, base), side(signed, head), keys)
    both = new.withColumn("change", F.lit("new")).unionByName(gone.withColumn("change", F.lit("resolved")))
    return both.select("change", "comp", "length", "first_file")


def cycle_change_members(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """``(change, first_file, path)``: the files of every new or resolved cycle."""
    changed = cycle_changes(analysis, base, head).select("change", "comp", "first_file")
    return changed.join(analysis.cycle_members, "comp").select("change", "first_file", "path")


def violation_changes(analysis, base: str = "base", head: str = "head") -> DataFrame:
    keys = ["rule", "file", "detail"]
    found = analysis.violations.select("rev", "rule", "severity", "file", "detail")
    new = keyed_except(side(found, head), side(found, base), keys)
    gone = keyed_except(side(found, base), side(found, head), keys)
    return new.withColumn("change", F.lit("new")).unionByName(gone.withColumn("change", F.lit("resolved")))


def hotspot_changes(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """``(path, before, after, is_new, worsened)`` over the two top lists; absent counts as 0."""
    top = analysis.hotspots.select("rev", "path", "score")
    before = side(top, base).withColumnRenamed("score", "before")
    after = side(top, head).withColumnRenamed("score", "after")
    both = after.join(before, "path", "full_outer")
    listed = F.col("after").isNotNull()
    return both.select(
        "path",
        F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("after", F.lit(0)).alias("after"),
        (listed & F.col("before").isNull()).alias("is_new"),
        (listed & (F.coalesce("before", F.lit(0)) < F.col("after"))).alias("worsened"),
    )


def score_changes(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """Files whose hotspot score differs, over all files and not only the top lists."""
    sides = analysis.scores.groupBy("path").agg(
        F.coalesce(F.max(F.when(F.col("rev") == base, F.col("score"))), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.when(F.col("rev") == head, F.col("score"))), F.lit(0)).alias("after"),
    )
    return sides.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def coupling_changes(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """``(path, before, after, delta)`` of files whose degree differs."""
    sides = analysis.coupling.groupBy("path").agg(
        F.sum(F.when(F.col("rev") == base, F.col("degree")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("rev") == head, F.col("degree")).otherwise(0)).alias("after"),
        F.max(F.col("rev") == head).alias("in_head"),
    )
    return sides.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def coupling_increased(analysis, base: str = "base", head: str = "head", k: int = 20) -> DataFrame:
    grown = coupling_changes(analysis, base, head).where("in_head and delta > 0")
    return grown.orderBy(F.desc("delta"), "path").limit(k).select("path", "before", "after")


def module_coupling_trends(analysis, base: str = "base", head: str = "head", k: int = 5) -> DataFrame:
    module = top_dir(F.col("path")).alias("module")
    coupled = analysis.coupling.where("degree > 0").groupBy("rev", module).agg(F.sum("degree").alias("coupling"))
    return top_coupling_trends(coupling_trends(side(coupled, base), side(coupled, head)), k)


def coupling_delta(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """One row: growth of the total coupling."""
    return analysis.coupling.agg(
        F.sum(
            F.when(F.col("rev") == head, F.col("degree")).when(F.col("rev") == base, -F.col("degree")).otherwise(0)
        ).alias("blast_radius_increase")
    )


def file_changes(files: DataFrame, base: str = "base", head: str = "head") -> DataFrame:
    """``(change, path)`` for files that only one revision has."""
    sides = files.groupBy("path").agg(
        F.max(F.col("rev") == base).alias("b"), F.max(F.col("rev") == head).alias("h")
    )
    changed = sides.where(F.col("b") != F.col("h"))
    return changed.select(F.when(F.col("h"), "added").otherwise("removed").alias("change"), "path")


def _ranked(files: DataFrame) -> DataFrame:
    """``(key, rank, path)``: place of each path among those of equal content, for groups of any size."""
    placed, _ = global_rank(files.select("key", "path"), [F.col("key"), F.col("path")], "no")
    first = placed.groupBy("key").agg(F.min("no").alias("first"))
    return placed.join(first, "key").select("key", (F.col("no") - F.col("first")).alias("rank"), "path")


def tree_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(status, path, old_path)`` between two listed trees ``(path, key)``, where ``key`` tells the content.

    A path of both trees is M (modified) if its content differs. Of the other paths, those with equal
    content are paired one to one in the order of their paths and are R (renamed); what is left is A (added) or D (deleted).
    A null path takes no part; files without a key (unknown content) are never renamed.
    """
    base, head = (t.where("path IS NOT NULL").select("path", "key").dropDuplicates(["path"]) for t in (base, head))
    both = base.join(head.withColumnRenamed("key", "new"), "path")
    modified = both.where(~F.col("key").eqNullSafe(F.col("new"))).select(F.lit("M").alias("status"), "path", F.lit(None).cast("string").alias("old_path"))
    gone, come = base.join(head, "path", "left_anti"), head.join(base, "path", "left_anti")
    old = _ranked(gone.where("key IS NOT NULL")).withColumnRenamed("path", "old_path")
    moved = _ranked(come.where("key IS NOT NULL")).join(old, ["key", "rank"])
    moved = cut(moved.select(F.lit("R").alias("status"), "path", "old_path"))
    none = F.lit(None).cast("string").alias("old_path")
    added = come.join(moved, "path", "left_anti").select(F.lit("A").alias("status"), "path", none)
    deleted = gone.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").select(F.lit("D").alias("status"), "path", none)
    return modified.unionByName(moved).unionByName(added).unionByName(deleted)


def architecture_diff(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """Everything that differs, as rows ``(kind, subject, other, before, after)``."""
    none = F.lit(None).cast("long")
    as_rows = lambda df, kind, subject, other=None, before=none, after=none: df.select(
        (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"),
        F.col(subject).alias("subject"),
        (F.lit(None).cast("string") if other is None else F.col(other)).alias("other"),
        before.alias("before"),
        after.alias("after"),
    )
    numbers = {"before": F.col("before").cast("long"), "after": F.col("after").cast("long")}
    parts = [
        as_rows(file_changes(analysis.files, base, head), F.concat("change", F.lit(" file")), "path"),
        as_rows(
            dependency_changes(analysis, base, head), F.concat("change", F.lit(" dependency")), "from", "to"
        ),
        as_rows(
            cycle_change_members(analysis, base, head), F.concat("change", F.lit(" cycle")), "first_file", "path"
        ),
        as_rows(score_changes(analysis, base, head), "hotspot", "path", **numbers),
        as_rows(coupling_changes(analysis, base, head), "coupling", "path", **numbers),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def branch_report(analysis, base: str = "base", head: str = "head") -> DataFrame:
    """One row: both healths and grades, their difference, coupling growth and the gate on head."""
    scored = analysis.health.select("rev", "overall", "grade")
    one = scored.agg(
        F.max(F.when(F.col("rev") == base, F.col("overall"))).alias("health_before"),
        F.max(F.when(F.col("rev") == head, F.col("overall"))).alias("health_after"),
        F.max(F.when(F.col("rev") == base, F.col("grade"))).alias("grade_before"),
        F.max(F.when(F.col("rev") == head, F.col("grade"))).alias("grade_after"),
    )
    gate = analysis.gate().where(F.col("rev") == head).select("passes").scalar()
    return (
        one.withColumn("health_delta", F.col("health_after") - F.col("health_before"))
        .withColumn("blast_radius_increase", coupling_delta(analysis, base, head).scalar())
        .withColumn("passes", gate)
    )
