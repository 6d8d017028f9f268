"""Health score, its trend, and the bounded series of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.exprs import clamp_score, grade, js_round

KEPT_SNAPSHOTS = 100


def health_inputs(analysis, violations: DataFrame) -> DataFrame:
    """One row of counts and averages per revision."""
    base = analysis.degrees.groupBy("rev").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("out_degree").alias("edges"),
        F.avg("loc").alias("avg_loc"),
        F.avg("n_functions").alias("avg_functions"),
    )
    counts = (
        analysis.cycles.groupBy("rev").agg(
            F.count(F.lit(1)).alias("cycles"), F.sum("length").alias("cycle_files")
        ),
        analysis.god_modules.groupBy("rev").agg(F.count(F.lit(1)).alias("god_modules")),
        analysis.unused.groupBy("rev").agg(F.count(F.lit(1)).alias("unused")),
        analysis.hotspots.groupBy("rev").agg(F.avg("score").alias("hotspot_mean")),
        violations.groupBy("rev").agg(
            F.count_if(F.col("severity") == "error").alias("errors"),
            F.count_if(F.col("severity") == "warning").alias("warnings"),
        ),
    )
    for part in counts:  # every part has one row per revision
        base = base.join(F.broadcast(part), "rev", "left")
    zero = ("cycles", "cycle_files", "god_modules", "unused", "hotspot_mean", "errors", "warnings")
    return base.fillna(0, list(zero))


def volatile_share(files: DataFrame, stability: DataFrame, limit: int = 40) -> DataFrame:
    """``(rev, low_share)``: share of the files with a known stability that are below ``limit``."""
    known = files.join(stability.select("path", "stability"), "path")
    return known.groupBy("rev").agg(
        (F.count_if(F.col("stability") < limit) / F.count(F.lit(1))).alias("low_share")
    )


def _at_least_zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def health_scores(inputs: DataFrame, volatile: DataFrame | None = None) -> DataFrame:
    """Overall score, five category scores, grade and the factors behind them.

    Stability follows from cycles and hotspots, or, when ``volatile(rev, low_share)`` is given,
    from the share of volatile files.
    """
    c = F.col
    df = inputs.withColumn("degree_mean", 2 * c("edges") / c("files"))
    df = df.withColumn("cycle_ratio", c("cycle_files") / c("files"))
    penalty = F.least(F.lit(100), c("errors") * 8 + c("warnings") * 2)
    if volatile is None:
        steady = clamp_score(100 - c("cycle_ratio") * 100 - c("hotspot_mean") * 0.3)
    else:
        df = df.join(F.broadcast(volatile), "rev", "left").fillna(0, ["low_share"])
        steady = clamp_score(100 - c("low_share") * 120)
    df = (
        df.withColumn("stability", steady)
        .withColumn("coupling", clamp_score(100 - _at_least_zero(c("degree_mean") - 2) * 14))
        .withColumn(
            "complexity",
            clamp_score(
                100
                - _at_least_zero(c("avg_loc") - 120) / 8
                - _at_least_zero(c("avg_functions") - 6) * 3
                - c("god_modules") / c("files") * 200
            ),
        )
        .withColumn(
            "modularity",
            clamp_score(
                100
                - c("cycle_ratio") * 150
                - c("unused") / c("files") * 80
                - F.when(c("cycles") > 0, 8).otherwise(0)
            ),
        )
    )
    df = df.withColumn(
        "maintainability",
        clamp_score(0.4 * c("complexity") + 0.3 * (100 - c("hotspot_mean")) + 0.3 * (100 - penalty)),
    )
    df = df.withColumn(
        "overall",
        clamp_score(
            0.25 * c("maintainability")
            + 0.2 * c("modularity")
            + 0.2 * c("coupling")
            + 0.2 * c("stability")
            + 0.15 * c("complexity")
            - F.least(F.lit(30), c("errors") * 3)
        ),
    )
    return df.select(
        "rev",
        "overall",
        grade(c("overall")).alias("grade"),
        "maintainability",
        "stability",
        "modularity",
        "coupling",
        "complexity",
        "files",
        "edges",
        F.round("degree_mean", 2).alias("avg_degree"),
        "cycles",
        "cycle_files",
        "god_modules",
        "unused",
        js_round(c("hotspot_mean")).alias("hotspot_avg"),
        js_round(c("avg_loc")).alias("avg_loc"),
        F.round("avg_functions", 1).alias("avg_functions"),
        "errors",
        "warnings",
    )


def trend(snapshots: DataFrame) -> DataFrame:
    """Each health snapshot with its direction and its change against the snapshot before.

    The series is bounded by :func:`retained` to a hundred rows, so one window holds it.
    """
    over = Window.orderBy("timestamp")
    before = lambda name: F.lag(name).over(over)
    delta = F.col("overall") - before("overall")
    return snapshots.select(
        "*",
        F.when(delta.isNull(), "first-scan")
        .when(delta > 2, "improving")
        .when(delta < -2, "declining")
        .otherwise("stable")
        .alias("direction"),
        F.coalesce(delta, F.lit(0)).alias("health_delta"),
        F.coalesce(F.round(F.col("avg_degree") - before("avg_degree"), 2), F.lit(0.0)).alias("coupling_delta"),
        F.coalesce(F.col("cycles") - before("cycles"), F.lit(0)).alias("cycles_delta"),
        F.coalesce(F.col("hotspot_avg") - before("hotspot_avg"), F.lit(0)).alias("hotspots_delta"),
        F.coalesce(F.col("god_modules") - before("god_modules"), F.lit(0)).alias("god_modules_delta"),
    )


def retained(snapshots: DataFrame, keep: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` snapshots."""
    return snapshots.orderBy(F.desc("timestamp")).limit(keep)


def series_range(snapshots: DataFrame) -> DataFrame:
    """``(measure, low, high)`` of every score over a series of snapshots."""
    names = ("overall", "maintainability", "stability", "modularity", "coupling", "complexity")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in names]))
    return snapshots.select(pairs.alias("m")).groupBy("m.measure").agg(F.min("m.v").alias("low"), F.max("m.v").alias("high"))
