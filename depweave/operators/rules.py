"""Architecture rules: thresholds, cycles, forbidden imports, layers, and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.config import AnalysisConfig, ForbiddenImport, GovernanceConfig, Limits
from depweave.functions.globs import glob_regex, matches_any


VIOLATION_COLUMNS = ("rev", "rule", "severity", "file", "detail")


def layer_of(path: Column, config: AnalysisConfig) -> Column:
    """Name of the first layer, in configured order, one of whose globs matches."""
    layer = F.lit(None).cast("string")
    for item in reversed(config.layers):
        layer = F.when(matches_any(path, item.patterns), F.lit(item.name)).otherwise(layer)
    return layer


def layer_violations(edge_paths: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Imports from a layer into a layer it must not import."""
    banned = sorted({(r.source, to) for r in config.rules for to in r.cannot_import})
    layered = edge_paths.select(
        "rev",
        F.col("from_path").alias("from"),
        F.col("to_path").alias("to"),
        layer_of(F.col("from_path"), config).alias("from_layer"),
        layer_of(F.col("to_path"), config).alias("to_layer"),
    )
    if not banned or not config.layers:
        hit = F.lit(False)
    else:
        hit = reduce(
            lambda a, b: a | b,
            [(F.col("from_layer") == a) & (F.col("to_layer") == b) for a, b in banned],
        )
    return layered.where(hit).withColumn(
        "rule", F.concat("from_layer", F.lit(" cannot import "), "to_layer")
    )


def layer_ends(path: Column, config: AnalysisConfig) -> tuple[Column, Column]:
    """Whether a path lies in a layer with a rule, and whether in one that a rule names; what :func:`layer_violations` can hit."""
    sources = [r.source for r in config.rules]
    targets = [to for r in config.rules for to in r.cannot_import]
    return layer_of(path, config).isin(sources), layer_of(path, config).isin(targets)


def forbidden_ends(path: Column, rules: tuple[ForbiddenImport, ...]) -> tuple[Column, Column]:
    """Whether a path fits the source of some rule, and whether the target of some."""
    return matches_any(path, [r.source for r in rules]), matches_any(path, [r.target for r in rules])


def forbidden_imports(edge_paths: DataFrame, rules: tuple[ForbiddenImport, ...]) -> DataFrame:
    """One row per import and per rule it breaks; rules are folded into one pass over the edges."""
    found = []
    for rule in rules:
        hit = F.col("from_path").rlike(glob_regex(rule.source)) & F.col("to_path").rlike(
            glob_regex(rule.target)
        )
        text = F.lit(rule.message)
        if rule.message is None:
            text = F.concat("from_path", F.lit(" must not import "), "to_path")
        found.append(F.when(hit, text))
    texts = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return edge_paths.select(
        "rev", F.col("from_path").alias("file"), "to_path", F.explode(texts).alias("detail")
    )


def threshold_violations(degrees: DataFrame, limits: Limits) -> DataFrame:
    """Warnings about single files, except for the depth rule."""
    checks = (
        ("maxImports", F.col("out_degree"), "", " imports (> ", limits.max_imports),
        ("maxFanIn", F.col("in_degree"), "", " dependents (> ", limits.max_fan_in),
        ("maxCoupling", F.col("degree"), "coupling ", " (> ", limits.max_coupling),
        ("maxFunctionCount", F.col("n_functions"), "", " functions (> ", limits.max_function_count),
        ("maxFileSize", F.col("loc"), "", " LOC (> ", limits.max_file_size),
    )
    found = [
        F.when(
            value > limit,
            F.struct(
                F.lit(rule).alias("rule"),
                F.concat(F.lit(head), value.cast("string"), F.lit(f"{tail}{limit})")).alias("detail"),
            ),
        )
        for rule, value, head, tail, limit in checks
    ]
    hits = degrees.select("rev", F.col("path").alias("file"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return hits.select("rev", "v.rule", F.lit("warning").alias("severity"), "file", "v.detail")


def depth_violations(depths: DataFrame, files: DataFrame, limits: Limits) -> DataFrame:
    limit = limits.max_dependency_depth
    deep = depths.where(F.col("depth") > limit).join(files.select("id", "rev", "path"), "id")
    text = F.concat(F.lit("dependency depth "), F.col("depth").cast("string"), F.lit(f" (> {limit})"))
    return deep.select(
        "rev",
        F.lit("maxDependencyDepth").alias("rule"),
        F.lit("warning").alias("severity"),
        F.col("path").alias("file"),
        text.alias("detail"),
    )


def cycle_violations(cycles: DataFrame, signatures: DataFrame) -> DataFrame:
    """One error per cycle. Its text has the size, the first file and the signature of the members.

    Cycles of every size have the same shape of text, and it changes when a single member does;
    the members are rows of ``cycle_members``.
    """
    signed = cycles.join(signatures.select("comp", "sig_a", "sig_b"), "comp")
    text = F.format_string(
        "cycle (%s): %d files from %s, signature %s/%s", "severity", "length", "first_file",
        F.col("sig_a").cast("string"), F.col("sig_b").cast("string"),
    )
    return signed.select(
        "rev",
        F.lit("noCircularDependencies").alias("rule"),
        F.lit("error").alias("severity"),
        F.col("first_file").alias("file"),
        text.alias("detail"),
    )


def evaluate_rules(analysis, config: GovernanceConfig) -> DataFrame:
    """All violations ``(rev, rule, severity, file, detail)`` of an analysed graph."""
    limits = config.rules
    parts = [
        threshold_violations(analysis.degrees, limits),
        depth_violations(analysis.deep_files(limits.max_dependency_depth), analysis.files, limits),
    ]
    if not limits.allow_circular_dependencies:
        parts.append(cycle_violations(analysis.cycles, analysis.cycle_signatures))
    if config.forbidden_imports:
        banned = analysis.forbidden_imports
        parts.append(
            banned.select(
                "rev", F.lit("forbiddenImport").alias("rule"), F.lit("error").alias("severity"), "file", "detail"
            )
        )
    if analysis.config.layers and analysis.config.rules:
        layered = analysis.layer_violations
        text = F.concat(F.col("rule"), F.lit(": "), F.col("from"), F.lit(" → "), F.col("to"))
        parts.append(
            layered.select(
                "rev",
                F.lit("layerViolation").alias("rule"),
                F.lit("error").alias("severity"),
                F.col("from").alias("file"),
                text.alias("detail"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def count_by_severity(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rev").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def passes(errors: Column, warnings: Column, fail_on: str) -> Column:
    """Whether the gate lets a revision through; an unknown level never fails."""
    if fail_on == "error":
        return errors == 0
    if fail_on == "warning":
        return errors + warnings == 0
    return F.lit(True)
