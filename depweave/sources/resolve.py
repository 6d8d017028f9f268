"""Import resolution and assembly of the per-file records, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import dirname, line_count, normalize_path
from depweave.operators.skew import lookup
from depweave.schema import IMPORT_REF
from depweave.session import keep, spread

SCRIPTS = ("javascript", "typescript")

# Suffixes tried for a script import, in order.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def _based(language: Column, raw: Column, folder: Column) -> Column:
    """Path an import points at, before any suffix; null when it cannot mean a file."""
    dots = F.length(F.regexp_extract(raw, r"^\.*", 0))
    module = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    climbed = normalize_path(F.concat(folder, F.lit("/"), up, module))
    return (
        F.when(language.isin(*SCRIPTS) & raw.startswith("."), normalize_path(F.concat(folder, F.lit("/"), raw)))
        # Each dot after the first climbs one folder, and stops at the root.
        .when((language == "python") & (dots > 0), F.regexp_replace(climbed, r"^(\.\.(/|$))+", ""))
        .when(language == "python", module)
        .when((language == "java") & ~raw.endswith(".*"), F.replace(raw, F.lit("."), F.lit("/")))
    )


def candidates(language: Column, base: Column) -> Column:
    """Paths an import may mean, best first."""
    twin = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    below = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
    script = [base]
    script += [F.concat(base, F.lit(s)) for s in SCRIPT_SUFFIXES]
    script += [F.when(base != twin, F.concat(twin, F.lit(s))) for s in (".ts", ".tsx")]
    script += [F.concat(below, F.lit(f"index{s}")) for s in SCRIPT_SUFFIXES]
    python = [F.concat(base, F.lit(".py")), F.concat(below, F.lit("__init__.py"))]
    return (
        F.when(language.isin(*SCRIPTS), F.array(*script))
        .when(language == "python", F.array(*python))
        .when(language == "java", F.array(F.concat(base, F.lit(".java"))))
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``resolved`` to ``imports(rev, path, language, raw, ...)``, null for external imports.

    ``files(rev, path)`` is the file set. Each distinct specifier of a folder is resolved once,
    so a package that a third of all files import is looked up once and not once per file. A Java
    name also matches any file whose path ends in it, the smallest path first.
    """
    relative = F.col("language").isin(*SCRIPTS) | F.col("raw").startswith(".")
    folder = F.when(relative, dirname(F.col("path"))).otherwise("")
    keyed = imports.withColumn("_spec", F.struct("rev", "language", folder.alias("folder"), "raw"))
    spec = F.col("_spec")
    wanted = (
        keyed.select("_spec")
        .distinct()
        .select("_spec", _based(spec["language"], spec["raw"], spec["folder"]).alias("base"))
        .where("base is not null")
        .select("_spec", F.posexplode(candidates(spec["language"], F.col("base"))).alias("rank", "path"))
        .where("path is not null")
        .select("_spec", "rank", F.struct(spec["rev"].alias("rev"), F.col("path").alias("path")).alias("at"))
    )
    known = files.select(F.struct("rev", "path").alias("at"), F.col("path").alias("resolved"))
    direct = wanted.join(spread(known), "at").select("_spec", "rank", "resolved")

    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    java = files.where(F.col("path").endswith(".java") & F.contains("path", F.lit("/")))
    ends = java.select("rev", "path", F.explode(tails).alias("tail"))
    ends = ends.groupBy(F.struct("rev", F.col("tail").alias("path")).alias("at")).agg(F.min("path").alias("resolved"))
    asked = wanted.where(spec["language"] == "java")
    suffix = asked.join(spread(ends), "at").select("_spec", (F.col("rank") + 1).alias("rank"), "resolved")

    best = direct.unionByName(suffix).groupBy("_spec").agg(
        F.min_by("resolved", F.struct("rank", "resolved")).alias("resolved")
    )
    return lookup(keyed, best, "_spec", how="left").drop("_spec")


def assemble(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Per-file records from ``files(rev, path, language, size, text, key)`` and facts by key.

    A file without facts becomes an empty record and stays in the file set.
    """
    measured = files.select(
        "rev", "path", "language", "size", "key", line_count(F.col("text")).cast("int").alias("loc")
    )
    known = lookup(measured, facts, "key", how="left")
    missing = F.col("exports").isNull()
    rows = known.select(
        "rev",
        "path",
        "language",
        F.when(missing, F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"),
        F.when(missing, F.lit(0)).otherwise(F.col("loc")).cast("int").alias("loc"),
        F.coalesce("exports", F.array().cast("array<string>")).alias("exports"),
        "symbols",
        F.coalesce("comments", F.array().cast("array<string>")).alias("comments"),
        "imports",
    )
    rows = keep(rows)
    stated = rows.select("rev", "path", "language", F.posexplode("imports").alias("pos", "i")).select(
        "rev", "path", "language", "pos", "i.raw", "i.line"
    )
    found = resolve_imports(stated, rows.select("rev", "path"))
    ref = F.struct("pos", "raw", "resolved", F.col("resolved").isNull().alias("external"), "line")
    gathered = found.groupBy("rev", "path").agg(F.sort_array(F.collect_list(ref)).alias("refs"))
    refs = F.transform("refs", lambda r: F.struct(*[r[f.name].alias(f.name) for f in IMPORT_REF.fields]))
    empty_refs = F.array().cast("array<" + IMPORT_REF.simpleString() + ">")
    symbols = F.coalesce("symbols", F.expr("filter(symbols, x -> false)"), F.expr("cast(array() as " + rows.schema["symbols"].dataType.simpleString() + ")"))
    return rows.drop("imports").join(spread(gathered), ["rev", "path"], "left").select(
        "rev", "path", "language", "size", "loc",
        F.coalesce(refs, empty_refs).alias("imports"),
        "exports", symbols.alias("symbols"), "comments",
    )
