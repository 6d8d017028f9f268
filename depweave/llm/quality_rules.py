"""Quality rules whose cutoffs come from quantile sketches of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.common import WORD, words
from depweave.session import keep, keep_counted, small

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
# A group's quantiles are means of its own and its language's, which count as so many rows; a language's
# are drawn to those of all rows in the same way. So a small group is judged mostly by its language.
PRIOR = 50
# Per cent of the rows at or below the low, the middle and the high quantile.
QUANTILES = {"lo": 5, "mid": 50, "hi": 95}
# A cutoff lies so many times the distance of middle and outer quantile beyond the outer one.
REACH = 2
# Metrics in whole steps: least distance of a cutoff from the outer quantile, and if low values fail as well.
# A step is a thousandth for shares and a tenth of a letter for the word length.
METRICS = {"symbols": (50, False), "dup_lines": (100, False), "repeats": (100, False), "word_length": (10, True)}
STEPS = 1000


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """One narrow row per row of ``docs``: id, language, source and the counts of its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        words(F.col(text)).alias("w"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    runs = F.size("w") - (WINDOW - 1)
    hashes = F.when(
        runs > 0, F.transform(F.sequence(F.lit(1), runs), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    # Hash and position, sorted by hash; only texts in which a window comes twice need it.
    pairs = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    paired = counted.withColumn("p", pairs).drop("h")

    def twice(p: Column, j: Column) -> Column:
        same = F.coalesce(F.get("p", j - 1)["x"] == p["x"], F.lit(False))
        return F.when(same | F.coalesce(F.get("p", j + 1)["x"] == p["x"], F.lit(False)), p["i"])

    placed = paired.withColumn("at", F.array_sort(F.array_compact(F.transform("p", twice)))).drop("p")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "at", zero,
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + (i + WINDOW - F.greatest(acc["end"], i))).cast("long").alias("n")
        ),
        lambda acc: acc["n"],
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def _steps() -> dict[str, Column]:
    def share(part: str, of: str, scale: int) -> Column:
        value = F.floor(F.col(part) * scale / F.greatest(F.col(of), F.lit(1)))
        return F.least(value, F.lit(STEPS)).cast("long")

    return {
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
        "word_length": share("word_chars", "n_words", 10),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """Quantile sketches: counts of whole steps by language, source and metric.

    A sketch has at most ``STEPS`` + 1 steps, its quantiles are exact to one step, and two sketches
    merge by adding counts, which is how tasks, sources and languages are put together.
    """
    each = F.array(*[F.struct(F.lit(m).alias("metric"), s.alias("step")) for m, s in _steps().items()])
    return rows.where(F.col("n_words") > 0).select("lang", "source", F.explode(each).alias("e")).groupBy(
        "lang", "source", F.col("e")["metric"].alias("metric"), F.col("e")["step"].alias("step")
    ).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(counts: DataFrame, group: list[str]) -> DataFrame:
    keys = [*group, "metric"]
    merged = counts.groupBy(*keys, "step").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("step"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = merged.select(*keys, "step", upto.alias("upto"), total.alias("total"))
    return ranked.groupBy(*keys).agg(
        *[F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("step"))).alias(q) for q, p in QUANTILES.items()],
        F.max("total").alias("total"),
    )


def _drawn(own: str, total: str, wider: str) -> Column:
    """Whole-number mean of a quantile and that of the wider group, which counts as ``PRIOR`` rows."""
    mixed = F.col(own) * F.col(total) + F.col(wider) * PRIOR
    return F.floor(mixed / (F.col(total) + PRIOR)).cast("long")


def thresholds(counts: DataFrame) -> DataFrame:
    """Cutoffs by language and source: columns ``<metric>_most`` and ``word_length_least``.

    They follow the group's own quantiles and can be tighter or looser than any other group's.
    """
    qs = list(QUANTILES)
    of_all = _quantiles(counts, []).select(F.col("metric").alias("_m"), *[F.col(q).alias(f"all_{q}") for q in qs])
    # Four rows of all metrics.
    by_lang = _quantiles(counts, ["lang"]).join(F.broadcast(of_all), F.col("metric") == F.col("_m")).select(
        F.col("lang").alias("_l"), F.col("metric").alias("_n"),
        *[_drawn(q, "total", f"all_{q}").alias(f"lang_{q}") for q in qs],
    )
    own = _quantiles(counts, ["lang", "source"])
    wide = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_n")))
    drawn = wide.select("lang", "source", "metric", *[_drawn(q, "total", f"lang_{q}").alias(q) for q in qs])
    out = []
    for metric, (slack, low_fails) in METRICS.items():
        mine = F.col("metric") == metric
        most = F.col("hi") + F.greatest((F.col("hi") - F.col("mid")) * REACH, F.lit(slack))
        out.append(F.max(F.when(mine, most)).alias(f"{metric}_most"))
        if low_fails:
            least = F.col("lo") - F.greatest((F.col("mid") - F.col("lo")) * REACH, F.lit(slack))
            out.append(F.min(F.when(mine, least)).alias(f"{metric}_least"))
    return drawn.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for each row of ``docs``.

    The text is read once; counts are written, sketched and joined with their cutoffs as narrow
    rows. Cutoffs are one row per language and source: broadcast if their counted number is small,
    joined otherwise, where AQE splits a source that holds a third of all rows.

    Null and empty texts have zero counts and fail the base rules. A null language or source is a
    group of its own. Repeated rows give repeated results.
    """
    rows = keep(measures(docs))
    cutoffs, groups = keep_counted(thresholds(sketches(rows)))
    cutoffs = small(cutoffs.withColumnRenamed("lang", "_l").withColumnRenamed("source", "_s"), groups)
    joined = rows.join(
        cutoffs, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left"
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    fine = F.lit(True)
    for metric, step in _steps().items():
        fine = fine & (step <= F.col(f"{metric}_most"))
        if METRICS[metric][1]:
            fine = fine & (step >= F.col(f"{metric}_least"))
    return joined.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.coalesce(fine, F.lit(True))
    ).drop("_l", "_s")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
