"""Scalar expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(value: Column) -> Column:
    """Round halves towards plus infinity, as the scores are defined.

    The value is first rounded to nine places, so that the order in which a cluster adds
    floating-point terms cannot push a score over a half.
    """
    return F.floor(F.round(value, 9) + F.lit(0.5))


def clamp_score(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(value)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a repository path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def top_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(
        F.lit("(root)")
    )


def stem(path: Column) -> Column:
    """File name without its extension and without a test or spec suffix."""
    name = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    name = F.regexp_replace(name, r"\.(test|spec)$", "")
    return F.regexp_replace(name, r"_(test|spec)$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)\z", 1))


def line_count(text: Column) -> Column:
    """Pieces between CRLF, CR and LF; zero for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(text, r"\r\n|\r|\n")))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_rename(path: Column) -> Column:
    """New path of a rename as the history log prints it (brace form or arrow form)."""
    brace = r"^(.*)\{.* => (.*)\}(.*)$"
    before, new, after = (F.regexp_extract(path, brace, i) for i in (1, 2, 3))
    # An empty new part leaves the slash on both sides of it.
    joined = F.concat(before, new, F.when((new == "") & before.endswith("/"), F.ltrim(after, F.lit("/"))).otherwise(after))
    arrow = F.regexp_extract(path, r"^.* => (.*)$", 1)
    return F.when(path.rlike(brace), joined).when(path.rlike(" => "), arrow).otherwise(path)


def normalize_path(path: Column) -> Column:
    """Collapse ``.`` and ``..`` segments of a relative POSIX path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."),
            F.slice(acc, 1, F.size(acc) - 1),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def html_escape(text: Column) -> Column:
    for raw, safe in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#39;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def cycle_severity(length: Column) -> Column:
    return F.when(length <= 2, "low").when(length <= 4, "medium").otherwise("high")


def churn_level(score: Column) -> Column:
    return (
        F.when(score < 10, "Very Low")
        .when(score < 30, "Low")
        .when(score < 55, "Medium")
        .when(score < 80, "High")
        .otherwise("Extreme")
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A")
        .when(score >= 80, "B")
        .when(score >= 70, "C")
        .when(score >= 55, "D")
        .otherwise("F")
    )


def reasons(*pairs: tuple[Column, object]) -> Column:
    """Texts whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in pairs])
    )
