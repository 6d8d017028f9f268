"""URL filter: host and path rules, and a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm import bloom
from depweave.llm.common import ascii_lower
from depweave.session import keep_counted

# Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in small letters."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, and path without its last slash; null if there is no host."""
    name = F.regexp_replace(host(url), r"^(www|m)\.", "")
    where = F.regexp_replace(path(url), r"/$", "")
    return F.when(name != "", F.concat(name, where))


def with_rule(df: DataFrame, host_name: str, path_name: str, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``_rule_verdict`` of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host_name) == name) | F.col(host_name).endswith("." + name)) & F.col(path_name).startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("_rule_verdict", verdict)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", keep_columns: tuple[str, ...] = ("page_id",), rules=RULES) -> DataFrame:
    """One row per row of ``pages``: ``keep_columns``, ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    ``listed`` has a column ``url``. Its canonical forms become a blocked Bloom filter of at most
    8 MB, which is broadcast. Pages it excludes are done; the others meet the list in an exact hash
    join, which takes out false hits. Only those rows are shuffled. Canonical forms in the list are
    unique, so a URL on a third of all pages is hot on one side only, where AQE splits it.

    A null URL, or one without ``://``, has an empty host and path, fits no rule, is never listed
    and is allowed. Repeated rows give repeated results. An empty list allows what no rule blocks.
    """
    base = pages.select(
        *[F.col(f"`{c}`") for c in keep_columns], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"),
        canonical(F.col(url)).alias("_canonical"),
    )
    base = with_rule(base, "host", "path", rules)
    forms, n = keep_counted(listed.select(canonical(F.col("url")).alias("_listed")).dropna().distinct())
    table, blocks = bloom.build(forms, "_listed", n)
    tried = bloom.possible(base, F.col("_canonical"), table, blocks, "_possible")
    hits = tried.where("_possible").join(
        forms.hint("shuffle_hash"), F.col("_canonical") == F.col("_listed"), "left"
    ).withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    done = tried.where(~F.col("_possible")).withColumn("listed", F.lit(False))
    both = hits.unionByName(done)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select(
        *[F.col(f"`{c}`") for c in keep_columns], "host", "path", "rule",
        F.coalesce("_rule_verdict", method).alias("verdict"), "listed",
    )


def digest(pages: DataFrame) -> DataFrame:
    """The query: the listed URLs are those that some page carries with a referral mark."""
    marked = pages.where(F.col("url").rlike(r"[?&]ref=")).select("url")
    return judge(pages.select("page_id", "url"), marked)
