"""Secret scan: spans of likely credentials, told apart by how many owners hold each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import keep

# The kinds in their order, with pattern, group of the value and its least length.
KINDS = (
    (
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A value without a keyword: long, with a digit, a small and a capital letter.
LONE = r"[A-Za-z0-9+/_-]{20,}"
# A value held by this many owners is an example that people copy.
COPIED_OWNERS = 3

SPAN = "struct<start:long,kind_no:int,end:long,kind:string,value:string>"


def _found(text: Column, kind_no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches with positions in code points, from the lengths of the matches and the pieces between."""
    regex = F.lit(pattern)
    values = F.regexp_extract_all(text, regex, F.lit(group))
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("len"), values.alias("value")
    )
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")
    )

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["gap"]
        end = begin + part["len"]
        span = F.struct(
            begin.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"),
            F.lit(kind).alias("kind"), part["value"].alias("value"),
        )
        good = F.length(part["value"]) >= least
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _written(spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then by kind as listed."""
    one = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def scan(docs: DataFrame, text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` with its spans and what the corpus says about their values.

    Base spans (``assign``, ``access``, ``hex``) always stay. Every value, and every long value
    without a keyword, is hashed; the hashes are counted by distinct owner and repository over the
    whole corpus. A value of fewer than ``COPIED_OWNERS`` owners is taken for live, others for
    copied examples. Live values without a keyword are added as spans of kind ``lone``.

    Columns: those of ``docs`` but the text, prefixed by nothing, in the struct ``row``; ``base``,
    ``spans`` (arrays of start, end, kind, value), ``n_live``, ``n_copied``.

    The text is read once; what is found is written, so the counts and the join back read only
    spans. Counting goes by (hash, owner, repository) first, so a hash in a third of all rows is
    reduced to its owners before it meets in one task; the join back has unique keys on one side.
    Null and empty texts have no spans. A null owner or repository counts as one owner or
    repository of its own. Repeated rows give repeated results and count as one owner.
    """
    own = F.lit(None).cast("string") if owner is None else owner.cast("string")
    repo = own if repository is None else repository.cast("string")
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    found = docs.select(
        row.alias("row"), own.alias("owner"), repo.alias("repo"), body.alias("text")
    ).select(
        "row", "owner", "repo",
        F.concat(*[_found(F.col("text"), i, *k) for i, k in enumerate(KINDS)]).alias("base"),
        _found(F.col("text"), len(KINDS), "lone", LONE, 0, 20).alias("lone"),
    )

    def apart(c: Column) -> Column:
        value = c["value"]
        mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        return mixed & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    found = found.withColumn("lone", F.filter("lone", apart))
    found = keep(found.withColumn("rid", F.monotonically_increasing_id()))

    each = found.select(
        "rid", "owner", "repo", F.explode(F.concat("base", "lone")).alias("span")
    ).withColumn("hash", F.sha2(F.col("span")["value"], 256))
    held = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    spread = held.groupBy("hash").agg(
        F.count_distinct(F.struct("owner")).alias("n_owners"), F.count(F.lit(1)).alias("n_repos")
    )
    live = F.col("n_owners") < COPIED_OWNERS
    judged = each.select("rid", "span", "hash").join(spread, "hash").groupBy("rid").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_copied"),
        F.collect_list(F.when(live & (F.col("span")["kind"] == "lone"), F.col("span"))).alias("more"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    return found.join(judged, "rid", "left").select(
        "row", "base",
        F.concat("base", F.coalesce("more", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts per kind, digest of the base spans, all spans."""
    found = scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row")["doc_id"].alias("doc_id"),
        *[count(k[0]) for k in KINDS],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        "n_live", "n_copied",
    )
