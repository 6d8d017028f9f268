"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.common import some_id, word_count
from depweave.operators.skew import global_rank
from depweave.session import keep, keep_counted, small

# Weights by position of the source, the budget in parts of all sizes, the most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2
# Queued rows that one window holds.
BUCKET_ROWS = 20_000


@dataclass
class Mix:
    """``rows``: one row per document with ``size``, ``source_size``, ``target`` and ``copies``."""

    rows: DataFrame
    budget: float


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> tuple[DataFrame, float]:
    """Target of each source: its weight's part of the budget, at most ``copies`` times its size.

    ``sizes`` has ``source`` and ``source_size``. Excess is shared anew by weight among the sources
    below their limit until none is above; each round is one aggregate over the sources.
    """
    ranked, n = global_rank(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = keep(ranked.select("source", "source_size", weight.alias("weight")))
    most = F.col("source_size") * copies
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget = total * share
    level = None
    while n:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > most
        got = table.agg(
            F.sum(F.when(full, most).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        new = (budget - got["capped"]) / got["open"] if got["open"] else level
        if new == level or new is None:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), most.cast("double"))
    return table.select("source", "source_size", target.alias("target")), budget


def _before(table: DataFrame, group: list[str], bucket: str, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` in the lower buckets of the group."""
    per = table.groupBy(*group, bucket).agg(F.sum(amount).alias(amount))
    order = Window.partitionBy(*group).orderBy(bucket) if group else Window.orderBy(bucket)
    return per.withColumn(name, F.sum(amount).over(order) - F.col(amount))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix:") -> Mix:
    """How often the mix takes each row of ``docs``.

    Rows of a source are queued in the order of a hash of their id, up to ``COPIES`` times over. A
    row's virtual finish time is the words of its source up to and with it, divided by the source's
    target. All queues are ordered by finish time, ties by source, hash and id, and the order is
    cut where the total budget is used up. So each source is within a document of its target.

    No source is one task's: the hash range is cut into equal buckets that hold about
    ``BUCKET_ROWS`` rows whatever the source, their sums are added up, and a window runs inside a
    bucket only. The same is done with ranges of finish time; only the range in which the budget
    ends is ordered row by row. All of this reads ids, sources and sizes, never the texts.

    Rows without words are never taken. A null source is a source of its own, placed last. A null
    id is an id of its own. Repeated rows are queued each. An empty table gives no rows.
    """
    rank = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    rows, n = keep_counted(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"), rank.alias("rank"), F.xxhash64(text).alias("body"),
        )
    )
    return queue(rows, n)


def queue(rows: DataFrame, n: int) -> Mix:
    """The mix of kept ``rows`` (``doc_id``, ``source``, ``size``, ``rank``, ``body``: hash of the text), ``n`` in number."""
    parts = max(1, -(-n // BUCKET_ROWS))
    sizes, sources = keep_counted(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets, budget = source_targets(sizes)
    targets = small(keep(targets), sources)

    share = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = rows.withColumn("bucket", F.floor(share * parts).cast("long"))
    starts = _before(placed, ["source"], "bucket", "size", "before").select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("rank", F.col("doc_id"), "size", "body")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("running", running)
    placed = placed.join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))
    ).withColumn("upto", F.col("before") + F.col("running")).drop("_s", "_b", "before", "running", "bucket")
    placed = placed.join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    placed = keep(placed)

    def finish(copy: Column | int) -> Column:
        return (F.col("upto") + F.col("source_size") * copy) / F.col("target")

    copies = [F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(COPIES)]
    queued = placed.where(F.col("size") > 0).select(
        "doc_id", "source", "size", "rank", F.explode(F.array(*copies)).alias("_c")
    ).withColumn("finish", F.col("_c")["finish"])
    last = _last_taken(queued, budget)
    taken = F.lit(0)
    if last is not None:
        for c in range(COPIES):
            within = (F.col("size") > 0) & (_key(finish(c)) <= last)
            taken = taken + F.when(within, 1).otherwise(0)
    return Mix(placed.withColumn("copies", taken.cast("int")), budget)


def _key(finish: Column) -> Column:
    """The total order of the queues."""
    return F.struct(
        finish.alias("finish"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"),
        F.col("rank").alias("rank"), some_id(F.col("doc_id")).alias("doc_id"),
    )


def _last_taken(queued: DataFrame, budget: float, ranges: int = 1024) -> Column | None:
    """Key of the last row, in the order of the queues, with which the sum of sizes is in budget.

    Finish times are cut into equal ranges and the range in which the budget ends is cut again
    until one window can order it. A pass sends one row per range to the driver.
    """
    spent = 0
    low, high, left = queued.agg(F.min("finish"), F.max("finish"), F.count(F.lit(1))).first()
    if not left:
        return None
    while left > BUCKET_ROWS and low < high:
        width = (high - low) / ranges
        at = F.least(F.floor((F.col("finish") - low) / width), F.lit(ranges - 1))
        per = queued.where(F.col("finish").between(low, high)).groupBy(at.alias("at")).agg(
            F.sum("size").alias("size"), F.min("finish").alias("low"), F.max("finish").alias("high"),
            F.count(F.lit(1)).alias("left"),
        )
        for row in sorted(per.collect(), key=lambda r: r["at"]):
            low, high, left = row["low"], row["high"], row["left"]
            if spent + row["size"] > budget:
                break
            spent += row["size"]
        else:
            spent -= row["size"]
            break
    inside = queued.where(F.col("finish").between(low, high)).withColumn("key", _key(F.col("finish")))
    running = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    best = (
        inside.select("key", running.alias("sum")).where(F.col("sum") + spent <= budget).agg(F.max("key")).first()[0]
    )
    if best is None:  # the row before the range is the last one
        before = queued.where(F.col("finish") < low).agg(F.max(_key(F.col("finish")))).first()[0]
        if before is None:
            return None
        best = before
    return F.struct(
        F.lit(best["finish"]).alias("finish"), F.lit(best["none"]).alias("none"), F.lit(best["source"]).alias("source"),
        F.lit(best["rank"]).alias("rank"), F.lit(best["doc_id"]).cast("long").alias("doc_id"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return mix(docs).rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken, others not at all.

    The texts meet the decisions by id, source, size and text hash. Of rows that agree in all of
    these, as many are taken once, twice, ... as there are such decisions: where the decisions
    differ, the rows get a running number, in one task for each such group of equal rows.
    """
    key = ["_mix_id", "_mix_source", "_mix_size", "_mix_body"]
    per = mix(docs).rows.groupBy(
        some_id(F.col("doc_id")).alias("_mix_id"), F.col("source").alias("_mix_source"),
        F.col("size").alias("_mix_size"), F.col("body").alias("_mix_body"),
    ).agg(
        F.count(F.lit(1)).alias("_mix_rows"),
        F.array(*[F.count_if(F.col("copies") > c) for c in range(COPIES)]).alias("_mix_counts"),
    )
    taken = keep(per.where(F.col("_mix_counts")[0] > 0))
    partly = F.exists("_mix_counts", lambda n: (n > 0) & (n < F.col("_mix_rows")))
    same = (
        (some_id(F.col("doc_id")) == F.col("_mix_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))
        & (word_count(F.col("text")) == F.col("_mix_size"))
        & (F.xxhash64("text") == F.col("_mix_body"))
    )
    joined = docs.join(taken.where(~partly).hint("shuffle_hash"), same).withColumn("_mix_number", F.lit(1))
    uneven, n = keep_counted(taken.where(partly))
    if n:
        number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
        joined = joined.unionByName(docs.join(uneven.hint("shuffle_hash"), same).withColumn("_mix_number", number))
    copies = F.size(F.filter("_mix_counts", lambda n: n >= F.col("_mix_number")))
    again = joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), copies)))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
