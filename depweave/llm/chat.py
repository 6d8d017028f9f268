"""Chat logs: snapshots of a growing conversation collapse into the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import keep

# Turns that one window holds; a longer conversation spreads over several tasks.
CHUNK = 1024
LOW = 0xFFFFFFFF


def _fingerprint(name: str) -> list:
    """Four summable numbers of a turn: the halves of two 64-bit hashes. Sums cannot overflow."""
    parts = []
    for column in ("turn", "role", "text"):
        parts += [F.col(column), F.col(column).isNull()]
    out = []
    for seed in ("a", "b"):
        h = F.xxhash64(F.lit(seed), *parts)
        out += [h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)]
    return [c.alias(f"{name}{i}") for i, c in enumerate(out)]


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one: ``conv_id``, ``n_turns``, ``n_logs``.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Turns are ordered by number, then role
    and text; nulls come last. The rolling hash of a prefix is the running sum of 128-bit turn
    hashes, which contain the turn's number. A log whose whole hash is the prefix hash of a longer
    log goes (anti join); of equal logs the smallest id stays, and ``n_logs`` counts them.

    The running sum is taken inside chunks of ``CHUNK`` turn numbers and then over the chunks, so
    a conversation that holds a third of all rows is not one task's. Equal logs are reduced before
    the anti join, so both its sides have unique keys. Only hashes are shuffled.

    A null ``conv_id`` is a conversation of its own. Repeated turns count as turns.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit((1 << 62))).cast("long")
    hashed = turns.select(
        "conv_id", F.col("conv_id").isNull().alias("anon"), "turn", chunk.alias("chunk"), *_fingerprint("h")
    )
    within = Window.partitionBy("conv_id", "anon", "chunk").orderBy(
        F.col("turn").asc_nulls_last(), "h0", "h1", "h2", "h3"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(f"h{i}").over(within).alias(f"s{i}") for i in range(4)]
    hashed = keep(hashed.select("conv_id", "anon", "chunk", F.count(F.lit(1)).over(within).alias("n"), *sums))

    names = ["n", "s0", "s1", "s2", "s3"]
    totals = hashed.groupBy("conv_id", "anon", "chunk").agg(*[F.max(c).alias(c) for c in names])
    over = Window.partitionBy("conv_id", "anon").orderBy("chunk")
    before = totals.select(
        F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"),
        *[(F.sum(c).over(over) - F.col(c)).alias(f"before_{c}") for c in names],
        F.sum("n").over(Window.partitionBy("conv_id", "anon")).alias("length"),
    )
    prefixes = hashed.join(
        before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))
    ).select(
        "conv_id", "length", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in names]
    )
    prefixes = keep(prefixes)
    whole = prefixes.where(F.col("n") == F.col("length")).groupBy(*names).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logs")
    )
    proper = prefixes.where(F.col("n") < F.col("length")).select(*names).distinct()
    return whole.join(proper, names, "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "n_logs"
    )


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation with its text: a header line and the text of each turn.

    A null role is written as ``unknown`` and a null text as an empty one. A rendered conversation
    is one value, so it must fit into one row.
    """
    wanted = kept.withColumnRenamed("conv_id", "_c")
    rows = turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", "n_turns", "n_logs",
        F.struct(
            F.col("turn").isNull().alias("no_turn"), F.col("turn").alias("turn"), *_fingerprint("h"),
            F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    turn = F.transform(
        F.array_sort(F.collect_list("t")),
        lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")),
    )
    return rows.groupBy("conv_id", "n_turns", "n_logs").agg(F.array_join(turn, "").alias("rendered"))


def digest(turns: DataFrame) -> DataFrame:
    """The query: kept conversations, rendered."""
    turns = turns.select("conv_id", "turn", "role", "text")
    return render(turns, maximal(turns))
