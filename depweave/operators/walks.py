"""The walk table: edges extended to walks of up to eight steps, with a checked size.

Every iterative operator advances along this table, so it needs an eighth of the rounds (and of
the passes over the graph) that stepping along single edges would take.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.skew import HOT_FLOOR, HotKeys, hot_join, hot_keys
from depweave.session import cut, cut_counted, keep, keep_counted, small

# Edges up to which walks are made longer; a loop over a larger graph joins to edges dealt once instead.
WALK_EDGES = 1_000_000


@dataclass
class Walks:
    """``table(src, dst, steps, weight)``; a weight is the chance of a random walk taking it, or nothing if not ``weighted``."""

    table: DataFrame
    steps: int
    rows: int
    hot_src: HotKeys
    hot_dst: HotKeys
    weighted: bool = True

    @property
    def empty(self) -> bool:
        return self.rows == 0

    @cached_property
    def ball(self) -> DataFrame:
        """Shortest distance ``hop`` of every pair at most ``steps`` apart, loops left out."""
        pairs = self.table.where(F.col("src") != F.col("dst"))
        return cut(pairs.groupBy("src", "dst").agg(F.min("steps").alias("hop")))

    @property
    def near(self) -> DataFrame:
        """Pairs at most ``steps`` apart with their distance ``hop``, loops left out; single steps are not shuffled for it."""
        if self.steps > 1:
            return self.ball
        return self.table.where(F.col("src") != F.col("dst")).select("src", "dst", F.col("steps").alias("hop"))

    def sized(self, df: DataFrame) -> DataFrame:
        """Mark a table that cannot have more rows than the walk table as small, if that is."""
        return small(df, self.rows)


def build_walks(
    edges: DataFrame, max_steps: int = 8, growth: int = 3, floor: int = HOT_FLOOR, rows: int | None = None
) -> Walks:
    """Double the length of the walks while the table stays within ``growth`` times the edges.

    The exact size of a doubling is computed first, from the degrees, at the cost of two
    aggregates. A hub that would blow the table up therefore stops the doubling before it runs,
    and the operators take more, shorter, rounds instead; so does a graph of more than ``WALK_EDGES`` edges.
    Of edges that are written already and counted by ``rows`` to be so many, nothing is written again, and no weights are made.
    """
    if rows is not None and rows > WALK_EDGES:
        table = edges.select("src", "dst", F.lit(1).alias("steps"), F.lit(None).cast("double").alias("weight"))
        return Walks(table, 1, rows, hot_keys(table, "src", rows, floor), hot_keys(table, "dst", rows, floor), weighted=False)
    edges, first = keep_counted(edges.select("src", "dst"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    weight = (F.lit(1.0) / F.col("_d")).alias("weight")
    none = HotKeys(edges.schema["src"].dataType)
    table = hot_join(edges, small(out, first), "src", hot_keys(edges, "src", first, floor), none)
    table = table.select("src", "dst", F.lit(1).alias("steps"), weight)
    steps, rows = 1, first
    while rows and steps < max_steps and first <= WALK_EDGES:
        longest = table.where(F.col("steps") == steps)
        # Rows of the doubling: over all nodes, longest walks into it times walks out of it.
        ends = F.explode(
            F.array(
                F.struct(F.col("dst").alias("v"), (F.col("steps") == steps).cast("int").alias("a"), F.lit(0).alias("b")),
                F.struct(F.col("src").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")),
            )
        )
        meets = table.select(ends.alias("x")).select("x.*").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        joined = meets.agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0
        if joined > growth * first:
            break
        left = longest.select(
            F.col("dst").alias("mid"), "src", F.col("steps").alias("_s"), F.col("weight").alias("_w")
        )
        right = table.select(F.col("src").alias("mid"), "dst", "steps", "weight")
        longer = hot_join(
            left, small(right, rows), "mid", hot_keys(left, "mid", rows, floor), hot_keys(right, "mid", rows, floor)
        )
        longer = longer.groupBy("src", "dst", (F.col("_s") + F.col("steps")).alias("steps")).agg(
            F.sum(F.col("_w") * F.col("weight")).alias("weight")
        )
        table, rows = cut_counted(table.unionByName(longer))
        steps *= 2
    if steps == 1:
        table = keep(table)
    return Walks(
        table, steps, rows, hot_keys(table, "src", rows, floor), hot_keys(table, "dst", rows, floor)
    )


def single_steps(edges: DataFrame) -> Walks:
    """The edges themselves, for searches too small to pay for the longer table."""
    table, rows = cut_counted(
        edges.select("src", "dst", F.lit(1).alias("steps"), F.lit(1.0).alias("weight"))
    )
    return Walks(table, 1, rows, hot_keys(table, "src", rows), hot_keys(table, "dst", rows))


def reversed_walks(walks: Walks) -> Walks:
    table = walks.table.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "steps", "weight")
    return Walks(table, walks.steps, walks.rows, walks.hot_dst, walks.hot_src)


def restricted(walks: Walks, nodes: DataFrame) -> Walks:
    """Walks whose two ends are both among ``nodes(id)``, of which no walk has more than two."""
    nodes = walks.sized(nodes)
    table = walks.table.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(
        nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    table, rows = keep_counted(table.select("src", "dst", "steps", "weight"))
    return Walks(table, walks.steps, rows, walks.hot_src, walks.hot_dst)
