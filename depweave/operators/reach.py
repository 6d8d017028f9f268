"""Reachability with distances: closure, k-hop neighbourhood, shortest path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.skew import HotKeys, hot_join, hot_keys
from depweave.operators.walks import Walks, build_walks, reversed_walks, single_steps
from depweave.session import BROADCAST_ROWS, cut, cut_counted, dealt, keep_counted, small


def reach_pairs(
    edges: DataFrame | None,
    sources: DataFrame | None = None,
    walks: Walks | None = None,
    direction: str = "out",
    max_hops: int | None = None,
) -> DataFrame:
    """``(src, dst, hop)``: every node reached from each source and its distance.

    A source is not part of its own reach, even on a cycle. ``sources(id)`` restricts the starts
    (all nodes otherwise). Each round extends the pairs at the greatest known distance by up to
    ``walks.steps`` hops, drops pairs known already with an anti join, and writes only the new
    pairs. The walks are dealt by their start once, and a small round sends its pairs to the known
    ones, so what a round moves grows with the round and not with the graph.
    """
    walks = walks or single_steps(edges)
    if direction == "in":
        walks = reversed_walks(walks)
    step = walks.steps
    first = near = walks.near
    if sources is not None:
        first = near.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    if step == 1:
        first = first.distinct()
    if max_hops is not None:
        first = first.where(F.col("hop") <= max_hops)
    known, fresh = keep_counted(first)
    levels, newest, depth, total = [known], known, step, fresh
    with dealt(near.select(F.col("src").alias("mid"), "dst", F.col("hop").alias("_h")), "mid", walks.rows) as onward:
        while fresh and (max_hops is None or depth < max_hops):
            rim = newest.where(F.col("hop") == depth).select("src", F.col("dst").alias("mid"))
            found = hot_join(small(rim, fresh), onward, "mid", hot_keys(rim, "mid", fresh), walks.hot_src)
            found = found.where(F.col("src") != F.col("dst"))
            found = found.groupBy("src", "dst").agg((F.min("_h") + F.lit(depth)).alias("hop"))
            if max_hops is not None:
                found = found.where(F.col("hop") <= max_hops)
            found, seen = _not_yet_small(found, reduce(DataFrame.unionByName, levels), total, ["src", "dst"])
            newest, fresh = keep_counted(found.join(seen, ["src", "dst"], "left_anti"))
            levels.append(newest)
            depth += step
            total += fresh
    return reduce(DataFrame.unionByName, levels)


def _not_yet_small(found: DataFrame, known: DataFrame, total: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``found``, and of the ``total`` unique ``known`` rows what an anti join of it needs, broadcast where either is small."""
    if total <= BROADCAST_ROWS:
        return found, F.broadcast(known)
    found, rows = keep_counted(found)
    if rows > BROADCAST_ROWS:
        return found, known
    met = known.join(F.broadcast(found.select(*keys)), keys, "left_semi")
    return found, F.broadcast(met)


def neighbourhood(edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 1) -> DataFrame:
    """``id`` of the seeds and of every node at most ``depth`` hops away.

    Each round joins only the nodes found last and is written, so the plan does not grow with the
    depth; it ends early when nothing new is found.
    """
    steps = []
    if direction in ("out", "both"):
        steps.append(edges.select("src", "dst"))
    if direction in ("in", "both"):
        steps.append(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = reduce(DataFrame.unionByName, steps)
    newest = cut(seeds.select("id").distinct())
    levels = [newest]
    for _ in range(depth):
        ahead = step.join(newest.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        seen = reduce(DataFrame.unionByName, levels)
        newest, fresh = cut_counted(ahead.join(seen, "id", "left_anti"))
        if not fresh:
            break
        levels.append(newest)
    return reduce(DataFrame.unionByName, levels)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both among ``nodes(id)``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(
        ids.withColumnRenamed("id", "src"), "src", "left_semi"
    ).select(edges.columns)


def shortest_path(edges: DataFrame, start: DataFrame, goal: DataFrame) -> DataFrame:
    """One shortest path from the start node to the goal node as rows ``(hop, id)``.

    No rows when the goal cannot be reached; one row when it is the start. The search goes out from
    both ends, each time by one level of the side with the smaller rim, until the sides meet; so it
    sees two balls of half the distance and not everything the start reaches. From the nodes where
    they meet, both ways back along falling distances give all nodes of shortest paths. Each of them points to
    its smallest predecessor, and the path is the chain of pointers from the goal.
    """
    steps = {"f": edges.select(F.col("src").alias("id"), F.col("dst").alias("to"))}
    steps["b"] = edges.select(F.col("dst").alias("id"), F.col("src").alias("to"))
    levels = {"f": [start.select("id").distinct()], "b": [goal.select("id").distinct()]}
    levels = {side: [cut(found[0].withColumn("hop", F.lit(0)))] for side, found in levels.items()}
    sizes = {"f": levels["f"][0].count(), "b": levels["b"][0].count()}
    schema = levels["f"][0].select("hop", "id")
    side, other = "f", "b"
    while True:
        seen = reduce(DataFrame.unionByName, levels[other]).withColumnRenamed("hop", "away")
        length = levels[side][-1].join(seen, "id").agg(F.min(F.col("hop") + F.col("away"))).first()[0]
        if length is not None:
            break
        side = "f" if sizes["f"] <= sizes["b"] else "b"
        other = "b" if side == "f" else "f"
        ahead = levels[side][-1].join(steps[side], "id").select(F.col("to").alias("id")).distinct()
        known = reduce(DataFrame.unionByName, levels[side]).select("id")
        found = ahead.join(known, "id", "left_anti").withColumn("hop", F.lit(len(levels[side])))
        newest, sizes[side] = cut_counted(found)
        if not sizes[side]:
            return schema.where("false")
        levels[side].append(newest)

    whole = {s: reduce(DataFrame.unionByName, levels[s]) for s in "fb"}
    both = whole["f"].join(whole["b"].withColumnRenamed("hop", "away"), "id").where(F.col("hop") + F.col("away") == length)
    met = cut(both.select("id", "hop"))
    on_path = [met]
    for s, back, turn in (("f", "b", -1), ("b", "f", 1)):  # towards the start by edges backwards, towards the goal forwards
        rim = met
        for _ in range(len(levels[s]) - 1):
            near = rim.join(steps[back], "id").select(F.col("to").alias("id"), (F.col("hop") + turn).alias("hop")).distinct()
            distance = F.col("own") if s == "f" else F.lit(length) - F.col("own")
            rim = cut(near.join(whole[s].withColumnRenamed("hop", "own"), "id").where(F.col("hop") == distance).select("id", "hop"))
            on_path.append(rim)
    nodes = cut(reduce(DataFrame.unionByName, on_path).distinct())
    before = nodes.select(F.col("id").alias("src"), (F.col("hop") + 1).alias("hop"))
    into = edges.select("src", "dst").join(before, "src").join(nodes.toDF("dst", "hop"), ["dst", "hop"])
    pointers = cut(into.groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("dst")))
    chain = reach_pairs(pointers, goal, build_walks(pointers)).select(F.col("dst").alias("id"))
    ends = nodes.join(goal.select("id"), "id", "left_semi")
    return ends.unionByName(nodes.join(chain, "id", "left_semi")).select("hop", "id")


def reachable_from(edges: DataFrame, roots: DataFrame, walks: Walks | None = None) -> DataFrame:
    """``id`` of the roots and of everything some root depends on, one label per node.

    Unlike :func:`reach_pairs` the state is one row per node however many roots there are.
    """
    walks = walks or single_steps(edges)
    seen, fresh = keep_counted(roots.select("id").distinct())
    levels, newest, total = [seen], seen, fresh
    none = HotKeys(walks.hot_src.key_type)
    with dealt(walks.table.select(F.col("src").alias("id"), F.col("dst")), "id", walks.rows) as step:
        while fresh:
            ahead = hot_join(small(newest, fresh), step, "id", none, walks.hot_src).select(F.col("dst").alias("id"))
            found, known = _not_yet_small(ahead.distinct(), reduce(DataFrame.unionByName, levels), total, ["id"])
            newest, fresh = keep_counted(found.join(known, "id", "left_anti"))
            levels.append(newest)
            total += fresh
    return reduce(DataFrame.unionByName, levels)
