"""Strongly connected components of two or more files, and the cycle report."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.functions.exprs import cycle_severity
from depweave.operators.reach import reachable_from
from depweave.operators.skew import HotKeys, global_rank, hot_join, lookup
from depweave.operators.walks import Walks, build_walks, restricted, reversed_walks
from depweave.session import BROADCAST_ROWS, cut, dealt, keep, keep_counted, ship_package, small, spread

# Imports that one task may hold.
BLOCK_EDGES = 500_000


def _trim(walks: Walks) -> Walks:
    """Drop nodes that no long walk enters or leaves, until nothing more drops out.

    A node of a cycle starts and ends walks of every length, so it always stays.
    """
    while not walks.empty:
        longest = walks.table.where(F.col("steps") == walks.steps)
        ends = longest.select(F.col("src").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("e"))
        ends = ends.unionByName(
            longest.select(F.col("dst").alias("id"), F.lit(0).alias("s"), F.lit(1).alias("e"))
        )
        both = ends.groupBy("id").agg(F.max("s").alias("s"), F.max("e").alias("e"))
        kept = restricted(walks, both.where("s = 1 and e = 1").select("id"))
        if kept.rows == walks.rows:
            return kept
        walks = kept
    return walks


def _lowest_by_pointers(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(id, colour)`` and their number: the smallest node met on the way back from each node by smallest predecessors.

    A round doubles the ways, so a long chain takes as many rounds as its length has binary digits. Whatever is met
    reaches the node, but not all that reaches it is met.
    """
    before = F.when(F.col("src") != F.col("dst"), F.col("src"))
    ends = F.inline(F.array(F.struct(F.col("dst").alias("id"), before.alias("up")), F.struct(F.col("src").alias("id"), F.lit(None).alias("up"))))
    pointers = edges.select(ends).groupBy("id").agg(F.min("up").alias("up"))
    labels, rows = keep_counted(pointers.select("id", "up", F.col("id").alias("colour")))
    moved = rows
    while moved:
        above = labels.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("colour").alias("_offer"))
        met = lookup(labels, above, "up", "left", rows)
        better = F.coalesce(F.col("_offer") < F.col("colour"), F.lit(False))
        colour = F.when(better, F.col("_offer")).otherwise(F.col("colour")).alias("colour")
        met = met.select("id", F.col("_up").alias("up"), colour, better.alias("better"))
        labels, moved = keep_counted(met, F.col("better"))
    return labels.select("id", "colour"), rows


def _lowest_reaching(walks: Walks) -> DataFrame:
    """``(id, colour)``: the smallest node from which each node can be reached."""
    labels, fresh = _lowest_by_pointers(walks.table)
    newest, deltas = labels, []
    none = HotKeys(walks.hot_src.key_type)
    with dealt(walks.table.select(F.col("src").alias("id"), "dst").distinct(), "id", walks.rows) as step:
        while fresh:
            offers = hot_join(small(newest, fresh), step, "id", none, walks.hot_src)
            offers = offers.groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("_offer"))
            offers, met = keep_counted(offers.where(F.col("_offer") < F.col("id")))
            if met <= BROADCAST_ROWS:
                # What the offers meet is looked up; the labels stay as they are written.
                pieces = reduce(DataFrame.unionByName, [labels, *deltas]).join(F.broadcast(offers), "id")
                least = pieces.groupBy("id").agg(F.min("colour").alias("_own"), F.first("_offer").alias("colour"))
                newest, fresh = keep_counted(least.where("colour < _own").select("id", "colour"))
                deltas.append(newest)
            else:
                labels = _merged(labels, deltas).join(offers, "id", "left")
                better = F.coalesce(F.col("_offer") < F.col("colour"), F.lit(False))
                colour = F.when(better, F.col("_offer")).otherwise(F.col("colour")).alias("colour")
                labels, fresh = keep_counted(labels.select("id", colour, better.alias("better")), F.col("better"))
                newest, labels, deltas = labels.where("better").select("id", "colour"), labels.drop("better"), []
    return keep_counted(_merged(labels, deltas))[0]


def _merged(labels: DataFrame, deltas: list[DataFrame]) -> DataFrame:
    """Each node's least colour; a delta has the nodes whose colour fell in a round."""
    if not deltas:
        return labels
    return reduce(DataFrame.unionByName, [labels, *deltas]).groupBy("id").agg(F.min("colour").alias("colour"))


def _by_colours(edges: DataFrame, walks: Walks | None = None) -> DataFrame:
    """:func:`strongly_connected` in rounds over the whole graph, for components that no task can hold.

    Trim, colour every node with the smallest node that reaches it, then walk backwards inside
    each colour from the node that gave it: what is met is exactly that node's component. Both start
    from what doubled pointers find, so long chains take few rounds.
    Found nodes are removed and the rest is trimmed and coloured again.
    """
    walks = _trim(walks or build_walks(edges))
    found = []
    while not walks.empty:
        labels = _lowest_reaching(walks)
        coloured = walks.sized(labels)
        none = HotKeys(walks.hot_src.key_type)
        inside = hot_join(walks.table, coloured.toDF("src", "_c"), "src", walks.hot_src, none)
        inside = hot_join(inside, coloured.toDF("dst", "_d"), "dst", walks.hot_dst, none)
        inside = inside.where(F.col("_c") == F.col("_d")).select("src", "dst", "steps", "weight")
        inside, rows = keep_counted(inside)
        backward = reversed_walks(Walks(inside, walks.steps, rows, walks.hot_src, walks.hot_dst))
        roots = labels.where(F.col("id") == F.col("colour")).select("id")
        # Their colour is the smallest node of its kind, so whoever meets it forwards by pointers is a member.
        sure = _lowest_by_pointers(backward.table)[0].join(labels, ["id", "colour"], "left_semi").select("id")
        members = cut(reachable_from(None, roots.unionByName(sure), backward).join(labels, "id"))
        found.append(members)
        left = labels.join(members, "id", "left_anti").select("id")
        walks = _trim(restricted(walks, left))
    if not found:
        node = walks.table.select(F.col("src").alias("id"), F.col("src").alias("comp"))
        return node.where(F.lit(False))
    members = reduce(DataFrame.unionByName, found).withColumnRenamed("colour", "comp")
    sizes = members.groupBy("comp").count().where("count >= 2").select("comp")
    return cut(members.join(sizes, "comp", "left_semi").select("id", "comp"))


def strong_parts(tail: np.ndarray, head: np.ndarray, nodes: int) -> np.ndarray:
    """The strong component of each node below ``nodes``, named by its smallest node: Tarjan's search, without recursion."""
    order = np.argsort(tail, kind="stable")
    onward = head[order].tolist()
    first = np.searchsorted(tail[order], np.arange(nodes + 1)).tolist()
    seen, low, part = [0] * nodes, [0] * nodes, [-1] * nodes
    at, open_, count = first[:nodes], [], 0
    for root in range(nodes):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        open_.append(root)
        path = [root]
        while path:
            node = path[-1]
            if at[node] < first[node + 1]:
                to = onward[at[node]]
                at[node] += 1
                if not seen[to]:
                    count += 1
                    seen[to] = low[to] = count
                    open_.append(to)
                    path.append(to)
                elif part[to] < 0 and seen[to] < low[node]:
                    low[node] = seen[to]
                continue
            path.pop()
            if path and low[node] < low[path[-1]]:
                low[path[-1]] = low[node]
            if low[node] == seen[node]:
                members = [open_.pop()]
                while members[-1] != node:
                    members.append(open_.pop())
                least = min(members)
                for member in members:
                    part[member] = least
    return np.array(part, np.int64)


def _of_block(rows: pa.Table) -> pa.Table:
    """``(id, comp)`` of the nodes on cycles of the imports ``(src, dst)`` of one block."""
    ends = np.concatenate([rows.column("src").to_numpy(), rows.column("dst").to_numpy()])
    nodes, number = np.unique(ends, return_inverse=True)
    part = strong_parts(number[: rows.num_rows], number[rows.num_rows :], len(nodes))
    cyclic = np.bincount(part, minlength=len(nodes))[part] > 1
    return pa.table({"id": nodes[cyclic], "comp": nodes[part[cyclic]]})


def _found_in(edges: DataFrame, *block: str) -> DataFrame:
    """The components of each block of ``edges``, each block by one task."""
    ship_package(edges.sparkSession)
    return edges.groupBy(*block).applyInArrow(_of_block, "id long, comp long")


def _between_cyclic(edges: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Those of ``rows`` edges whose ends both have an edge into and out of them, as all edges of cycles have, and their number.

    What then stands at an end is taken off again only while that takes most away.
    """
    while True:
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges, kept = keep_counted(edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
        if not kept or kept > rows // 2:
            return edges, kept
        rows = kept


def _renamed(ids: DataFrame, name: str, found: DataFrame, rows: int) -> DataFrame:
    """``ids`` with the column ``name`` replaced by the component of what it holds, where that is found."""
    other = [c for c in ids.columns if c != name]
    met = lookup(ids, found.select(F.col("id").alias(name), "comp"), name, "left", rows)
    return met.select(F.coalesce("comp", name).alias(name), *other)


def _contracted(edges: DataFrame) -> DataFrame:
    """:func:`strongly_connected` over long ids.

    The edges are dealt into blocks: nodes that pointers lead back to the same node lie in one. A task finds the components
    within a block, which are parts of components of the graph; each becomes one node, and the smaller graph is dealt
    anew, until one task can hold it. If nothing comes together any more, the rest goes by colours.
    """
    edges, rows = _between_cyclic(edges.where("src <> dst"), edges.count())
    none = edges.select(F.col("src").alias("id"), F.col("src").alias("comp")).where("false")
    found = []
    while rows:
        if rows <= BLOCK_EDGES:
            found.append(keep(_found_in(edges)))
            break
        labels, _ = _lowest_by_pointers(edges)
        inside = lookup(edges, labels.toDF("src", "label"), "src", rows=rows)
        inside = lookup(inside, labels.toDF("dst", "_to"), "dst", rows=rows).where("label = _to").select("src", "dst", "label")
        inside, many = keep_counted(inside)
        sizes = inside.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_EDGES)
        inside = inside.join(F.broadcast(sizes), "label", "left_anti")  # fewer than the imports over BLOCK_EDGES
        blocks = max(-(-many // BLOCK_EDGES), min(16, many // 50_000 + 1))
        dealt_out = inside.select(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block"), "src", "dst").repartition(blocks, "block")
        parts, joined = keep_counted(_found_in(dealt_out, "block"))
        if not joined:
            found.append(_by_colours(edges))
            break
        found.append(parts)
        shrunk = _renamed(_renamed(edges, "src", parts, rows), "dst", parts, rows).where("src <> dst").distinct()
        before = rows
        edges, rows = _between_cyclic(*keep_counted(shrunk))
        if rows > before // 2:
            found.append(_by_colours(edges))
            break
    if not found:
        return none
    names = found.pop()  # A name is a member of its component, the smallest one; that given last holds.
    for parts in reversed(found):
        renamed = parts.join(spread(names.toDF("comp", "_c")), "comp", "left").select("id", F.coalesce("_c", "comp").alias("comp"))
        names = renamed.unionByName(names.join(spread(parts), "id", "left_anti"))
    return keep(names)


def strongly_connected(edges: DataFrame, walks: Walks | None = None) -> DataFrame:
    """``(id, comp)`` for nodes on cycles; ``comp`` is the smallest node of the component. ``walks`` are not needed.

    Ids that are not long are numbered in their order first.
    """
    edges = edges.select("src", "dst")
    if edges.schema["src"].dataType == T.LongType():
        return _contracted(edges)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct()
    numbers = keep(global_rank(ends, [F.col("id")], "no")[0])
    plain = edges.join(numbers.toDF("src", "_s"), "src").join(numbers.toDF("dst", "_d"), "dst")
    found = _contracted(keep(plain.select(F.col("_s").alias("src"), F.col("_d").alias("dst"))))
    named = found.toDF("no", "_c").join(numbers, "no").select("id", F.col("_c").alias("no"))
    return named.join(numbers.withColumnRenamed("id", "comp"), "no").select("id", "comp")


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between two nodes of one component, with the component."""
    return (
        edges.select("src", "dst")
        .join(members.toDF("src", "comp"), "src")
        .join(members.toDF("dst", "_c"), "dst")
        .where(F.col("comp") == F.col("_c"))
        .select("comp", "src", "dst")
    )


def cycle_report(files: DataFrame, edges: DataFrame, members: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row per cycle: size, severity, first file and the import to cut.

    The cut is an import inside the cycle whose file imports most; ties take the smallest
    importing path, then the smallest imported path. Member lists are left to
    :func:`cycle_members`, so that no row grows with its component.
    """
    paths = files.select("id", "rev", "path")
    named = members.join(paths, "id")
    head = named.groupBy("comp").agg(
        F.first("rev").alias("rev"), F.count(F.lit(1)).alias("length"), F.min("path").alias("first_file")
    )
    inner = (
        cycle_edges(edges, members)
        .join(degrees.select(F.col("id").alias("src"), "out_degree"), "src")
        .join(paths.select(F.col("id").alias("src"), F.col("path").alias("break_from")), "src")
        .join(paths.select(F.col("id").alias("dst"), F.col("path").alias("break_to")), "dst")
    )
    busiest = inner.groupBy("comp").agg(
        F.min_by(
            F.struct("break_from", "break_to"),
            F.struct(-F.col("out_degree"), F.col("break_from"), F.col("break_to")),
        ).alias("_b")
    )
    return head.join(busiest, "comp").select(
        "comp",
        "rev",
        "length",
        cycle_severity(F.col("length")).alias("severity"),
        "first_file",
        F.col("_b.break_from").alias("break_from"),
        F.col("_b.break_to").alias("break_to"),
    )


def cycle_members(files: DataFrame, members: DataFrame) -> DataFrame:
    """``(comp, rev, id, path)`` of every file on a cycle."""
    return members.join(files.select("id", "rev", "path"), "id").select("comp", "rev", "id", "path")


def cycle_signatures(files: DataFrame, members: DataFrame) -> DataFrame:
    """Cycle identity that survives a change of revision, without collecting the members.

    The signature is the size, the first path and two independent sums of path hashes, so equal
    member sets have equal signatures whatever their size.
    """
    named = members.join(files.select("id", "rev", "path"), "id")
    parts = [F.conv(F.substring(F.md5("path"), at, 13), 16, 10).cast("decimal(38,0)") for at in (1, 14)]
    return named.groupBy("comp", "rev").agg(
        F.count(F.lit(1)).alias("length"),
        F.min("path").alias("first_file"),
        F.sum(parts[0]).alias("sig_a"),
        F.sum(parts[1]).alias("sig_b"),
    )
