"""Reach of every file at once: 64 sources in one number per file, never a table of pairs.

Sources are numbered, and 64 neighbours in that order share a word. A row ``(id, word, hop, bits)`` says
which of the word's sources reach the file first after ``hop`` imports. A round joins the newest
rows with the imports, takes ``bit_or`` per file and word, and keeps the bits not seen before.
Counts are ``bit_count``; what a source reaches is counted by one sum per bit position.

The numbers follow strong components: files of one component reach the same files, so their bits lie
in the same words and a word is rarely sparse. Work per round is the newest rows times their
imports; the rows of all rounds are at most files times words, and a 64th of the pairs when reaches are dense.

Rounds are as many as the longest distance, so they are left to sources that reach much. Neighbouring words are a
block; the graph of components, which has no cycles and is shallow, tells what a block reaches at all. The imports
of a block that reaches no more than ``BLOCK_EDGES`` are sent to one task, which finds all distances there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from depweave.operators.skew import global_rank
from depweave.session import BROADCAST_ROWS, cut, cut_counted, keep, keep_counted, ship_package

WORD_BITS = 64
# Levels that are looked up one by one before they are merged.
MERGE_AFTER = 6
# Words of a block (a power of two), and the imports of a block that one task may hold.
BLOCK_WORDS = 16
BLOCK_EDGES = 500_000
# Stands for a missing id, which every import of it reaches anew.
NOWHERE = -1


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def numbered(files: DataFrame, components: DataFrame) -> DataFrame:
    """``(id, word, bit)`` of every file; those of one strong component follow each other."""
    placed = files.select("id").join(components.select("id", "comp"), "id", "left")
    ranked, _ = global_rank(placed, [F.coalesce("comp", "id"), F.col("id")], "no")
    no = F.col("no")
    word = F.shiftright(no, 6).alias("word")
    return keep(ranked.select("id", word, no.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int").alias("bit")))


@dataclass(frozen=True)
class BitReach:
    """``levels(id, word, hop, bits)`` with the ``numbers(id, word, bit)`` of the sources."""

    levels: DataFrame
    numbers: DataFrame

    @cached_property
    def _by_bit(self) -> DataFrame:
        """``(word, bit, n, hop)``: files each source reaches, and the greatest distance."""
        sums = [F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1))).alias(f"n{i}") for i in range(WORD_BITS)]
        counted = self.levels.groupBy("word", "hop").agg(*sums)
        each = counted.select("word", "hop", F.posexplode(F.array(*[f"n{i}" for i in range(WORD_BITS)])).alias("bit", "n"))
        return each.where("n > 0").groupBy("word", "bit").agg(F.sum("n").alias("n"), F.max("hop").alias("hop"))

    def ahead(self) -> DataFrame:
        """``(id, transitive_imports, depth)`` of every source that reaches anything."""
        found = self.numbers.join(self._by_bit, ["word", "bit"])
        return found.select("id", F.col("n").alias("transitive_imports"), F.col("hop").alias("depth"))

    def pairs(self) -> DataFrame:
        """``(src, dst, hop)`` of every source and every file it reaches: the bits of each row, unpacked."""
        member = F.struct(F.col("bit"), F.col("id").alias("src"))
        members = self.numbers.groupBy("word").agg(F.collect_list(member).alias("members"))  # at most 64 in a word
        rows = self.levels.join(members, "word").withColumnRenamed("id", "dst")
        # SQL text, as the Python form of a shift takes no column for its distance.
        reached = F.expr("filter(members, m -> (shiftright(bits, m.bit) & 1L) = 1L)")
        return rows.select("dst", "hop", F.explode(reached).alias("m")).select("m.src", "dst", "hop")

    def masks(self, flags: DataFrame, *names: str) -> DataFrame:
        """Per word, the bits of the sources for which each of the boolean columns ``names`` of ``flags(id, …)`` holds."""
        bit = _bit(F.col("bit"))
        marked = self.numbers.join(flags, "id")
        return marked.groupBy("word").agg(*[F.bit_or(F.when(F.col(n), bit).otherwise(F.lit(0).cast("long"))).alias(n) for n in names])

    def behind(self, flags: DataFrame | None = None, *names: str) -> DataFrame:
        """``(id, transitive_dependents, direct, max_hop)`` of every reached file, and how many of those that reach it are flagged."""
        bits, rows = F.col("bits"), self.levels
        counts = [
            F.sum(F.bit_count("bits")).alias("transitive_dependents"),
            F.sum(F.when(F.col("hop") == 1, F.bit_count("bits")).otherwise(0)).alias("direct"),
            F.max("hop").alias("max_hop"),
        ]
        if flags is not None:
            rows = rows.join(self.masks(flags, *names), "word")
            counts += [F.sum(F.bit_count(bits.bitwiseAND(F.col(n)))).alias(n) for n in names]
        return rows.groupBy("id").agg(*counts)

    def behind_of_group(self, files: DataFrame, members: DataFrame, name: str) -> DataFrame:
        """``(id, name)``: of the sources ``members(id, group)``, how many of the file's own ``files(id, group)`` reach it.

        Members of one group and word are one mask, so no pair of members is built.
        """
        masks = members.join(self.numbers, "id").groupBy("group", "word").agg(F.bit_or(_bit(F.col("bit"))).alias("mask"))
        wanted = files.select("id", "group").join(masks, "group").select("id", "word", "mask")
        hits = self.levels.join(wanted, ["id", "word"])
        return hits.groupBy("id").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("mask")))).alias(name))


def bit_reach(edges: DataFrame, numbers: DataFrame) -> BitReach:
    """Search from all ``numbers(id, word, bit)`` along ``edges(src, dst)``; a source is not in its own reach."""
    start = numbers.select("id", "word", F.lit(0).alias("hop"), _bit(F.col("bit")).alias("bits"))
    onward = edges.select(F.col("src").alias("id"), "dst")
    levels: list[DataFrame] = []
    known = [start.select("id", "word", F.col("bits").alias("seen"))]
    newest, fresh, hop = start, 1, 0
    while fresh:
        hop += 1
        step = newest.select("id", "word", "bits").join(onward, "id")
        met, rows = cut_counted(step.groupBy(F.col("dst").alias("id"), "word").agg(F.bit_or("bits").alias("bits")))
        if len(known) > MERGE_AFTER:
            known = [cut(reduce(DataFrame.unionByName, known).groupBy("id", "word").agg(F.bit_or("seen").alias("seen")))]
        keys = met.select("id", "word")
        keys = F.broadcast(keys) if rows <= BROADCAST_ROWS else keys
        seen = reduce(DataFrame.unionByName, known).join(keys, ["id", "word"], "left_semi")
        seen = seen.groupBy("id", "word").agg(F.bit_or("seen").alias("seen"))
        seen = F.broadcast(seen) if rows <= BROADCAST_ROWS else seen  # no more rows than met
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        found = met.join(seen, ["id", "word"], "left").select("id", "word", F.lit(hop).alias("hop"), new.alias("bits"))
        newest, fresh = cut_counted(found.where("bits <> 0"))
        levels.append(newest)
        known.append(newest.select("id", "word", F.col("bits").alias("seen")))
    return BitReach(keep(reduce(DataFrame.unionByName, levels)), numbers)


def _of_block(rows: pa.Table, id_type: pa.DataType) -> pa.Table:
    """Rows ``(id, word, hop, bits)`` of one block, searched along its imports from its sources.

    An import is ``(src, dst, id)`` with numbers for its ends and the id of ``dst``; a source has its place in ``bit``.
    """
    src, dst, place = (rows.column(c).to_numpy() for c in ("src", "dst", "place"))
    source = place >= 0
    edge = np.flatnonzero(~source)
    nodes = np.unique(np.concatenate([src, dst[edge]]))
    tail = np.searchsorted(nodes, src[edge])
    order = np.argsort(tail, kind="stable")
    edge, tail = edge[order], tail[order]
    head = np.searchsorted(nodes, dst[edge])
    first = np.searchsorted(tail, np.arange(len(nodes) + 1))
    row_of = np.zeros(len(nodes), np.int64)  # a row that has the node's id
    row_of[head] = edge

    # The state of a node is a number per word of the block.
    base, place = int(place[source].min()) // WORD_BITS, place[source]
    width = int(place.max()) // WORD_BITS - base + 1
    seen = np.zeros(len(nodes) * width, np.uint64)
    starts = np.searchsorted(nodes, src[source]) * width + place // WORD_BITS - base
    np.bitwise_or.at(seen, starts, np.uint64(1) << (place % WORD_BITS).astype(np.uint64))
    keys = np.unique(starts)
    bits, hop, found = seen[keys], 0, []
    while True:
        node, word = keys // width, keys % width
        fan = first[node + 1] - first[node]
        at = np.repeat(first[node] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
        if not len(at):
            break
        to, sent = head[at] * width + np.repeat(word, fan), np.repeat(bits, fan)
        order = np.argsort(to, kind="stable")
        to, sent = to[order], sent[order]
        begin = np.flatnonzero(np.diff(to, prepend=-1))
        keys = to[begin]
        bits = np.bitwise_or.reduceat(sent, begin) & ~seen[keys]
        fresh = bits != 0
        keys, bits, hop = keys[fresh], bits[fresh], hop + 1
        if not len(keys):
            break
        seen[keys] |= bits
        if nodes[0] == NOWHERE:
            seen[:width] = 0
        found.append((row_of[keys // width], base + keys % width, np.full(len(keys), hop, np.int32), bits.view(np.int64)))
    at, word, hops, bits = (np.concatenate(c) for c in zip(*found)) if found else (np.array([], t) for t in ("i8", "i8", "i4", "i8"))
    columns = [rows.column("id").take(pa.array(at)).cast(id_type), word, hops, bits]
    return pa.table(columns, names=["id", "word", "hop", "bits"])


def _placed(edges: DataFrame, numbers: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, node, comp)`` of every file and end of an import, and the imports ``(src, dst, id, csrc, cdst)`` by these numbers."""
    ends = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    ids = ends.toDF("id").unionByName(numbers.select("id")).where("id IS NOT NULL").distinct()
    known = components.select("id", "comp").dropDuplicates(["id"])
    ranked, _ = global_rank(ids.join(known, "id", "left"), [F.coalesce("comp", "id"), F.col("id")], "node")
    ranked = ranked.withColumn("comp", F.coalesce("comp", "id"))
    firsts = ranked.groupBy("comp").agg(F.min("node").alias("first"))
    nodes = keep(ranked.join(firsts, "comp").select("id", "node", F.col("first").alias("comp")))
    tails = nodes.toDF("_s", "src", "csrc")
    heads = nodes.toDF("_d", "dst", "cdst")
    placed = edges.toDF("_s", "_d").join(tails, "_s").join(heads, "_d", "left")
    return nodes, keep(placed.select("src", F.coalesce("dst", F.lit(NOWHERE)).alias("dst"), F.col("_d").alias("id"), "csrc", "cdst"))


def _reached_parts(starts: DataFrame, placed: DataFrame) -> DataFrame:
    """``(block, comp)`` of every component with imports that a block of ``starts(block, comp)`` reaches, its own included."""
    importing = placed.select(F.col("csrc").alias("cdst")).distinct()
    across = placed.where("csrc <> cdst").select("csrc", "cdst").distinct().join(importing, "cdst", "left_semi")
    onward = keep(across.select(F.col("csrc").alias("comp"), F.col("cdst").alias("to")))
    newest, fresh = keep_counted(starts.distinct())
    levels = [newest]
    while fresh:
        ahead = newest.join(onward, "comp").select("block", F.col("to").alias("comp")).distinct()
        newest, fresh = keep_counted(ahead.join(reduce(DataFrame.unionByName, levels), ["block", "comp"], "left_anti"))
        levels.append(newest)
    return reduce(DataFrame.unionByName, levels)


def packed_reach(edges: DataFrame, numbers: DataFrame, components: DataFrame) -> BitReach:
    """As :func:`bit_reach`, given the strong components ``(id, comp)``: block by block where a block reaches little.

    How much a block reaches is counted before anything is sent; the sources of larger blocks are searched in rounds.
    The rows are made anew for every question, as a task makes them faster than they are written and read.
    """
    ship_package(edges.sparkSession)
    nodes, placed = _placed(edges.select("src", "dst"), numbers, components)
    block = F.shiftright("word", BLOCK_WORDS.bit_length() - 1).alias("block")
    sources = keep(numbers.join(nodes, "id").select(block, "comp", F.col("node").alias("src"), (F.col("word") * WORD_BITS + F.col("bit")).alias("place")))
    parts = _reached_parts(sources.select("block", "comp"), placed)
    sizes = placed.groupBy(F.col("csrc").alias("comp")).agg(F.count(F.lit(1)).alias("n"))
    totals = parts.join(sizes, "comp").groupBy("block").agg(F.sum("n").alias("n"))
    totals = keep(totals)
    large, many = keep_counted(totals.where(F.col("n") > BLOCK_EDGES).select("block"))
    few = totals.where(F.col("n") <= BLOCK_EDGES).select("block")
    id_type = edges.schema["dst"].dataType

    inside = parts.join(few, "block", "left_semi").join(placed.withColumnRenamed("csrc", "comp"), "comp")
    inside = inside.select("block", "src", "dst", "id", F.lit(-1).cast("long").alias("place"))
    begun = sources.join(few, "block", "left_semi")
    begun = begun.select("block", "src", F.lit(NOWHERE).cast("long").alias("dst"), F.lit(None).cast(id_type).alias("id"), "place")
    whole = keep(inside.unionByName(begun).repartition("block"))
    schema = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string("word long, hop int, bits long")])
    arrow = to_arrow_type(id_type)
    levels = whole.groupBy("block").applyInArrow(lambda rows: _of_block(rows, arrow), schema)
    if many:
        rest = numbers.withColumn("block", block).join(large, "block", "left_semi").drop("block")
        levels = levels.unionByName(bit_reach(edges, rest).levels)
    return BitReach(levels, numbers)
