"""Spelling variants: words one edit apart, found by a frontier of states over a relational trie.

The trie is two tables. ``stops`` has, for each word, the nodes on its path that matter (where the
trie branches or a word ends); chains between them are compressed. ``edges`` has one row for each
edge: its parent, its label, its child, whether a word ends at the child, and a 64-bit mask of
the letters that follow the child. A state is (word, target, position, node): ``target`` is what the word
has become by its one edit, of which ``position`` letters are read. A round joins all states with the edges on
(node, next letter), whatever level they are on; a state whose target is read to its end at a node where
a word ends is a neighbour. Rounds end when no state is left.

*Two tries.* Two words one edit apart share at least half of their letters as prefix or as suffix. So
each word is entered forwards and backwards, and a trie begins only at half a word's length: the
nodes near the root, which every word passes and which branch into the whole alphabet, do not exist.
A word's path before its edit is its own, so states without an edit are its own ``stops``; the edit is
made at the first letter where the two words differ, which is a branching node. Replacements are made
towards the smaller letter and letters are only deleted, as each pair is then met from one end.

*Size.* Every table grows with the words times their length; no all-pairs step exists, and no group is
collected but the stops of one word. A node that many words pass is a hot key of one side of an
inner join only (at most one edge for each letter on the other), which AQE splits. Nodes are 64-bit
hashes; two that fall together only add states, as every found pair is looked up as text in the end.
Each round is written to the shared folder, so a lost executor costs one round.

Odd rows: a null text has no words, a null id is the empty string in the hashed key, repeated rows
count each, ties of the largest ``n`` go to the smaller word, an empty table gives an empty one; columns
other than ``doc_id`` and ``text`` are not read. Very long words take part like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import ascii_lower, mix
from depweave.session import keep, keep_counted, ship_package

# What a word is.
LEAST_LETTERS = 7
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"
DROP_EVERY = 31
LEAST_COUNT = 2
# A form is so many times as frequent as the word.
FACTOR = 10


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n``: the words after the seeded deletions, with their occurrences.

    Runs shorter than a word cannot become one and are not even cut out.
    """
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    runs = F.regexp_extract_all(docs["text"].cast("string"), F.lit(RUN), F.lit(0))
    found = docs.select(key.alias("doc"), F.explode(runs).alias("run"))
    found = found.select("doc", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8"))
    size = F.char_length("run")
    at = F.pmod(F.col("h"), size).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    found = found.withColumn("h", h)
    found = found.select(F.when(F.pmod("h", F.lit(DROP_EVERY)) == 0, less).otherwise(F.col("run")).alias("word"))
    counted = found.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _nodes(words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes from half the length on, and how many each word has.

    A prefix is hashed as a polynomial of its letters, from one running sum over all the words.
    """
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, _ODD, np.uint64))
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix(letters + np.uint64(side << 32)) * powers[place], out=sums[1:])
    lows = np.maximum(0, (sizes - 2) // 2)
    counts = sizes - lows + 1
    ends = np.cumsum(counts)
    depth = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(lows, counts)
    of = np.repeat(starts, counts)
    return mix(mix(sums[of + depth] - sums[of]) ^ depth.astype(np.uint64)), counts


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word forwards and backwards with its prefixes' nodes."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        for side, texts in ((0, words), (1, [w[::-1] for w in words])):
            nodes, counts = _nodes(texts, side)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "text": pa.array(texts, pa.string()),
                    "side": pa.array(np.full(len(texts), side, np.int32)),
                    "nodes": pa.ListArray.from_arrays(offsets, pa.array(nodes.view(np.int64))),
                }
            )


def _letter(text: Column, at: Column) -> Column:
    """The letter at a place counted from zero; empty behind the end."""
    return F.substring(text, at + 1, F.lit(1))


def _bit(letter: Column) -> Column:
    """The bit of a letter in a mask of letters; zero for none."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter).bitwiseAND(F.lit(63)))
    return F.when(letter != "", one).otherwise(F.lit(0).cast("long"))


def _has(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(bit) != 0


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stops`` (text, side, stops: place, node, end, mask) and ``edges`` of both tries over a column ``word``."""
    ship_package(words.sparkSession)
    paths = keep(words.select("word").mapInArrow(_paths, "text string, side int, nodes array<long>"))
    low = F.char_length("text") - F.size("nodes") + 1
    steps = paths.select("text", "side", low.alias("low"), F.posexplode("nodes").alias("k", "node"))
    steps = steps.withColumn("place", F.col("low") + F.col("k"))
    letter = _letter(F.col("text"), F.col("place"))
    nodes = steps.select("node", letter.alias("next")).groupBy("node").agg(
        F.min(F.when(F.col("next") != "", F.col("next"))).alias("a"),
        F.max(F.col("next")).alias("b"),
        F.bool_or(F.col("next") == "").alias("end"),
        F.bit_or(_bit(F.col("next"))).alias("mask"),
    )
    nodes = nodes.where(F.col("end") | (F.col("a") != F.col("b"))).select("node", "end", "mask")
    stop = F.struct("place", "node", "end", "mask")
    stops = steps.select("text", "side", "place", "node").join(nodes, "node")
    stops = keep(stops.groupBy("text", "side").agg(F.array_sort(F.collect_list(stop)).alias("stops")))
    following = F.expr(
        "transform(slice(stops, 1, size(stops) - 1), (s, i) -> struct(s.node AS parent, "
        "substring(text, s.place + 1, stops[i + 1].place - s.place) AS label, stops[i + 1].node AS child, "
        "stops[i + 1].end AS end, stops[i + 1].mask AS mask))"
    )
    edges = stops.select(F.explode(following).alias("e")).select("e.*").distinct()
    first, second = F.substring("label", 1, 1), F.substring("label", 2, 1)
    return stops, keep(edges.select("parent", first.alias("letter"), second.alias("second"), "label", "child", "end", "mask"))


_STATE = ("text", "side", "target", "place", "node", "done")


def _advanced(rows: DataFrame) -> DataFrame:
    """States behind a label, of those whose target goes on as the label says and can be finished there."""
    rows = rows.where(F.substring(F.col("target"), F.col("place") + 1, F.char_length("label")) == F.col("label"))
    rows = rows.withColumn("place", F.col("place") + F.char_length("label"))
    done = F.col("place") == F.char_length("target")
    rows = rows.withColumn("done", done).withColumn("node", F.col("child"))
    alive = F.when(F.col("done"), F.col("end")).otherwise(
        _has(F.col("mask"), _bit(_letter(F.col("target"), F.col("place"))))
    )
    return rows.where(alive).select(*_STATE)


def _edited(stops: DataFrame, edges: DataFrame) -> DataFrame:
    """The first states: one letter replaced by a smaller one or deleted, where another branch allows it."""
    text, place = F.col("text"), F.col("place")
    own = stops.select("text", "side", F.explode("stops").alias("s")).select(
        "text", "side", F.col("s.place").alias("place"), F.col("s.node").alias("parent"), F.col("s.end").alias("ends")
    )
    size = F.char_length("text")
    own = own.where((place >= F.floor((size - 1) / 2)) & (place < size))
    own = own.select("*", *[_letter(text, place + i).alias(f"w{i}") for i in range(3)])
    own = own.select("*", _bit(F.col("w1")).alias("b1"), _bit(F.col("w2")).alias("b2"))
    c, second, mask, end = (F.col(x) for x in ("letter", "second", "mask", "end"))

    def goes_on(i: int) -> Column:
        """Whether the branch can go on with the word's letter ``i``."""
        w, bit = F.col(f"w{i}"), F.col(f"b{i}")
        return F.when(second != "", second == w).when(w == "", end).otherwise(_has(mask, bit))

    replaced = (c < F.col("w0")) & goes_on(1)
    deleted = (c == F.col("w1")) & (c != F.col("w0")) & goes_on(2)
    met = own.join(edges, "parent").where(replaced | deleted)
    before, behind = F.substring(text, F.lit(1), place), F.substring(text, place + 2, size)
    targets = F.array(
        F.when(replaced, F.concat(before, c, behind)), F.when(deleted, F.concat(before, behind))
    )
    met = met.withColumn("target", F.explode(F.filter(targets, lambda t: t.isNotNull())))
    shorter = own.where((place == size - 1) & F.col("ends")).select(
        "text", "side", before.alias("target"), "place", F.col("parent").alias("node"), F.lit(True).alias("done")
    )
    return _advanced(met).unionByName(shorter)


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``b``: each pair of distinct words (a column ``word`` without repeats) that are one edit apart, once."""
    stops, edges = trie(words)
    states, rows = keep_counted(_edited(stops, edges))
    found = states.where("done")
    while rows:
        live = states.where(~F.col("done")).withColumn("letter", _letter(F.col("target"), F.col("place")))
        step = live.withColumnRenamed("node", "parent").drop("done").join(edges, ["parent", "letter"])
        states, rows = keep_counted(_advanced(step))
        found = found.unionByName(states.where("done"))

    def forward(name: str) -> Column:
        return F.when(F.col("side") == 1, F.reverse(name)).otherwise(F.col(name))

    return found.select(forward("text").alias("a"), forward("target").alias("b")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` of each word that has a form. Each form is ten times as frequent, so paths are short."""
    step = links.select(F.col("word").alias("root"), F.col("form").alias("further"))
    done, rows = keep_counted(links.select("word", F.col("form").alias("root")))
    ended = None
    while rows:
        moved = keep(done.join(step, "root", "left"))
        last = moved.where("further IS NULL").select("word", "root")
        ended = last if ended is None else ended.unionByName(last)
        done, rows = keep_counted(moved.where("further IS NOT NULL").select("word", F.col("further").alias("root")))
    return ended if ended is not None else done


def variants(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of a table of distinct ``word`` with ``n``."""
    words = keep(words.select("word", "n"))
    counts = [words.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab"]
    pairs = keep(one_edit_pairs(words).join(counts[1], "b").join(counts[0], "a"))
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("n_b").alias("form_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("form"), F.col("n_a").alias("form_n"))
    )
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("s"), "form")).alias("best")
    )
    out = words.join(best, "word", "left")
    holds = -F.col("best.s") >= FACTOR * F.col("n")
    out = keep(
        out.select(
            "word", F.when(holds, F.col("best.form")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, -F.col("best.s")).alias("form_n"),
        )
    )
    roots = _roots(out.where("form IS NOT NULL").select("word", "form"))
    out = out.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The variants of the words of all documents."""
    return variants(vocabulary(docs))
