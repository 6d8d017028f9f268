"""Removal of long passages that repeat across documents, located by Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm import bloom
from depweave.llm.common import ngram_hashes, slices, some_id, window_hashes, word_hashes, words
from depweave.session import keep, keep_counted, ship_package

WINDOW = 50
# Words of a phrase, the pattern of the automata. Each window holds WINDOW - PHRASE + 1 phrases.
PHRASE = 8
SPAN = WINDOW - PHRASE + 1
# Text that is streamed through one automaton; its patterns are phrases of that text, so the
# automaton is bounded as well.
BLOCK_BYTES = 8 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchors(grams: np.ndarray) -> np.ndarray:
    """In each window the first position of the smallest value."""
    view = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    return view.argmin(axis=1) + np.arange(len(view))


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrase with the smallest hash of each window: hash, phrase, block, and range of ids."""
    for batch in slices(batches, 2000):
        found: dict[tuple[int, bytes], list[int]] = {}
        for block, nid, text in zip(*(batch.column(c).to_pylist() for c in ("block", "nid", "text"))):
            raw = text.encode()
            hashes, starts, ends = word_hashes(raw)
            if len(hashes) < WINDOW:
                continue
            grams = ngram_hashes(hashes, PHRASE)
            for at in np.unique(_anchors(grams)).tolist():
                key = (block, b" ".join(raw[starts[at] : ends[at + PHRASE - 1]].split()))
                seen = found.get(key)
                if seen is None:
                    found[key] = [nid, nid, int(grams[at])]
                else:
                    seen[0] = min(seen[0], nid)
                    seen[1] = max(seen[1], nid)
        values = list(found.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([v[2] for v in values], np.uint64).view(np.int64)),
                pa.array([k[1] for k in found], pa.binary()),
                pa.array([k[0] for k in found], pa.int32()),
                pa.array([v[0] for v in values], pa.int64()),
                pa.array([v[1] for v in values], pa.int64()),
            ],
            names=["gram", "phrase", "block", "lo", "hi"],
        )


RUNS = pa.schema(
    [
        ("nid", pa.int64()), ("row", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()),
        ("off", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("hashes", pa.list_(pa.int64())),
    ]
)


def _located(docs: pa.Table, patterns: pa.Table) -> pa.Table:
    """Stream a block's texts through the automaton of its recurring phrases.

    A window that holds a located phrase is anchored at the one with the smallest hash, the first
    of equals. Neighbouring windows with one anchor form a run, which comes out with the hashes of
    its windows.
    """
    import ahocorasick

    out: list[list] = [[] for _ in RUNS]
    if len(docs) and len(patterns):
        automaton = ahocorasick.Automaton()
        for phrase, gram in zip(patterns.column("phrase").to_pylist(), patterns.column("gram").to_pylist()):
            automaton.add_word(" " + phrase.decode() + " ", gram)
        automaton.make_automaton()
        for nid, row, text in zip(*(docs.column(c).to_pylist() for c in ("nid", "row", "text"))):
            raw = b" ".join(text.encode().split())
            n_words = raw.count(b" ") + 1
            if n_words < WINDOW:
                continue
            plain = raw.decode()
            hits = list(automaton.iter(" " + plain + " "))
            if not hits:
                continue
            ends = np.cumsum(np.fromiter(map(len, plain.split(" ")), np.int64, n_words) + 1)
            at = np.searchsorted(ends, np.array([e for e, _ in hits])) - (PHRASE - 1)
            grams = np.full(n_words - PHRASE + 1, NONE, np.uint64)
            grams[at] = np.array([g for _, g in hits], np.int64).view(np.uint64)
            anchor = _anchors(grams)
            windows = window_hashes(word_hashes(raw)[0], WINDOW).view(np.int64)
            starts = np.flatnonzero(np.diff(anchor, prepend=-1))
            stops = np.append(starts[1:], len(anchor))
            for lo, hi in zip(starts.tolist(), stops.tolist()):
                where = int(anchor[lo])
                if grams[where] == NONE:
                    continue
                values = (
                    nid, row, lo, hi - lo, int(grams[where : where + 1].view(np.int64)[0]), where - lo,
                    int(windows[lo]), int(windows[hi - 1]), windows[lo:hi],
                )
                for column, value in zip(out, values):
                    column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, RUNS)], schema=RUNS)


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Word ranges to remove: ``nid``, ``row`` (hash of the text), ``ranges`` (array of lo, hi).

    1. Winnowing: each window of 50 words names its phrase of 8 words with the smallest hash, about
       one phrase in 22 words. Two equal windows name the same phrase, so only windows that name
       a phrase of two documents can recur.
    2. Recurring phrases go back to the blocks of text that hold them; a bounded Bloom filter keeps
       the others from being shuffled. Each block compiles its own automaton, so all automata
       together hold no more patterns than the corpus has phrases, and each text is streamed once.
    3. Located phrases anchor windows. Runs of windows with one anchor are confirmed as a whole:
       the hashes of their first and last window cover every word. A run that a smaller document
       holds goes; for the smallest holder the single windows are compared, and only among the
       different runs of an anchor.

    Phrases, runs and windows are counted with partial aggregates, so a passage in a third of all
    documents sends one row per task; joins back have unique keys on one side, and AQE splits the
    other. No group of documents ever meets in one task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    slim = docs.select(
        some_id(F.col(doc_id)).alias("nid"), F.xxhash64(body).alias("row"), body.alias("text")
    ).withColumn("block", F.pmod(F.xxhash64("nid", "row"), F.lit(blocks)).cast("int"))

    named = keep(
        slim.select("block", "nid", "text").mapInArrow(
            _phrases, "gram long, phrase binary, block int, lo long, hi long"
        )
    )
    shared = named.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared, n = keep_counted(shared.where(F.col("lo") < F.col("hi")).select("gram"))
    table, parts = bloom.build(shared, "gram", n)
    likely = bloom.possible(named, F.col("gram"), table, parts, "_likely").where("_likely")
    patterns = likely.select("gram", "phrase", "block").distinct().join(shared, "gram", "left_semi")

    schema = (
        "nid long, row long, lo int, n int, anchor long, off int, first long, last long, hashes array<long>"
    )
    runs = keep(
        slim.groupBy("block").cogroup(patterns.groupBy("block")).applyInArrow(_located, schema)
    )
    key = ["anchor", "off", "n", "first", "last"]
    holders = keep(runs.groupBy(*key).agg(F.min("nid").alias("owner")))
    whole = runs.select("nid", "row", "lo", *key).join(holders, key).where(F.col("nid") > F.col("owner"))
    several = holders.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    owned = runs.join(holders.join(several, "anchor", "left_semi"), key).where(F.col("nid") == F.col("owner"))
    single = keep(
        owned.select("nid", "row", "lo", "anchor", "off", F.posexplode("hashes").alias("pos", "h")).select(
            "nid", "row", (F.col("lo") + F.col("pos")).alias("lo"), "anchor", (F.col("off") - F.col("pos")).alias("off"), "h"
        )
    )
    window = ["anchor", "off", "h"]
    earliest = single.groupBy(*window).agg(F.min("nid").alias("owner"), F.max("nid").alias("other"))
    recurring, n = keep_counted(earliest.where(F.col("owner") < F.col("other")).select(*window, "owner"))
    digest_of = F.xxhash64(*window)
    table, parts = bloom.build(recurring.select(digest_of.alias("w")), "w", n)
    likely = bloom.possible(single, digest_of, table, parts, "_likely").where("_likely").drop("_likely")
    again = likely.join(recurring, window).where(F.col("nid") > F.col("owner"))
    cover = whole.select("nid", "row", "lo", (F.col("lo") + F.col("n") + WINDOW - 1).alias("hi")).unionByName(
        again.select("nid", "row", "lo", (F.col("lo") + WINDOW).alias("hi"))
    )
    return cover.groupBy("nid", "row").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))


def _gaps(n: Column) -> Column:
    """The stretches that sorted ranges leave."""
    piece = "struct<lo:int,n:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{piece}>").alias("out"))

    def add(acc: Column, upto: Column) -> Column:
        gap = F.struct(acc["at"].alias("lo"), (upto - acc["at"]).cast("int").alias("n"))
        return F.when(upto > acc["at"], F.array_append(acc["out"], gap)).otherwise(acc["out"])

    return F.aggregate(
        F.col("ranges"), start,
        lambda acc, r: F.struct(F.greatest(acc["at"], r["hi"]).alias("at"), add(acc, r["lo"]).alias("out")),
        lambda acc: add(acc, n.cast("int")),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` for each row of ``docs``.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller
    id. Windows are judged on the input. A null text has no words; texts under 50 words stay. A
    null id counts as larger than all others. Rows that share an id do not count against each
    other. Repeated rows give repeated results.
    """
    ranges = repeats(docs, text, doc_id).withColumnRenamed("nid", "_n").withColumnRenamed("row", "_r")
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumns(
        {"nid": some_id(F.col("doc_id")), "row": F.xxhash64("text")}
    )
    joined = base.join(
        ranges.hint("shuffle_hash"), (F.col("nid") == F.col("_n")) & (F.col("row") == F.col("_r")), "left"
    ).select("doc_id", "ranges", words(F.col("text")).alias("w"))
    left = F.when(F.col("ranges").isNull(), F.col("w")).otherwise(
        F.flatten(F.transform(_gaps(F.size("w")), lambda g: F.slice("w", g["lo"] + 1, g["n"])))
    )
    kept = joined.select("doc_id", F.size("w").alias("n"), left.alias("left"))
    return kept.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        (F.col("n") - F.size("left")).cast("long").alias("n_removed"),
        F.array_join("left", " ").alias("kept_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
