"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import ngram_hashes, slices, word_hashes
from depweave.session import keep, ship_package

WINDOW = 10
# Words of a block of the shift table.
BLOCK = 2
# Slots of a shift table.
SLOTS = 1 << 18
# Item text that one set of tables holds; larger benchmarks are searched in several passes.
ITEM_BYTES = 32 << 20

# ASCII characters that are no letters or digits part words.
_GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Small letters (A-Z only), digits and other scripts; blanks for all other characters."""
    return (text or "").encode().lower().translate(_GAPS)


class Tables:
    """Shift table, suffix buckets and test strings for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length = length
        self.block = min(BLOCK, length)
        self.patterns = patterns
        names = list(patterns)
        hashes = np.array([word_hashes(b" ".join(p))[0] for p in names])
        # From a block of text, how far the end of the search window may move at least.
        self.shift = np.full(SLOTS, length - self.block + 1, np.int64)
        grams = np.array([ngram_hashes(h, self.block) for h in hashes])
        for at in range(grams.shape[1]):
            slots = (grams[:, at] % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(self.shift, slots, grams.shape[1] - 1 - at)
        # Patterns whose last block has a hash, each with the hash of its first block as a pretest.
        self.buckets: dict[int, list[tuple[int, tuple[bytes, ...]]]] = {}
        for name, row in zip(names, grams):
            self.buckets.setdefault(int(row[-1]), []).append((int(row[0]), name))

    def find(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, tuple[bytes, ...]]]:
        """First word and pattern of each occurrence."""
        grams = ngram_hashes(hashes, self.block)
        shifts = self.shift[(grams % np.uint64(SLOTS)).astype(np.int64)].tolist()
        first = self.length - self.block
        at, end, out = first, len(shifts), []
        while at < end:
            move = shifts[at]
            if move:
                at += move
                continue
            start = at - first
            bucket = self.buckets.get(int(grams[at]))
            if bucket:
                head = int(grams[start])
                for prefix, name in bucket:
                    if prefix != head:
                        continue
                    if tuple(raw[starts[start] : ends[start + self.length - 1]].split()) == name:
                        out.append((start, name))
            at += 1
        return out


class Matcher:
    """Tables for all lengths of a set of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for item_id, text in items:
            found = plain(text).split()
            size = min(WINDOW, len(found))
            for at in range(len(found) - size + 1 if size else 0):
                owners = by_length.setdefault(size, {}).setdefault(tuple(found[at : at + size]), set())
                if item_id is not None:
                    owners.add(item_id)
        self.tables = [Tables(n, patterns) for n, patterns in sorted(by_length.items())]

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, ranges of words that occurrences cover, in order, and ids of their items."""
        raw = plain(text)
        hashes, starts, ends = word_hashes(raw)
        ranges, owners = [], set()
        for table in self.tables:
            for start, name in table.find(raw, hashes, starts, ends):
                ranges.append((start, start + table.length))
                owners |= table.patterns[name]
        return len(hashes), sorted(ranges), owners


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))])
FOUND = "struct<n_words:long,ranges:array<array<int>>,items:array<long>>"


def _search(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(packed.value)
        for batch in slices(batches, 2000):
            found = []
            before = batch.column("before").to_pylist()
            for text, old in zip(batch.column("text").to_pylist(), before):
                n_words, ranges, owners = matcher.search(text)
                if old:
                    ranges = sorted(ranges + [tuple(r) for r in old["ranges"]])
                    owners |= set(old["items"])
                found.append({"n_words": n_words, "ranges": merged(ranges), "items": sorted(owners)})
            columns = [batch.column(c) for c in batch.schema.names if c != "before"]
            names = [c for c in batch.schema.names if c != "before"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _FOUND)], names=[*names, "before"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``found``: ``n_words``, ``ranges`` of hit words, ``items``.

    ``benchmark`` has ``item_id`` and ``text``. A pattern is ten consecutive words of an item, or
    all words of a shorter one. Items are cut into blocks of at most ``ITEM_BYTES`` of text by the
    hash of their id and text; each block is sent to the tasks as compiled tables, of bounded size,
    and all documents are searched for it. One block, the usual case, needs no shuffle at all; more
    blocks are passes over the written result of the pass before.

    Null and wordless texts have no words and no hits. Null and wordless items have no patterns; an
    item without an id hits words but is not named. Repeated rows and items change nothing else.
    """
    spark = docs.sparkSession
    ship_package(spark)
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // ITEM_BYTES) if total > ITEM_BYTES else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    work = work.withColumn("before", F.lit(None).cast(FOUND))
    for block in range(blocks):
        rows = benchmark.where(part == block).select(F.col("item_id").cast("long"), "text").distinct().collect()
        packed = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])
        work = work.mapInArrow(_search(packed), work.schema)
        if block < blocks - 1:
            work = keep(work)
    return work.select("row", F.col("before").alias("found"))


def n_hit(found: Column) -> Column:
    return F.aggregate(found["ranges"], F.lit(0).cast("long"), lambda n, r: n + (r[1] - r[0]))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query."""
    found = search(docs.select("doc_id", "text"), benchmark).select(F.col("row")["doc_id"].alias("doc_id"), "found")
    names = F.array_sort(F.transform(F.col("found")["items"], lambda i: i.cast("string")))
    return found.select(
        "doc_id", F.col("found")["n_words"].alias("n_words"), n_hit(F.col("found")).alias("n_hit"),
        F.size(F.col("found")["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size(F.col("found")["ranges"]) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    found = search(docs, benchmark).where(F.size(F.col("found")["ranges"]) == 0)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
