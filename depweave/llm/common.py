"""What the corpus operators share: tables, words, numpy hashing, histograms of keys."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Blanks between words (space, tab to carriage return) and the words themselves.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Stands for a missing document id: it sorts behind every given id.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def some_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_27, _30, _31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x + _GOLDEN
    x ^= x >> _30
    x *= _MIX_A
    x ^= x >> _27
    x *= _MIX_B
    x ^= x >> _31
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(256, dtype=np.uint64))
_SPACE = re.compile(rb"[ \t-\r]")
# Bytes that are hashed at once; longer texts are cut at blanks.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(values) + 2, bool)
    np.take(_BLANK, values, out=blank[1:-1], mode="clip")
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _tables(max(PIECE, 1 << (len(raw)).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    spread = np.take(_BYTES, values)
    spread *= up[: len(values)]
    np.cumsum(spread, out=sums[1:])
    found = sums[ends]
    found -= sums[starts]
    found *= down[starts]
    return mix(found ^ (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a text: polynomials of its bytes, from running sums."""
    parts, at = [], 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > PIECE:
            cut = _SPACE.search(raw, at + PIECE)
            stop = cut.start() if cut else stop
        hashes, starts, ends = _piece(raw[at:stop])
        parts.append((hashes, starts + at, ends + at))
        at = stop
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Record batches in pieces, so that what a task makes of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive values; equal runs have equal hashes."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= _BASE
        out += h[i : i + size]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a sort is faster here than the hash table of ``np.unique``."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """As :func:`ngram_hashes` for long windows: two passes whatever ``n`` is."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    base = int(_BASE)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * _powers(base, len(h)), out=sums[1:])
    inverse = _powers(pow(base, -1, 1 << 64), size)
    return mix((sums[n:] - sums[:size]) * inverse)
