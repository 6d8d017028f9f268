"""Fill-in-the-middle documents as piece tables.

A document is a short list of descriptors (buffer, start, end) over buffers that never change: its
own bytes and one buffer of sentinels. Cutting splits a descriptor, an arrangement permutes the
list, the inverse permutation restores it, and hashes stream the descriptors; no text is copied but
for the one output that is asked for.

Every row is worked on by itself in Arrow batches: no shuffle, no state, one text in memory at a time
besides its batch. Repeated rows give repeated results; ties cannot occur, as nothing is ordered.
A null text is read as empty, a null id as the empty string in the hashed key; other columns of the
input are neither read nor returned, so their names cannot clash. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from depweave.llm.common import slices
from depweave.session import ship_package

# Fixed values of the format: sentinels in one buffer, and the order of the pieces of each form.
# Pieces 0, 1, 2 are prefix, middle, suffix; 3, 4, 5 the sentinels P, S, M.
SENTINELS = b"<P><S><M>"
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((text,), [(0, 0, len(text))])

    def cut(self, *at: int) -> PieceTable:
        """Split at rising byte offsets of the document, each inside the first piece that reaches it."""
        done, rest = [], list(self.pieces)
        passed = 0
        for offset in at:
            while passed + rest[0][2] - rest[0][1] < offset:
                passed += rest[0][2] - rest[0][1]
                done.append(rest.pop(0))
            buffer, start, end = rest[0]
            middle = start + offset - passed
            done.append((buffer, start, middle))
            rest[0], passed = (buffer, middle, end), offset
        return PieceTable(self.buffers, done + rest)

    def with_sentinels(self) -> PieceTable:
        """The same pieces, then one for each sentinel."""
        no = len(self.buffers)
        marks = [(no, at, at + 3) for at in range(0, len(SENTINELS), 3)]
        return PieceTable((*self.buffers, SENTINELS), [*self.pieces, *marks])

    def permuted(self, order) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(buffer) for buffer in self.buffers]
        for buffer, start, end in self.pieces:
            yield views[buffer][start:end]

    def sha256(self) -> str:
        out = hashlib.sha256()
        for view in self.stream():
            out.update(view)
        return out.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def units(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which units (runs of ASCII letters, other code points) begin; code point starts."""
    values = np.frombuffer(text, np.uint8)
    folded = values | 32
    letter = (folded >= 97) & (folded <= 122)
    first = (values & 0xC0) != 0x80
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(first & ~inside), first


def arranged(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int):
    """Number of units, form, code points of prefix and middle, and the arranged piece table."""
    starts, first = units(text)
    n = len(starts)
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[k : k + 8], 16) for k in (0, 8, 16, 24))
    table = PieceTable.of(text)
    if not text or h3 % 100 >= rate or any(SENTINELS[k : k + 3] in text for k in (0, 3, 6)):
        return n, "plain", None, None, table
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = (int(starts[k]) if k < n else len(text) for k in cuts)
    form = "spm" if h4 % 100 < spm else "psm"
    pieces = table.cut(low, high)
    counts = (int(np.count_nonzero(first[:low])), int(np.count_nonzero(first[low:high])))
    return n, form, *counts, pieces.with_sentinels().permuted(ORDERS[form])


def restored_table(output: bytes, form: str) -> PieceTable:
    """The document of an output: cut at its sentinels, put back by the inverse permutation."""
    if form == "plain":
        return PieceTable.of(output)
    order = ORDERS[form]
    pieces = []
    marks = [output.index(SENTINELS[3 * (k - 3) : 3 * (k - 3) + 3]) for k in order if k > 2]
    for mark, stop in zip(marks, [*marks[1:], len(output)]):
        pieces += [(0, mark, mark + 3), (0, mark + 3, stop)]
    inverse = np.argsort(order)
    return PieceTable((output,), pieces).permuted(inverse[:3])


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in slices(batches):
        ids = batch.column(0).to_pylist()
        for doc_id, text in zip(ids, batch.column(1).cast(pa.binary())):
            yield doc_id, text.as_py() or b""


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 24, most: int = 2000):
    """Record batches of the rows, closed at ``most`` rows or ``size`` bytes of output text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= most or weight >= size:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field, values in zip(schema, zip(*rows)):
        if values and any(isinstance(v, bytes) for v in values):
            columns.append(pa.array(values, pa.binary()).cast(field.type))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_BASE = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def transformed(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text of each row.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of those suffix first.
    """
    schema = pa.schema([*_BASE, ("output", pa.string())])

    def work(batches):
        def rows():
            for doc_id, text in _texts(batches):
                *facts, table = arranged(doc_id, text, seed, rate, spm)
                yield (doc_id, *facts, table.bytes())

        yield from _batches(rows(), schema)

    ship_package(docs.sparkSession)
    return _input(docs).mapInArrow(work, f"{SCHEMA}, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``text`` of each ``output`` of the given ``form``; a null output or form is plain and empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches):
        def rows():
            for batch in slices(batches):
                ids, forms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc_id, form, output in zip(ids, forms, batch.column(2).cast(pa.binary())):
                    yield doc_id, restored_table(output.as_py() or b"", form or "plain").bytes()

        yield from _batches(rows(), schema)

    ship_package(outputs.sparkSession)
    chosen = outputs.select(outputs["doc_id"].cast("long").alias("doc_id"), outputs["form"], outputs["output"])
    return chosen.mapInArrow(work, "doc_id long, text string")


def digest(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """As :func:`transformed` with hashes: of the output, and of the text rebuilt from output and form."""
    schema = pa.schema([*_BASE, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def work(batches):
        def rows():
            for doc_id, text in _texts(batches):
                *facts, table = arranged(doc_id, text, seed, rate, spm)
                back = restored_table(table.bytes(), facts[1])
                yield (doc_id, *facts, table.sha256(), back.sha256())

        yield from _batches(rows(), schema)

    ship_package(docs.sparkSession)
    return _input(docs).mapInArrow(work, f"{SCHEMA}, output_sha256 string, restored_sha256 string")
