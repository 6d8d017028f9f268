"""Token ids as Arrow files of equal-length sequences with masks, written and read back in tasks."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import ensure_checkpoint_dir, keep, ship_package

TOKENIZER = "word_bpe_49k.json"
END = 2
# Ids of a sequence, and sequences of a record batch.
LENGTH = 1024
BATCH = 512
# Words whose ids a worker remembers, in two generations of so many each.
REMEMBERED = 400_000


# How the tokenizer prepares a word of ASCII and Latin-1 letters, once it is lowered: no letter composes, and these are the parts.
PLAIN = re.compile(r"[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF]+")
PREPARED = "4e11f29683c10bed"


def _byte_letters() -> dict[int, str]:
    """Bytes, as Latin-1 characters, that the byte-level alphabet writes as another letter."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in same)}


LETTERS = _byte_letters()


class Encoder:
    """Ids of whole texts by the tokenizer library; a word's ids are worked out once.

    Words are what stands between ASCII white space. The tokenizer composes, lowers, and parts a text
    inside such words only: white space neither composes with a letter nor is part of a token, and no
    special token holds any. So the ids of a text are those of its words, one after the other. A word of ASCII and
    Latin-1 letters is lowered and parted here and each part's ids are asked of the library's model; any other word, one
    that may hold a special token, and all words of a tokenizer that prepares texts otherwise are encoded by the library as they stand.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.model = self.tokenizer.model
        self.parted = _prepared(self.tokenizer) == PREPARED
        # Ids of a word as the bytes of 32-bit numbers, which join without a Python number for each.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(LETTERS)
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def _learn(self, words: set[bytes]) -> None:
        if len(self.parts) > REMEMBERED // 2:
            self.parts = {}
        new, part = [], self._part
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                plain = word.decode()
                if self.parted and b"<|" not in word and PLAIN.fullmatch(plain):
                    plain = plain.lower()
                    ids = part(plain) if plain.isalpha() else b"".join(map(part, PART.findall(plain)))
                else:
                    new.append(word)
                    continue
            self.known[word] = ids
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update((word, array("I", x.ids).tobytes()) for word, x in zip(some, found))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), with the end id."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        cut = [text.split() for text in texts]
        self._learn(set(itertools.chain.from_iterable(cut)) - self.known.keys())
        known, end = self.known, array("I", [END]).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, np.uint32) for words in cut]


def _prepared(tokenizer) -> str:
    """Tells by a hash how a tokenizer prepares texts for its model, and its special tokens."""
    form = json.loads(tokenizer.to_str())
    kept = [form["normalizer"], form["pre_tokenizer"], form["post_processor"], form["added_tokens"], form["model"]["type"]]
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:16]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def id_type(file: str) -> pa.DataType:
    return pa.uint16() if encoder(file).tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()


def open_store(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def schema(kind: pa.DataType, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Packs ids into sequences; the last one of a file is filled up with zeros, masked out."""

    def __init__(self, sink, kind: pa.DataType, length: int = LENGTH):
        self.kind, self.length = kind, length
        self.writer = pa.ipc.new_file(sink, schema(kind, length))
        self.open: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.length * BATCH:
            self._flush(self.waiting // self.length * self.length)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.open) if self.open else np.empty(0, np.uint32)
        self.open, self.waiting = [flat[n:]], max(0, len(flat) - n)
        now = flat[:n]
        rows = -(-n // self.length)
        for lo in range(0, rows, BATCH):
            hi = min(rows, lo + BATCH)
            piece = now[lo * self.length : hi * self.length]
            full = np.zeros((hi - lo) * self.length, np.uint32)
            full[: len(piece)] = piece
            mask = np.arange(len(full)) < len(piece)
            ids = pa.array(full.astype(self.kind.to_pandas_dtype()))
            self.writer.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(ids, self.length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                    ],
                    schema=schema(self.kind, self.length),
                )
            )

    def close(self) -> None:
        self._flush(self.waiting)
        self.writer.close()


def sequences(source) -> list[np.ndarray]:
    """The ids of each record batch of a file as one flat view; nothing is copied from a memory map."""
    reader = pa.ipc.open_file(source)
    return [reader.get_batch(i).column(0).flatten().to_numpy() for i in range(reader.num_record_batches)]


def sequence(source, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence: all batches but the last hold equally many, so it is found at once."""
    reader = pa.ipc.open_file(source)
    per = reader.get_batch(0).num_rows
    batch = reader.get_batch(at // per)
    return batch.column(0)[at % per].values.to_numpy(), batch.column(1)[at % per].values.to_numpy(zero_copy_only=False)


def _written(folder: str, file: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = open_store(folder)
        code, kind = encoder(file), id_type(file)
        name = f"{root}/part-{part:06d}"
        own = f"{root}/_attempt-{part:06d}-{attempt}"
        ids, starts, sizes, at = [], [], [], 0
        writer = sink = None
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for lo in range(0, len(batch), 200):
                texts = code.encode(column[lo : lo + 200].to_pylist())
                if writer is None:
                    sink = store.open_output_stream(own + ".arrow")
                    writer = SequenceWriter(sink, kind, length)
                for doc_id, tokens in zip(batch.column("doc_id")[lo : lo + 200].to_pylist(), texts):
                    writer.add(tokens)
                    ids.append(doc_id)
                    starts.append(at)
                    sizes.append(len(tokens))
                    at += len(tokens)
        if writer is None:
            return
        writer.close()
        sink.close()
        with store.open_output_stream(own + ".index") as out, pa.ipc.new_file(out, INDEX) as index:
            index.write_table(pa.table([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        # A repeated task has the same rows, so whichever attempt comes last leaves the same files.
        for end in (".arrow", ".index"):
            store.move(own + end, name + end)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64())],
            names=["part", "name", "n_ids", "n_docs"],
        )

    return run


def write(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", file: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the manifest of the files.

    Texts are range-partitioned by id (and by a hash of the text, should one id hold many rows) and
    sorted, and each task writes one file: an Arrow file of record batches of fixed-size lists,
    ``ids`` and ``mask``, and an index of its documents. Files are written under the name of the
    attempt and renamed when whole. A task holds one batch of sequences, never its file.

    The manifest has ``part``, ``name``, ``n_ids``, ``n_docs`` and ``base``, the ids before the file.
    Null texts are empty and have the end id only. Rows without an id come last. Repeated rows are
    written each. An empty table gives no file.
    """
    spark = docs.sparkSession
    ship_package(spark)
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    files = keep(ranged.mapInArrow(_written(folder, file, length), "part int, name string, n_ids long, n_docs long"))
    # One row per file.
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    return files.withColumn("base", before)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        local = store.type_name == "local"
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                source = pa.memory_map(name + ".arrow") if local else store.open_input_file(name + ".arrow")
                flat = sequences(source)
                with store.open_input_file(name + ".index") as f:
                    index = pa.ipc.open_file(f).read_all()
                bounds = np.cumsum([0, *map(len, flat)])
                starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                sums = []
                for lo, n in zip(starts.tolist(), sizes.tolist()):
                    crc, at, hi = 0, int(np.searchsorted(bounds, lo, "right")) - 1, lo + n
                    while lo < hi:
                        stop = min(hi, int(bounds[at + 1]))
                        piece = flat[at][lo - bounds[at] : stop - bounds[at]]
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        lo, at = stop, at + 1
                    sums.append(crc)
                yield from pa.table(
                    {
                        "doc_id": index.column("doc_id"), "start": pa.array(starts + base, pa.int64()),
                        "n_tokens": index.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64()),
                    }
                ).to_batches(max_chunksize=10_000)

    return run


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Each file is one task's: the manifest, one short row per file, is spread evenly.
    """
    files = manifest.count()
    spread = manifest.select("part", "name", "base").repartitionByRange(max(1, files), "part")
    return spread.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    """The query: written below the shared folder, then read back."""
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_back(write(docs, folder), folder)
