"""N-gram Jaccard join by parity sketches, a pigeonhole join per size band, and exact checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.llm import bloom
from depweave.llm.common import NO_ID, distinct, mix, ngram_hashes, slices, some_id, word_hashes
from depweave.llm.components import connected
from depweave.session import keep, keep_counted, ship_package

SHINGLE = 5
# Sets smaller than this use one cell per shingle; larger ones CELL_SHARE cells for each shingle.
WHOLE_BELOW = 64
CELL_SHARE = 0.3
# Rows of the sample that tells frequent shingles, and how many are told at most. They only order
# the cells: results do not depend on them.
SAMPLE_ROWS = 20_000
FREQUENT = 200_000
# Sets a task remembers to have sent its keys for; a copy of a forgotten one only sends them again.
SEEN = 20_000
# Bits of the numbers of sets.
NODE_MASK = (1 << 63) - 1


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words; of all words if there are fewer."""
    hashes = word_hashes(text.encode().lower())[0]
    if not len(hashes):
        return hashes
    return distinct(ngram_hashes(hashes, min(SHINGLE, len(hashes))))


def _uppers() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


# Largest size of each band.
UPPERS = _uppers()


def sketch(values: np.ndarray) -> bytes:
    """Each value flips one bit; equal values cancel. At least two bits for each value, a power of two.

    With so many, two values seldom meet in a bit, so the bound is close to the difference itself.
    """
    bits = max(128, 2 << max(0, int(len(values) - 1).bit_length()))
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer folded to the length of the shorter.

    It never exceeds the symmetric difference of the sets, as a value flips one bit on each side.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """1 for each value that is frequent, else 0."""
    if not len(frequent):
        return np.zeros(len(values), np.uint64)
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    return (frequent[at] == values).astype(np.uint64)


def _cells(spread: np.ndarray, common: np.ndarray, cells: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Number and XOR of each cell that holds a value, rare values first; any order inside a cell gives its XOR."""
    if cells is None:
        number = (spread >> np.uint64(1)) | (common << np.uint64(63))
    else:
        number = spread % np.uint64(cells) + common * np.uint64(cells)
    short = cells is not None and cells < 1 << 15  # 16-bit numbers are sorted by radix
    order = np.argsort(number.astype(np.uint16), kind="stable") if short else np.argsort(number)
    number = number[order]
    first = np.ones(len(number), bool)
    np.not_equal(number[1:], number[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    return number[starts], np.bitwise_xor.reduceat(spread[order], starts)


def signatures(values: np.ndarray, frequent: np.ndarray, whole: frozenset[int]) -> tuple[np.ndarray, list[int]]:
    """Keys of a set, and the bands in which its cells are too few to promise a common key.

    In the band of the larger of two sets that link, at most ``d`` cells differ, as a value that
    only one of them has spoils one cell. So among the first ``d + 1`` cells of either, in the
    order of their numbers, is one that agrees, and it is among them for both.
    """
    n = len(values)
    spread, common = mix(values), _common(values, frequent)
    keys, short = [], []
    band = int(np.searchsorted(UPPERS, n))
    while band == 0 or UPPERS[band - 1] + 1 <= max(n, n * 5 // 4):
        upper = int(UPPERS[band])
        differ = (n + min(upper, n * 5 // 4)) // 9
        alone = upper < WHOLE_BELOW or band in whole
        number, xor = _cells(spread, common, None if alone else int(upper * CELL_SHARE))
        if not alone and len(number) <= differ:
            short.append(band)
        keys.append(mix(xor[: differ + 1] ^ mix(number[: differ + 1] + np.uint64(band << 40))))
        band += 1
    return np.concatenate(keys), short


def set_name(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def node_of(name: bytes, clashes: frozenset[int], mask: int = NODE_MASK) -> int:
    """Number of a set: part of its name, or of further hashes of it where two sets would share one."""
    node, turn = int.from_bytes(name[:8], "little") & mask, 0
    while node in clashes:
        turn += 1
        again = hashlib.blake2b(name + turn.to_bytes(8, "little"), digest_size=8).digest()
        node = int.from_bytes(again, "little") & NODE_MASK
    return node


def _sets(clashes: frozenset[int], mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, names, bits = [], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text)
                sizes.append(len(values))
                names.append(set_name(values))
                bits.append(np.frombuffer(sketch(values), np.int64))
            nodes = [node_of(name, clashes, mask) for name in names]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("nid"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(nodes, pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["nid", "row", "n", "name", "node", "bits"],
            )

    return run


def _values(clashes: frozenset[int], mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [shingles(t) for t in batch.column("text").to_pylist()]
            nodes = [node_of(set_name(v), clashes, mask) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))],
                names=["node", "values"],
            )

    return run


def _keyed(frequent, whole: frozenset[int], clashes: frozenset[int], mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = frequent.value, set()
        for batch in slices(batches):
            keys, ids, flags = [np.empty(0, np.uint64)], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text)
                name = set_name(values)
                if not len(values) or name in seen:  # copies in a task send their keys once
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                own, short = signatures(values, often, whole)
                keys += [own, np.zeros(len(short), np.uint64)]
                ids.append(np.full(len(own) + len(short), node_of(name, clashes, mask), np.int64))
                flags.append(np.concatenate([np.full(len(own), -1), short]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate([np.empty(0, np.int64), *ids])),
                    pa.array(np.concatenate([np.empty(0, np.int32), *flags])),
                ],
                names=["key", "node", "flag"],
            )

    return run


def _frequent(spark: SparkSession, slim: DataFrame, rows: int):
    """Sorted hashes of shingles in over 0.2 % of a sample of documents, as a broadcast variable."""
    every = max(1, -(-rows // SAMPLE_ROWS))
    sample = slim.where(F.pmod(F.xxhash64("nid", "row", F.lit("sample")), F.lit(every)) == 0)
    least = max(20, min(rows, SAMPLE_ROWS) // 500)
    counts = sample.select("text").mapInArrow(_values(frozenset(), NODE_MASK), "node long, values array<long>").select(
        F.explode("values").alias("v")
    ).groupBy("v").count().where(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "v").limit(FREQUENT).toPandas()["v"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))


def _distance(a: str, b: str) -> Column:
    """:func:`hamming` of two columns of sketches whose sizes differ by one doubling at most."""

    def fold(x: Column, n: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > n, halves).otherwise(x)

    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(fold(F.col(a), n), fold(F.col(b), n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda total, x: total + x)


# Longs of two sketches that are compared first, in compiled code; array functions are not compiled.
FIRST = 8


def _near(a: str, b: str, n_a: str, n_b: str) -> Column:
    """The bound on :func:`_distance`; a part of the sketches tells most pairs that are far apart."""
    bits_a, bits_b, bound = F.col(a), F.col(b), F.col(n_a) + F.col(n_b)
    n = F.least(F.size(a), F.size(b))

    def word(x: Column, i: int) -> Column:
        return F.when(F.size(x) > n, F.get(x, F.lit(i)).bitwiseXOR(F.get(x, n + i))).otherwise(F.get(x, F.lit(i)))

    some = F.lit(0)
    for i in range(FIRST):
        differ = F.bit_count(word(bits_a, i).bitwiseXOR(word(bits_b, i)))
        some = some + (differ if i < 2 else F.when(n > i, differ).otherwise(0))  # no sketch has fewer than two
    return (some * 9 <= bound) & (_distance(a, b) * 9 <= bound)


def _holder() -> Column:
    """Tells rows apart well enough to choose one whose text is read for its set."""
    return F.xxhash64("nid", "row")


def _fits(a: str, b: str) -> Column:
    """Sizes that allow a link."""
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


class _Verifier:
    """Keeps the pairs ``a``, ``b`` of nodes that link."""

    def __init__(self, slim: DataFrame, sets: DataFrame, values):
        self.slim = slim
        self.sets = sets  # one row per node
        self.values = values

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.col("a") != F.col("b")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        ).distinct()
        for side in ("a", "b"):
            pairs = pairs.join(
                self.sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side
            )
        near = pairs.where(_fits("n_a", "n_b")).where(_near("bits_a", "bits_b", "n_a", "n_b"))
        pairs, n = keep_counted(near.select("a", "b").distinct())
        if not n:
            return pairs
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ends, count = keep_counted(ends.join(self.sets.select("node", "holder"), "node"))
        table, parts = bloom.build(ends, "holder", count)
        likely = bloom.possible(self.slim, _holder(), table, parts, "_likely").where("_likely")
        # Copies of a row pass the filter together, so a node may come more than once.
        values = keep(
            likely.select("text").mapInArrow(self.values, "node long, values array<long>").join(
                ends.select("node"), "node", "left_semi"
            ).dropDuplicates(["node"])
        )
        both = pairs.join(values.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b").join(
            values.select(F.col("node").alias("a"), F.col("values").alias("va")), "a"
        )
        common = F.size(F.array_intersect("va", "vb"))
        total = F.size("va") + F.size("vb") - common
        return keep(both.where(common * 100 >= total * 80).select("a", "b").distinct())


def _central(split: DataFrame, turn: int) -> DataFrame:
    """Each key's holders paired with one of them, another one in each turn.

    In the first turn that is the one whose keys have the most holders: of copies with different
    edits the text they stem from, or one close to it, so a large group joins up through one star.
    Later turns take the first by a hash of node and turn, the same one for all keys it holds.
    """
    counts = split.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    score = F.avg("k") if turn == 0 else F.max(F.xxhash64("node", F.lit(turn))).cast("double")
    scores = split.join(counts, "key").groupBy("node").agg(score.alias("score"))
    best = split.join(scores, "node").groupBy("key").agg(
        F.max(F.struct("score", (-F.col("node")).alias("minus"), "c")).alias("best")
    ).select("key", (-F.col("best")["minus"]).alias("a"), F.col("best")["c"].alias("ca"))
    return split.join(best, "key").where(F.col("c") != F.col("ca")).select("a", F.col("node").alias("b")).distinct()


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` (node, component) after more links: only the components they connect go through rounds."""
    ends = links
    for side in ("a", "b"):
        known = joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        ends = ends.join(known, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    outer = connected(ends.where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    moved = outer.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = joined.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(kept.unionByName(outer.join(joined.select("node"), "node", "left_anti")))


def _across(split: DataFrame, sets: DataFrame) -> DataFrame:
    """A key's holders in different components whose sizes and sketches allow a link, in pairs.

    Sketches are compared inside the join, so only pairs within the bound come out of it. The
    comparisons, a few machine words each, do grow with the square of the holders of one key that
    are neither linked nor told apart by rare shingles.
    """
    sized = keep(split.join(sets.select("node", "n", "bits"), "node").select("key", "node", "c", "n", "bits"))
    other = sized.select("key", *[F.col(c).alias(f"{c}_2") for c in ("node", "c", "n", "bits")])
    on = (sized["key"] == other["key"]) & (F.col("c") < F.col("c_2")) & _fits("n", "n_2")
    on = on & _near("bits", "bits_2", "n", "n_2")
    return sized.join(other, on).select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()


def _linked(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``nid``, ``row``, ``n``, ``node``), sets (``node``, ``n``, ``least``: the smallest id) and
    the ``component`` of each set (``node``) that links.

    A node is a set of shingles, whatever the ids of its rows, so rows without an id or with the
    same id link by their own texts only. A node sends keys (see :func:`signatures`) for
    the size bands of all partners it can have. In a first round each key pairs its holders with
    the smallest one only; the pairs pass a size test, the Hamming bound of their parity sketches
    and an exact comparison. Links make components of sets; copies follow their set. Keys whose holders are still in different
    components then pair them with one central holder, turn after turn while that joins a tenth of them,
    and what is left then gives all pairs across components; all are tested likewise. So every link is
    either seen or inside a component already, and groups of near copies give a star, not all pairs.
    Cells of frequent shingles come last in the order, so shared passages make few keys.
    """
    spark = docs.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(some_id(F.col(doc_id)).alias("nid"), F.xxhash64(body).alias("row"), body.alias("text"))
    mask, clashes = NODE_MASK, frozenset()
    while True:
        rows, count = keep_counted(
            slim.mapInArrow(
                _sets(clashes, mask), "nid long, row long, n long, name binary, node long, bits array<long>"
            )
        )
        full = rows.where("n > 0")
        sets = keep(
            full.groupBy("node").agg(
                F.min("name").alias("name"), F.max("name").alias("last"), F.min("nid").alias("least"),
                F.min(_holder()).alias("holder"), F.first("n").alias("n"), F.first("bits").alias("bits"),
            )
        )
        again = {r["node"] for r in sets.where("name <> last").select("node").collect()}
        if not again:
            break
        clashes = clashes | again  # names that share their first 63 bits, a handful in 10^10
    frequent = _frequent(spark, slim, count)

    whole: frozenset[int] = frozenset()
    while True:
        keys = slim.select("text").mapInArrow(_keyed(frequent, whole, clashes, mask), "key long, node long, flag int")
        holders = Window.partitionBy("key")
        shared = keys.withColumns({"lead": F.min("node").over(holders), "end": F.max("node").over(holders)})
        shared = keep(shared.where((F.col("lead") < F.col("end")) | (F.col("flag") >= 0)).select("key", "node", "lead", "flag"))
        short = {r["flag"] for r in shared.where("flag >= 0").select("flag").distinct().collect()}
        if short <= whole:
            break
        whole = whole | short  # sets with too few cells: their bands take one cell per shingle

    verifier = _Verifier(slim, sets, _values(clashes, mask))
    stars = shared.where(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    joined = keep(connected(verifier.links(stars)))
    turn, before = 0, None
    while True:
        held = shared.select("key", "node").join(joined, "node", "left").select(
            "key", "node", F.coalesce("component", "node").alias("c")
        )
        split = held.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        split_keys, left = keep_counted(held.join(split, "key", "left_semi").distinct())
        if not left:
            break
        if before is not None and left * 10 > before * 9:  # stars join no more: the rest in pairs
            joined = _merged(joined, verifier.links(_across(split_keys, sets)))
            break
        joined = _merged(joined, verifier.links(_central(split_keys, turn)))
        turn, before = turn + 1, left
    return rows.select("nid", "row", "n", "node"), sets.select("node", "n", "least"), joined


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row`` (hash of the text), ``n_shingles``, ``component_id`` for each row of ``docs``.

    Sets link as in :func:`_linked`; then rows that share an id are joined too, and a component is
    named by its smallest id. A null or wordless text has no shingles and links with nothing. A row
    without an id is a document of its own; its component is null unless it reaches an id.
    """
    rows, sets, joined = _linked(docs, text, doc_id)
    held = rows.where((F.col("n") > 0) & (F.col("nid") != NO_ID)).select("nid", "node").distinct()
    several = held.groupBy("nid").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    one_id, many = keep_counted(held.join(several, "nid").where("node <> a").select("a", F.col("node").alias("b")))
    if many:
        joined = _merged(joined, one_id.distinct())
    names = joined.join(sets, "node").groupBy("component").agg(F.min("least").alias("name"))
    named = joined.join(names, "component").select("node", "name")
    out = rows.join(
        sets.join(named, "node", "left").select("node", F.coalesce("name", "least").alias("name")), "node", "left"
    )
    component = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("nid"))
    return out.select(
        F.when(F.col("nid") != NO_ID, F.col("nid")).alias("doc_id"), "row", F.col("n").alias("n_shingles"),
        F.when(component != NO_ID, component).alias("component_id"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return components(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of texts that link: the smallest id, then the smallest text hash.

    Rows without shingles, which link with nothing, all stay. Texts are judged by themselves: rows
    that share an id but no text stay both, and so do different texts without an id. A row without
    an id comes after those with one.
    """
    rows, _, joined = _linked(docs, "text", "doc_id")
    own = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("nid", "row")).alias("first"))
    group = F.coalesce("component", "node").alias("group")
    first = own.join(joined, "node", "left").groupBy(group).agg(F.min("first").alias("first"))
    stay = rows.where("n = 0").select("nid", "row", F.lit(False).alias("_once")).distinct().unionByName(
        first.select("first.nid", "first.row", F.lit(True).alias("_once"))
    ).withColumnRenamed("nid", "_id").withColumnRenamed("row", "_row")
    body = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.join(
        stay.hint("shuffle_hash"), (some_id(F.col("doc_id")) == F.col("_id")) & (F.xxhash64(body) == F.col("_row"))
    )
    mark = F.when(F.col("_once"), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    kept = kept.withColumn("_mark", mark).dropDuplicates(["_id", "_row", "_mark"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
