"""Largest inner products by low-dimensional stable projections, a kd-tree, and a chi-square stopping test.

Vectors are lifted by one component so that all have the same length; then the largest inner product
with a query is the smallest Euclidean distance to it. A Gaussian (2-stable) matrix projects the
lifted vectors to ``LOW`` dimensions: the squared projected distance of two vectors, divided by
their squared distance, is chi-square with ``LOW`` degrees. A kd-tree over the projections is
walked from the nearest box outwards, vectors are compared in full as they come, and the walk stops
when a vector as near as the current last answer would, with probability ``SURE``, have been met.

The tree has two parts. Its upper splits come from a bounded sample (``SAMPLE_ROWS``, at most
``LEAVES`` leaves) and deal out all vectors; a leaf is cut into blocks of about ``BLOCK_ROWS``
vectors, so a dense region is many tasks. Each block builds its own lower tree in its task.
First each query walks the block it lies in, which bounds its last answer; then it goes to the blocks
whose box that bound still reaches, in chunks of about ``CHUNK_ROWS`` queries. Every vector is
indexed; nothing is capped. The driver sees the sample, and one row of statistics per leaf.

Equal vectors are one node: of each, the smallest ids that any answer can need (one more than
``k``) stand for it, found by a window that Spark limits before the shuffle.

Results for odd rows. A null id, a null or zero vector, and one that holds nulls, NaN or infinities
takes no part. A shorter vector is read as padded with zeros. Repeated rows (same id, same vector)
count once. Rows that share an id but not the vector are candidates each; none of them is an
answer to a query of that id, and each is a query of its own if the id is one. Equal products go to
the smaller id. Empty tables give empty results. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import keep, ship_package

LOW = 8
SURE = 0.97
SAMPLE_ROWS = 65_536
LEAVES = 4096
BLOCK_ROWS = 8192
CHUNK_ROWS = 2048
# Rows of the smallest boxes of a block's own tree.
BOX_ROWS = 64
SEED = 11


def chi_square_point(sure: float, degrees: int) -> float:
    """The value a chi-square variable of an even number of degrees stays below with that probability."""

    def above(x: float) -> float:
        half, term, total = x / 2, 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total

    low, high = 0.0, 1.0
    while above(high) > 1 - sure:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > 1 - sure else (low, middle)
    return high


def stable_matrix(dims: int, low: int = LOW, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims + 1, low))


def project(vectors: np.ndarray, largest: float, matrix: np.ndarray, lifted: bool) -> np.ndarray:
    """Projections of vectors (lifted to the squared length ``largest``) or of queries (lifted by zero)."""
    low = vectors @ matrix[:-1]
    if lifted:
        rest = np.maximum(largest - np.einsum("ij,ij->i", vectors, vectors), 0)
        low += np.sqrt(rest)[:, None] * matrix[-1]
    return low


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Splits (dimension, value, left, right) by the median of the widest dimension; -1 - leaf ends a path."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal made
        wide = np.ptp(points[rows], axis=0) if want > 1 and len(rows) > 1 else np.zeros(1)
        dim = int(wide.argmax())
        if wide[dim] <= 0:
            made += 1
            return -made
        values = points[rows, dim]
        at = float(np.median(values))
        right = values >= at
        if right.all():
            right = values > at
            at = float(values[right].min())
        no = len(nodes)
        nodes.append((dim, at, 0, 0))
        half = want // 2
        nodes[no] = (dim, at, grow(rows[~right], half), grow(rows[right], want - half))
        return no

    grow(np.arange(len(points)), max(1, leaves))
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    waiting = [(0, np.arange(len(points)))] if nodes else []
    while waiting:
        no, rows = waiting.pop()
        dim, at, left, right = nodes[no]
        high = points[rows, dim] >= at
        for child, some in ((left, rows[~high]), (right, rows[high])):
            if child < 0:
                out[some] = -1 - child
            elif len(some):
                waiting.append((child, some))
    return out


def matrix_of(column, dims: int) -> np.ndarray:
    """A column of lists of ``dims`` numbers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


class Block:
    """Vectors of one block under a kd-tree of their projections."""

    def __init__(self, vectors: np.ndarray, low: np.ndarray, ids: list[list[int]]):
        order, bounds, waiting = [], [0], [np.arange(len(low))]
        while waiting:
            rows = waiting.pop()
            if len(rows) <= BOX_ROWS:
                if len(rows):
                    order.append(rows)
                    bounds.append(bounds[-1] + len(rows))
                continue
            dim = int(np.ptp(low[rows], axis=0).argmax())
            ranked = rows[np.argpartition(low[rows, dim], len(rows) // 2)]
            waiting += [ranked[len(rows) // 2 :], ranked[: len(rows) // 2]]
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        self.vectors, self.low, self.bounds = vectors[order], low[order], np.array(bounds)
        self.ids = [ids[k] for k in order]
        self.first = np.array([x[0] for x in self.ids], np.int64)
        starts = self.bounds[:-1]
        self.least = np.minimum.reduceat(self.low, starts) if len(order) else self.low
        self.most = np.maximum.reduceat(self.low, starts) if len(order) else self.low

    def nearest(self, query: np.ndarray, low: np.ndarray, bound: float, largest: float, factor: float, k: int):
        """The best ``k`` vectors (score, place) met before the stopping test holds.

        ``bound``: a score that ``k`` vectors elsewhere are known to reach, or minus infinity.
        """
        gap = np.maximum(np.maximum(self.least - low, low - self.most), 0)
        gap = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(gap, kind="stable")
        scale = largest + float(query @ query)
        stop = factor * max(0.0, scale - 2 * bound) if bound > -math.inf else math.inf
        places, scores = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 2
        while at < len(order) and gap[order[at]] <= stop:
            boxes = order[at : at + step]
            boxes = boxes[gap[boxes] <= stop]
            rows = np.concatenate([np.arange(self.bounds[b], self.bounds[b + 1]) for b in boxes])
            away = self.low[rows] - low
            rows = rows[np.einsum("ij,ij->i", away, away) <= stop]
            found = self.vectors[rows] @ query
            places, scores = np.concatenate([places, rows]), np.concatenate([scores, found])
            if len(scores) > k:
                last = np.partition(scores, -k)[-k]
                near = scores >= last - 1e-9 * (abs(last) + scale)
                places, scores = places[near], scores[near]
                stop = min(stop, factor * max(0.0, scale - 2 * last))
            at += step
            step *= 2
        # Sums in the order of the components, so that a score does not depend on the block it is found in.
        if len(places):
            scores = np.cumsum(self.vectors[places] * query, axis=1)[:, -1]
        best = np.lexsort((self.first[places], -scores))[:k]
        return scores[best], places[best]


def _hits(vid: int, scores, places, block: Block, k: int) -> list[tuple[int, float, int]]:
    """Rows of the answer: the ids of the best vectors, cut at ``k`` rows."""
    rows = [(-float(s), i) for s, p in zip(scores, places) for i in block.ids[p]]
    return [(vid, -s, i) for s, i in sorted(rows)[:k]]


_HIT = "vid long, score double, vec_id long"


def _hit_table(rows) -> dict:
    vid, score, vec = zip(*rows) if rows else ((), (), ())
    return {"vid": pa.array(vid, pa.int64()), "score": pa.array(score, pa.float64()), "vec_id": pa.array(vec, pa.int64())}


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that take part."""
    rows = embeddings.select(
        embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding")
    )
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(
        fine & F.exists("embedding", lambda x: x != 0)
    )


def _is_query(every: int):
    return F.pmod("vec_id", F.lit(every)) == 0


def _distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """Each vector once: its smallest ``k`` ids, and whether a query has it."""
    own = Window.partitionBy("embedding", "asked").orderBy("vec_id")
    few = rows.withColumn("asked", _is_query(every)).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k)
    grouped = few.groupBy("embedding").agg(
        F.slice(F.array_sort(F.collect_list("vec_id")), 1, k).alias("ids"), F.bool_or("asked").alias("asked")
    )
    return grouped.withColumn("vid", F.monotonically_increasing_id())


def nearest(
    embeddings: DataFrame, k: int = 20, every: int = 20, sure: float = SURE, low: int = LOW, block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of each id divisible by ``every``."""
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = keep(usable(embeddings).distinct())
    answer = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    wide = rows.agg(F.max(F.size("embedding"))).first()[0]
    if not wide:
        return answer
    rows = rows.withColumn(
        "embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(wide) - F.size("embedding")))
    )
    vectors = keep(_distinct_vectors(rows, k + 1, every))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    total, largest, asked = vectors.agg(F.count(F.lit(1)), F.max(squares), F.count_if("asked")).first()
    matrix, factor = stable_matrix(wide, low), chi_square_point(sure, low)

    def sampled(batches):
        for batch in batches:
            x = project(matrix_of(batch.column(0), wide), largest, matrix, True)
            yield pa.RecordBatch.from_pydict({"low": pa.array(list(x), pa.list_(pa.float64()))})

    share = max(1, total // SAMPLE_ROWS)
    sample = vectors.where(F.pmod(F.xxhash64("embedding"), F.lit(share)) == 0).select("embedding")
    points = np.array([r["low"] for r in sample.mapInArrow(sampled, "low array<double>").collect()]).reshape(-1, low)
    nodes = split_tree(points, min(LEAVES, -(-total // block_rows)))

    def placed_in(batches):
        for batch in batches:
            x = matrix_of(batch.column("embedding"), wide)
            of_vector = project(x, largest, matrix, True)
            columns = {name: batch.column(name) for name in ("vid", "embedding", "ids", "asked")}
            columns["low"] = pa.array(list(of_vector), pa.list_(pa.float64()))
            columns["leaf"] = pa.array(leaf_of(of_vector, nodes))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "vid long, embedding array<double>, ids array<long>, asked boolean, low array<double>, leaf int"
    placed = keep(vectors.select("vid", "embedding", "ids", "asked").mapInArrow(placed_in, schema))
    sides = [F.min(F.col("low")[i]).alias(f"a{i}") for i in range(low)] + [F.max(F.col("low")[i]).alias(f"b{i}") for i in range(low)]
    leaves = sorted(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *sides).collect(), key=lambda r: r["leaf"])
    least = np.array([[r[f"a{i}"] for i in range(low)] for r in leaves])
    most = np.array([[r[f"b{i}"] for i in range(low)] for r in leaves])
    cuts = [-(-r["n"] // block_rows) for r in leaves]
    firsts = np.concatenate([[0], np.cumsum(cuts)]).tolist()
    table = spark.createDataFrame(
        [(r["leaf"], firsts[no], cuts[no]) for no, r in enumerate(leaves)], "leaf int, first long, cuts long"
    )
    block = (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("cuts"))).alias("block")
    placed = placed.join(F.broadcast(table), "leaf").select("vid", "embedding", "ids", "asked", "low", block)

    def own_block(group: pa.Table) -> pa.Table:
        """Answers of the block's own queries; the last row of each query has the bound instead of an id."""
        mask = group.column("asked").to_numpy()
        out = []
        if mask.any():
            x, lows = matrix_of(group.column("embedding"), wide), matrix_of(group.column("low"), low)
            held = Block(x, lows, group.column("ids").to_pylist())
            at = np.flatnonzero(mask)
            lowered = project(x[at], largest, matrix, False)
            for vid, q, ql in zip(group.column("vid").take(pa.array(at)).to_pylist(), x[at], lowered):
                scores, places = held.nearest(q, ql, -math.inf, largest, factor, k + 1)
                out += _hits(vid, scores, places, held, k + 1)
                out.append((vid, float(scores[k]) if len(scores) > k else -math.inf, None))
        return pa.table(_hit_table(out))

    near = keep(placed.groupBy("block").applyInArrow(own_block, _HIT))
    bounds = near.where("vec_id IS NULL").select("vid", F.col("score").alias("bound"))
    queries = placed.where("asked").select("vid", "embedding", F.col("block").alias("own")).join(bounds, "vid")

    def visits(batches):
        """A row for each other block that the bound of a query reaches."""
        for batch in batches:
            x = matrix_of(batch.column("embedding"), wide)
            lowered = project(x, largest, matrix, False)
            stops = factor * np.maximum(largest + np.einsum("ij,ij->i", x, x) - 2 * batch.column("bound").to_numpy(), 0)
            own = batch.column("own").to_numpy()
            at, blocks = [], []
            for i, (point, stop) in enumerate(zip(lowered, stops)):
                gap = np.maximum(np.maximum(least - point, point - most), 0)
                for no in np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= stop):
                    for b in range(firsts[no], firsts[no + 1]):
                        if b != own[i]:
                            at.append(i)
                            blocks.append(b)
                if len(at) >= 4096 or i + 1 == len(lowered):
                    some = batch.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array(blocks, pa.int64()), **{c: some.column(c) for c in ("vid", "embedding", "bound")}}
                    )
                    at, blocks = [], []

    chunks = max(1, -(-asked // chunk_rows))
    chunk = F.pmod(F.xxhash64("embedding"), F.lit(chunks)).alias("chunk")
    away = queries.mapInArrow(visits, "block long, vid long, embedding array<double>, bound double")
    away = away.select("block", chunk, "vid", "embedding", "bound")
    dealt = placed.select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "embedding", "ids", "low"
    )

    def other_blocks(asking: pa.Table, group: pa.Table) -> pa.Table:
        out = []
        if len(asking) and len(group):
            held = Block(
                matrix_of(group.column("embedding"), wide), matrix_of(group.column("low"), low), group.column("ids").to_pylist()
            )
            x = matrix_of(asking.column("embedding"), wide)
            lowered = project(x, largest, matrix, False)
            for vid, bound, q, ql in zip(asking.column("vid").to_pylist(), asking.column("bound").to_pylist(), x, lowered):
                scores, places = held.nearest(q, ql, bound, largest, factor, k + 1)
                out += _hits(vid, scores, places, held, k + 1)
        return pa.table(_hit_table(out))

    keys = ("block", "chunk")
    more = away.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(other_blocks, _HIT)
    order = Window.partitionBy("vid").orderBy(F.col("score").desc(), "vec_id")
    best = near.where("vec_id IS NOT NULL").unionByName(more).withColumn("r", F.row_number().over(order))
    lists = best.where(F.col("r") <= k + 1).groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")
    )
    asking = rows.where(_is_query(every)).select(F.col("vec_id").alias("query_id"), "embedding")
    mapped = asking.join(vectors.select("vid", "embedding"), "embedding").select("query_id", "vid")
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    answer = mapped.join(lists, "vid").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return answer.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
