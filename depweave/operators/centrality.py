"""PageRank with a fixed number of rounds: by strong components where they are small, else several rounds per pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.operators.components import strongly_connected
from depweave.operators.skew import HotKeys, hot_join, hot_keys
from depweave.operators.walks import Walks, build_walks
from depweave.session import cut, dealt, keep, keep_counted, ship_package, small, spread

# Imports that one task may hold, and the longest way through the graph of components that is gone step by step.
BLOCK_EDGES = 500_000
MAX_LEVELS = 8


def pagerank(
    files: DataFrame,
    edges: DataFrame,
    damping: float = 0.85,
    iterations: int = 40,
    walks: Callable[[], Walks] | None = None,
    parts: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """``(rev, id, pagerank)`` after exactly ``iterations`` rounds from the uniform start.

    Rank flows from importer to imported; files without imports spread theirs over all files of
    their revision. Because the update is linear, round *n* equals a weighted sum of the terms
    ``x(k) = (damping * M)^k * 1`` for k up to n, and the weights follow from one number per
    round: the part of x(k) that lies on files without imports. So the terms are computed first and the
    weights come from those few sums. No round waits for a global total.

    ``walks`` and the strong components ``parts`` are asked for only where they are needed.
    """
    if files.schema["id"].dataType == edges.schema["src"].dataType == T.LongType():
        found = _by_parts(files, edges, damping, iterations, strongly_connected(edges) if parts is None else parts())
        if found is not None:
            return found
    return _by_rounds(files, edges, damping, iterations, build_walks(edges) if walks is None else walks())


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


class _Block:
    """The terms of the files of some whole components, which no import leads to from one another."""

    def __init__(self, rows: pa.Table, damping: float, iterations: int):
        kind, ids, dst, out = _columns(rows, "kind", "id", "dst", "out")
        node, edge, flow = (np.flatnonzero(kind == k) for k in range(3))
        node = node[np.argsort(ids[node], kind="stable")]
        self.ids, self.iterations, size = ids[node], iterations, len(node)
        self.share = damping / out[node]
        self.lost = np.stack([rows.column(c).to_numpy()[node] for c in rows.column_names if c.startswith("lost")], axis=1)
        self.inflow = np.zeros((size, iterations + 1))
        if len(flow):
            terms = b"".join(rows.column("terms").take(pa.array(flow)).to_pylist())
            np.add.at(self.inflow, np.searchsorted(self.ids, ids[flow]), np.frombuffer(terms).reshape(len(flow), -1))
        tail = np.searchsorted(self.ids, ids[edge])
        place = np.minimum(np.searchsorted(self.ids, dst[edge]), size - 1)
        inside = self.ids[place] == dst[edge]
        self.tail, self.head = tail[inside], place[inside]
        self.leaving, self.edge = tail[~inside], edge[~inside]

    def terms(self):
        """``(k, x(k), what each import of a file then hands on)``."""
        x = np.ones(len(self.ids))
        for k in range(self.iterations + 1):
            given = x * self.share
            yield k, x, given
            if k < self.iterations:
                x = np.bincount(self.head, given[self.tail], len(x)) + self.inflow[:, k + 1]


# Terms are the bytes of their numbers: lists cost Arrow far more.
FLOWS = "level int, block int, id long, rev int, terms binary"


def _handed_on(rows: pa.Table, damping: float, iterations: int) -> pa.Table:
    """What a block hands on: terms of each file of a later level, and for each revision those of its files without imports."""
    block = _Block(rows, damping, iterations)
    to, level, place = _columns(rows.take(pa.array(block.edge)), "dst", "to_level", "to_block")
    heads, first, code = np.unique(to, return_index=True, return_inverse=True)
    terms = np.zeros((len(heads) + block.lost.shape[1], iterations + 1))
    for k, _, given in block.terms():
        if k < iterations:
            terms[: len(heads), k + 1] = np.bincount(code, given[block.leaving], len(heads))
            terms[len(heads) :, k + 1] = given @ block.lost
    revs = len(terms) - len(heads)
    whole = lambda found, fill: pa.array(np.concatenate([found, np.full(revs, fill)]))
    columns = {
        "level": whole(level[first], -1).cast("int32"),
        "block": whole(place[first], -1).cast("int32"),
        "id": whole(heads, 0),
        "rev": pa.array(np.concatenate([np.full(len(heads), -1), np.arange(revs)])).cast("int32"),
    }
    return pa.table(columns | {"terms": pa.array([row.tobytes() for row in terms], pa.binary())})


def _ranked(rows: pa.Table, damping: float, weights: list[list[float]]) -> pa.Table:
    """``(id, rank0, given0, …)`` of the files of a block: for each revision their rank, and what an import adds to a file without imports."""
    block, weights = _Block(rows, damping, len(weights[0]) - 1), np.array(weights)
    rank, given = np.zeros((2, len(weights), len(block.ids)))
    for k, x, handed in block.terms():
        rank += np.outer(weights[:, k], x)
        if k < block.iterations:
            given += np.outer(weights[:, k + 1], handed)
    found = {f"{name}{i}": row for name, rows in (("rank", rank), ("given", given)) for i, row in enumerate(rows)}
    return pa.table({"id": block.ids} | found)


def _levels(across: DataFrame) -> tuple[DataFrame, int] | None:
    """``(comp, level)`` of every component that another one leads to, along the longest way, and their number."""
    across, fresh = keep_counted(across)
    ahead, raised, rows = across, [], 0
    while fresh:
        above, fresh = keep_counted(ahead.select(F.col("cdst").alias("comp")).distinct())
        if fresh:
            raised.append(above)
            rows = max(rows, fresh)
            ahead = across.join(small(above.toDF("csrc"), fresh), "csrc", "left_semi")
        if len(raised) > MAX_LEVELS:
            return None
    raised = raised or [across.select(F.col("cdst").alias("comp"))]
    found = reduce(DataFrame.unionByName, raised).groupBy("comp").agg(F.count(F.lit(1)).cast("int").alias("level"))
    return keep(found), rows


def _by_parts(files: DataFrame, edges: DataFrame, damping: float, iterations: int, parts: DataFrame) -> DataFrame | None:
    """:func:`pagerank` over long ids along the graph of strong components, or none if it is too deep or a component too large.

    A task finds all terms of the files of a block of components, given what earlier levels hand on. Files without imports hand
    on nothing, so their ranks are sums over the imports, made when the weights are known; the sums the weights need are made
    where the imports start.
    """
    ship_package(edges.sparkSession)
    sizes = {r["rev"]: r["n"] for r in files.groupBy("rev").agg(F.count(F.lit(1)).alias("n")).collect() if r["rev"] is not None}
    revs = list(sizes)
    if not revs:
        return files.select("rev", "id", F.lit(None).cast("double").alias("pagerank")).where("false")
    owned = [f"m{i}" for i in range(len(revs))]
    rows = files.select("id", F.lit(0).alias("out"), *[F.when(F.col("rev") == r, 1).otherwise(0).alias(m) for r, m in zip(revs, owned)])
    known = edges.where("src IS NOT NULL")
    rows = rows.unionByName(known.select(F.col("src").alias("id"), F.lit(1).alias("out"), *[F.lit(0).alias(m) for m in owned]))
    counted = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("out", *owned)]).join(spread(parts), "id", "left")
    nodes = keep(counted.select("id", "out", *[F.col(m).cast("int").alias(m) for m in owned], F.coalesce("comp", "id").alias("comp")))

    # Every import with the components of its ends; a file without imports has none here.
    many, none = edges.count(), HotKeys(T.LongType())
    hot = hot_keys(edges, "src", many)
    heads = nodes.select(F.col("id").alias("dst"), *owned, F.when(F.col("out") > 0, F.col("comp")).alias("cdst"))
    tails = nodes.where("out > 0").select(F.col("id").alias("src"), F.col("comp").alias("csrc"))
    placed = hot_join(known, spread(heads), "dst", hot_keys(edges, "dst", many), none, "left")
    placed = keep(hot_join(placed, spread(tails), "src", hot, none).select("src", "dst", "csrc", "cdst", *owned))
    onward, last = placed.where("cdst IS NOT NULL"), placed.where("cdst IS NULL")
    most, total = onward.groupBy("csrc").count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) > BLOCK_EDGES:
        return None
    found = _levels(onward.where("csrc <> cdst").select("csrc", "cdst").distinct())
    if found is None:
        return None
    levels, raised = found

    blocks = max(-(-(total or 0) // BLOCK_EDGES), min(16, (total or 0) // 50_000 + 1))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    level = lambda df, c, name: df.join(small(levels.toDF(c, name), raised), c, "left").fillna(0, [name])
    lost = last.groupBy(F.col("src").alias("id")).agg(*[F.sum(m).alias(m) for m in owned])
    sources = nodes.where("out > 0").drop(*owned).join(spread(lost), "id", "left")
    no_terms = F.lit(None).cast("binary").alias("terms")
    nothing = [F.lit(0.0).alias(f"lost{i}") for i in range(len(revs))]
    to_lose = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(f"lost{i}") for i, m in enumerate(owned)]
    plain = lambda df, kind, dst, to_level, to_block, out, lost: df.select(
        F.lit(kind).alias("kind"), "level", block("comp").alias("block"), "id", dst.cast("long").alias("dst"), to_level.cast("int").alias("to_level"),
        to_block.cast("int").alias("to_block"), out.cast("long").alias("out"), *lost, no_terms,
    )
    zero = F.lit(0)
    own = plain(level(sources, "comp", "level"), 0, zero, zero, zero, F.col("out"), to_lose)
    links = level(level(onward, "cdst", "to_level"), "csrc", "level").withColumnRenamed("csrc", "comp").withColumnRenamed("src", "id")
    work = keep(own.unionByName(plain(links, 1, F.col("dst"), F.col("to_level"), block("cdst"), F.lit(1), nothing)))

    def as_rows(flows: DataFrame) -> DataFrame:
        given = flows.withColumn("kind", F.lit(2)).withColumn("out", F.lit(1).cast("long"))
        return given.select(*[c if c in given.columns else F.lit(0).cast(work.schema[c].dataType).alias(c) for c in work.columns])

    flows: list[DataFrame] = []
    depth = levels.agg(F.max("level")).first()[0] or 0
    for step in range(depth + 1):
        begun = reduce(DataFrame.unionByName, [work, *map(as_rows, flows)]).where(F.col("level") == step)
        flows.append(keep(begun.repartition(blocks, "block").groupBy("block").applyInArrow(lambda rows: _handed_on(rows, damping, iterations), FLOWS)))
    handed = reduce(DataFrame.unionByName, flows)

    dangling: dict = defaultdict(dict)
    for row in handed.where("rev >= 0").select("rev", "terms").collect():  # one number per round and block
        for k, x in enumerate(np.frombuffer(row["terms"])):
            dangling[revs[row["rev"]]][k] = dangling[revs[row["rev"]]].get(k, 0.0) + float(x) / sizes[revs[row["rev"]]]
    idle = nodes.where("out = 0").agg(*[F.sum(m) for m in owned]).first()
    for rev, n in zip(revs, idle):
        dangling[rev][0] = (n or 0) / sizes[rev]
    weights = [_weights(dangling[rev], damping, iterations, sizes[rev]) for rev in revs]

    begun = reduce(DataFrame.unionByName, [work, *map(as_rows, [f.where("rev < 0") for f in flows])])
    schema = ", ".join(["id long", *[f"{name}{i} double" for name in ("rank", "given") for i in range(len(revs))]])
    ranks = begun.repartition(blocks, "level", "block").groupBy("level", "block").applyInArrow(lambda rows: _ranked(rows, damping, weights), schema)
    ranks = keep(ranks)
    sums = [f"rank{i}" for i in range(len(revs))]
    given = ranks.select(F.col("id").alias("src"), *[F.col(f"given{i}").alias(c) for i, c in enumerate(sums)])
    added = hot_join(last.select("src", "dst"), spread(given), "src", hot, none)
    added = added.groupBy(F.col("dst").alias("id")).agg(*[(F.sum(c) + F.lit(weights[i][0])).alias(c) for i, c in enumerate(sums)])
    named = files.select("rev", "id").join(spread(ranks.select("id", *sums).unionByName(added)), "id", "left").where(F.col("rev").isin(revs))
    rank = F.coalesce(*[F.when(F.col("rev") == rev, F.coalesce(sums[i], F.lit(weights[i][0]))) for i, rev in enumerate(revs)])
    return keep(named.select("rev", "id", rank.alias("pagerank")))


def _by_rounds(files: DataFrame, edges: DataFrame, damping: float, iterations: int, walks: Walks) -> DataFrame:
    """:func:`pagerank` with ``walks.steps`` terms per pass, only for files that some walk of length k reaches."""
    power = F.pow(F.lit(float(damping)), F.col("steps"))
    steps = walks.table.select(F.col("src").alias("id"), "dst", "steps", (F.col("weight") * power).alias("w"))
    none = HotKeys(walks.hot_src.key_type)

    terms: list[DataFrame] = []
    base, done, fresh = None, 0, walks.rows
    with dealt(steps, "id", walks.rows) as onward:
        while done < iterations and fresh:
            take = min(walks.steps, iterations - done)
            usable = onward.where(F.col("steps") <= take)
            if base is not None:
                usable = hot_join(small(base, fresh), usable, "id", none, walks.hot_src)
                usable = usable.withColumn("w", F.col("w") * F.col("x"))
            block = usable.groupBy(F.col("dst").alias("id"), (F.col("steps") + F.lit(done)).alias("k")).agg(
                F.sum("w").alias("x")
            )
            block, fresh = keep_counted(block)
            terms.append(block)
            done += take
            base = block.where(F.col("k") == done).select("id", "x")

    # One row per file with its terms, at most one per round; x(0) is 1 everywhere.
    start = F.array(F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("x")))
    nodes = files.select("rev", "id")
    if terms:
        listed = reduce(DataFrame.unionByName, terms).groupBy("id").agg(
            F.sort_array(F.collect_list(F.struct("k", "x"))).alias("terms")
        )
        importing = edges.select(F.col("src").alias("id")).distinct().withColumn("imports", F.lit(True))
        nodes = nodes.join(listed, "id", "left").join(importing, "id", "left")
        nodes = nodes.select("rev", "id", F.concat(start, F.coalesce("terms", F.slice(start, 1, 0))).alias("terms"), "imports")
    else:
        nodes = nodes.select("rev", "id", start.alias("terms"), F.lit(None).cast("boolean").alias("imports"))
    nodes = cut(nodes)

    sizes = {r["rev"]: r["n"] for r in nodes.groupBy("rev").agg(F.count(F.lit(1)).alias("n")).collect()}
    lost = nodes.where("imports is null").select("rev", F.explode("terms").alias("t"))
    dangling: dict = defaultdict(dict)
    for row in lost.groupBy("rev", "t.k").agg(F.sum("t.x").alias("s")).collect():  # one number per round
        dangling[row["rev"]][row["k"]] = row["s"] / sizes[row["rev"]]
    weights = [(rev, _weights(dangling[rev], damping, iterations, count)) for rev, count in sizes.items()]
    table = files.sparkSession.createDataFrame(weights, "rev string, c array<double>")
    rank = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["x"] * F.get("c", t["k"]))
    return nodes.join(F.broadcast(table), "rev").select("rev", "id", rank.alias("pagerank"))


def _weights(dangling: dict[int, float], damping: float, iterations: int, count: int) -> list[float]:
    """Weight of every term in the last round, given the dangling part of each term."""
    share: list[float] = []
    for step in range(iterations):
        mass = dangling.get(step, 0.0)
        mass += sum(share[step - 1 - j] * dangling.get(j, 0.0) for j in range(step))
        share.append((1.0 - damping) + damping * mass)
    return [share[iterations - 1 - k] / count for k in range(iterations)] + [1.0 / count]
