"""Iterative operators against plain Python on random graphs, and with tiny skew limits."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from depweave.operators.centrality import pagerank
from depweave.operators.components import strongly_connected
from depweave.operators.reach import reach_pairs, reachable_from
from depweave.operators.skew import global_rank, hot_join, hot_keys, kth_smallest, lead_by_group
from depweave.operators.walks import build_walks, single_steps


def random_edges(seed: int, nodes: int, edges: int, hub: bool = False) -> set[tuple[int, int]]:
    rng = random.Random(seed)
    found = set()
    for _ in range(edges):
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        if hub and rng.random() < 0.4:
            b = 0
        if a != b:
            found.add((a, b))
    return found


def distances(edges, start):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, queue = {start: 0}, deque([start])
    while queue:
        node = queue.popleft()
        for other in out.get(node, ()):
            if other not in seen:
                seen[other] = seen[node] + 1
                queue.append(other)
    seen.pop(start)
    return seen


def all_distances(edges):
    return {(s, t): d for s in {a for a, _ in edges} for t, d in distances(edges, s).items()}


def cyclic(edges):
    reach = set(all_distances(edges))
    comp = {}
    for a, b in reach:
        if (b, a) in reach:
            comp[a] = min(comp.get(a, a), a, b)
    return comp


def ranks(nodes, edges, rounds=40):
    out = Counter(a for a, _ in edges)
    rank = {n: 1 / nodes for n in range(nodes)}
    for _ in range(rounds):
        lost = sum(r for n, r in rank.items() if not out[n])
        fresh = {n: 0.15 / nodes + 0.85 * lost / nodes for n in rank}
        for a, b in edges:
            fresh[b] += 0.85 * rank[a] / out[a]
        rank = fresh
    return rank


GRAPHS = [
    random_edges(1, 40, 45),
    random_edges(2, 25, 60),
    random_edges(3, 30, 50, hub=True),
    {(i, i + 1) for i in range(30)} | {(30, 5), (12, 40)},
]


@pytest.fixture(scope="module", params=range(len(GRAPHS)))
def case(request, spark):
    edges = GRAPHS[request.param]
    return edges, spark.createDataFrame(sorted(edges), "src long, dst long")


def test_reach_matches_breadth_first_search(case):
    edges, df = case
    found = {(r["src"], r["dst"]): r["hop"] for r in reach_pairs(df, walks=build_walks(df)).collect()}
    assert found == all_distances(edges)


def test_components_match(case):
    edges, df = case
    found = {r["id"]: r["comp"] for r in strongly_connected(df).collect()}
    assert found == cyclic(edges)


def test_pagerank_matches_round_by_round(case, spark):
    edges, df = case
    nodes = 1 + max(max(e) for e in edges)
    files = spark.range(nodes).select(F.lit("head").alias("rev"), "id")
    found = {r["id"]: r["pagerank"] for r in pagerank(files, df).collect()}
    assert found == pytest.approx(ranks(nodes, edges), abs=1e-12)


def test_single_steps_and_bounded_hops(spark):
    df = spark.createDataFrame(sorted(GRAPHS[0]), "src long, dst long")
    start = spark.createDataFrame([(min(a for a, _ in GRAPHS[0]),)], "id long")
    source = start.first()["id"]
    expected = distances(GRAPHS[0], source)
    found = reach_pairs(df, start, single_steps(df)).collect()
    assert {r["dst"]: r["hop"] for r in found} == expected
    near = reach_pairs(df, start, build_walks(df), max_hops=2).collect()
    assert {r["dst"] for r in near} == {n for n, d in expected.items() if d <= 2}
    back = reach_pairs(df, start, build_walks(df), direction="in").collect()
    assert {r["dst"] for r in back} == {a for (a, b) in all_distances(GRAPHS[0]) if b == source}


def test_reachable_from_many_roots(spark):
    df = spark.createDataFrame(sorted(GRAPHS[1]), "src long, dst long")
    roots = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    expected = {1, 2} | set(distances(GRAPHS[1], 1)) | set(distances(GRAPHS[1], 2))
    assert {r["id"] for r in reachable_from(df, roots, build_walks(df)).collect()} == expected


def test_walk_table_stops_before_it_explodes(spark):
    spokes = [(i, 0) for i in range(1, 200)] + [(0, i) for i in range(200, 400)]
    df = spark.createDataFrame(spokes, "src long, dst long")
    walks = build_walks(df)
    assert walks.steps == 1 and walks.rows == len(spokes)
    found = {(r["src"], r["dst"]): r["hop"] for r in reach_pairs(df, walks=walks).collect()}
    assert found == all_distances(set(spokes))


def test_hot_keys_do_not_change_walks(spark, monkeypatch):
    df = spark.createDataFrame(sorted(GRAPHS[2]), "src long, dst long")
    plain = build_walks(df)
    monkeypatch.setattr("depweave.operators.skew.SLICE_ROWS", 2)
    sliced = build_walks(df, floor=2)
    assert sliced.hot_dst.slices, "the hub should be found"
    rows = lambda w: {(r.src, r.dst, r.steps): round(r.weight, 12) for r in w.table.collect()}
    assert sliced.steps == plain.steps and rows(sliced) == rows(plain)
    found = {(r["src"], r["dst"]): r["hop"] for r in reach_pairs(df, walks=sliced).collect()}
    assert found == all_distances(GRAPHS[2])
    assert {r["id"]: r["comp"] for r in strongly_connected(df, sliced).collect()} == cyclic(GRAPHS[2])


def test_hot_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr("depweave.operators.skew.SLICE_ROWS", 3)
    left = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 90), (3, 91)], "k long, a long")
    right = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 80)], "k long, b long")
    lh, rh = hot_keys(left, "k", 22, 4), hot_keys(right, "k", 8, 4)
    assert lh.slices and rh.slices
    assert Counter(map(tuple, hot_join(left, right, "k", lh, rh).collect())) == Counter(
        map(tuple, left.join(right, "k").collect())
    )
    none = hot_keys(right, "k", 0)
    once = right.dropDuplicates(["k"])
    assert Counter(map(tuple, hot_join(left, once, "k", lh, none, "left").collect())) == Counter(
        map(tuple, left.join(once, "k", "left").collect())
    )


def test_lead_across_ranges_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr("depweave.operators.skew.SLICE_ROWS", 5)
    rows = [(1, i // 3, i, i * 10) for i in range(60)] + [(2, 0, 5, 7), (2, 1, 6, 8), (3, 0, 1, 9)]
    df = spark.createDataFrame(rows, "g long, o long, p long, v long")
    usual = lead_by_group(df, "g", ["o", "p"], "v", "next", len(rows))
    spread = lead_by_group(df, "g", ["o", "p"], "v", "next", len(rows), floor=10)
    assert Counter(map(tuple, spread.select(usual.columns).collect())) == Counter(map(tuple, usual.collect()))


def test_global_rank_and_kth_smallest(spark):
    values = [7, 3, 3, 9, 1, 1_000_000_007, -5, 4]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    ranked, n = global_rank(df, [F.col("v")])
    assert n == len(values)
    assert [r["v"] for r in ranked.orderBy("rank").collect()] == sorted(values)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(n))
    for k in range(n):
        assert kth_smallest(df, "v", k, buckets=3) == sorted(values)[k]
    assert kth_smallest(df.where("v > 1e12"), "v", 0) is None


def test_empty_graph(spark):
    df = spark.createDataFrame([], "src long, dst long")
    walks = build_walks(df)
    assert walks.empty and reach_pairs(df, walks=walks).count() == 0
    assert strongly_connected(df, walks).count() == 0
    files = spark.range(3).select(F.lit("head").alias("rev"), "id")
    assert [round(r["pagerank"], 9) for r in pagerank(files, df).collect()] == [round(1 / 3, 9)] * 3


