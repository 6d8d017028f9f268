"""Reach by blocks against plain Python, and loops that once took a round for every step of a chain."""

import pytest
from graphs import graph
from pyspark.sql import functions as F
from test_bitreach import NODES, edges_of
from test_kernels import all_distances

from depweave.operators import bitreach, components, walks
from depweave.operators.analysis import Analysis


def by_blocks(spark, edges, nodes, wrap=lambda c: c):
    df = spark.createDataFrame(sorted(edges), "src long, dst long").select(wrap(F.col("src")).alias("src"), wrap(F.col("dst")).alias("dst"))
    files = spark.createDataFrame([(i,) for i in nodes], "id long").select(wrap(F.col("id")).alias("id"))
    parts = components.strongly_connected(df)
    return bitreach.packed_reach(df, bitreach.numbered(files, parts), parts)


@pytest.mark.parametrize("limit", [0, 100, 500_000])  # all by rounds, some, all by blocks
def test_blocks_and_rounds_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(bitreach, "BLOCK_WORDS", 2)
    monkeypatch.setattr(bitreach, "BLOCK_EDGES", limit)
    edges = edges_of(3)
    rows = [tuple(r) for r in by_blocks(spark, edges, range(NODES)).pairs().collect()]
    pairs = all_distances(edges)
    assert len(rows) == len(pairs) and {(s, t): d for s, t, d in rows} == pairs


def test_no_rounds_where_blocks_reach_little(spark, monkeypatch):
    monkeypatch.setattr(bitreach, "bit_reach", None)
    chain = [(f"{i:03}.py", f"{i + 1:03}.py") for i in range(70)]
    found = Analysis(graph(spark, sorted({n for e in chain for n in e}), chain)).depths.collect()
    assert sorted((r["transitive_imports"], r["depth"]) for r in found) == [(n, n) for n in range(1, 71)]


def test_ids_of_two_revisions_and_ends_that_are_no_files(spark):
    pair = lambda c: F.struct(F.lit("head").alias("rev"), c.alias("node"))
    rows = by_blocks(spark, [(1, 2), (2, 1), (2, 9), (9, 8)], [1, 2, 3], pair).pairs()
    got = {(r["src"]["node"], r["dst"]["node"], r["hop"]) for r in rows.collect()}
    assert got == {(1, 2, 1), (1, 9, 2), (1, 8, 3), (2, 1, 1), (2, 9, 1), (2, 8, 2)}


def test_no_imports(spark):
    bits = by_blocks(spark, [], [1, 2])
    assert bits.ahead().count() == bits.behind().count() == 0


def test_long_cycles_take_few_rounds(spark, monkeypatch):
    rounds = []
    kept = components.keep_counted
    monkeypatch.setattr(components, "keep_counted", lambda *a: rounds.append(1) or kept(*a))
    ring = [(i, (i + 1) % 60) for i in range(60)]
    df = spark.createDataFrame([*ring, (5, 70)], "src long, dst long")
    found = components.strongly_connected(df, walks.single_steps(df))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(60)}
    assert len(rounds) < 30
