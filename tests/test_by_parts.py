"""Components by contraction of blocks, against plain Python."""

import numpy as np
import pytest
from test_kernels import GRAPHS, cyclic, random_edges

from depweave.operators import components

# Rings of four, each of which imports the ring before; all of them import two shared files.
RINGS = [(4 * r + i, 4 * r + (i + 1) % 4) for r in range(6) for i in range(4)]
LINKED = sorted({*RINGS, *((4 * r + 4, 4 * r) for r in range(5)), *((4 * r + 1, 24 + r % 2) for r in range(6))})


def frame(spark, edges, kind="long"):
    return spark.createDataFrame([*edges], f"src {kind}, dst {kind}")


@pytest.mark.parametrize("edges", [*GRAPHS, set(), {(3, 3)}])
def test_components_of_one_task(edges):
    names = sorted({n for e in edges for n in e})
    tail, head = (np.array([names.index(e[i]) for e in sorted(edges)], np.int64) for i in (0, 1))
    part = components.strong_parts(tail, head, len(names))
    want = cyclic(edges)
    assert [names[p] for p in part] == [want.get(n, n) for n in names]


def test_small_cycles_come_together_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_EDGES", 12)
    monkeypatch.setattr(components, "_by_colours", None)
    found = components.strongly_connected(frame(spark, LINKED))
    assert {r["id"]: r["comp"] for r in found.collect()} == {n: 4 * (n // 4) for n in range(24)}


def test_cycles_of_cycles(spark, monkeypatch):
    """The rings are blocks of their own; a way back joins them when they have become one node each."""
    monkeypatch.setattr(components, "BLOCK_EDGES", 12)
    found = components.strongly_connected(frame(spark, [*LINKED, (6, 21), (24, None), (None, 3), (5, 5)]))
    assert {r["id"]: r["comp"] for r in found.collect()} == {n: 4 * (n // 4) if n < 4 else 4 for n in range(24)}


@pytest.mark.parametrize("limit", [1, 8, 500_000])
def test_components_of_any_block_size(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BLOCK_EDGES", limit)
    edges = random_edges(7, 40, 60)
    assert {r["id"]: r["comp"] for r in components.strongly_connected(frame(spark, edges)).collect()} == cyclic(edges)


def test_names_are_numbered_in_their_order(spark):
    edges = [("b", "a"), ("a", "c"), ("c", "b"), ("d", "a"), ("d", None)]
    found = components.strongly_connected(frame(spark, edges[:4], "string"))
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
