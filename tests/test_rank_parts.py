"""PageRank along the graph of components, against plain Python and against the rounds."""

import pytest
from graphs import graph
from pyspark.sql import functions as F
from test_by_parts import LINKED, frame
from test_kernels import distances, ranks

from depweave.operators import centrality, reach, walks
from depweave.operators.analysis import Analysis


def test_ranks_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(centrality, "_by_rounds", None)
    files = spark.range(26).select(F.lit("head").alias("rev"), "id")
    found = {r["id"]: r["pagerank"] for r in centrality.pagerank(files, frame(spark, LINKED)).collect()}
    assert found == pytest.approx(ranks(26, LINKED), abs=1e-14)


def test_ranks_of_revisions_and_odd_ends(spark, monkeypatch):
    """Files twice, missing ids, ends that are no files: as by rounds. Each revision has its own total."""
    edges = [*LINKED, (7, None), (None, 3), (8, 99), (99, 98), (30, 31), (31, 30), (31, 32), (31, 32)]
    rows = [("a", n) for n in [*range(26), 4, 25, None]] + [("b", n) for n in (30, 31, 32, 33)]
    files = spark.createDataFrame(rows, "rev string, id long")
    listed = lambda df: sorted(((r["rev"], str(r["id"])), r["pagerank"]) for r in df.collect())
    edges = spark.createDataFrame(edges, "src long, dst long")
    slow = listed(centrality._by_rounds(files, edges, 0.85, 40, centrality.build_walks(edges)))
    monkeypatch.setattr(centrality, "_by_rounds", None)
    fast = listed(centrality.pagerank(files, edges))
    assert [k for k, _ in fast] == [k for k, _ in slow] and len(fast) == len(rows)
    assert [x for _, x in fast] == pytest.approx([x for _, x in slow], abs=1e-14)


@pytest.mark.parametrize("name, limit", [("MAX_LEVELS", 2), ("BLOCK_EDGES", 3)])
def test_deep_graphs_and_large_components_go_by_rounds(spark, monkeypatch, name, limit):
    called = []
    by_rounds = centrality._by_rounds
    monkeypatch.setattr(centrality, "_by_rounds", lambda *a: called.append(1) or by_rounds(*a))
    monkeypatch.setattr(centrality, name, limit)
    files = spark.range(26).select(F.lit("head").alias("rev"), "id")
    found = {r["id"]: r["pagerank"] for r in centrality.pagerank(files, frame(spark, LINKED)).collect()}
    assert called and found == pytest.approx(ranks(26, LINKED), abs=1e-12)


def test_large_edges_are_not_written_again_for_walks(spark, monkeypatch):
    edges = frame(spark, LINKED)
    monkeypatch.setattr(walks, "WALK_EDGES", 5)
    monkeypatch.setattr(walks, "keep", None)
    monkeypatch.setattr(walks, "keep_counted", None)
    table = walks.build_walks(edges, rows=len(LINKED))
    assert table.steps == 1 and not table.weighted
    start = spark.createDataFrame([(0,)], "id long")
    found = {r["dst"]: r["hop"] for r in reach.reach_pairs(edges, start, table, "in").collect()}
    assert found == distances({(b, a) for a, b in LINKED}, 0)


def test_rounds_over_a_large_graph_have_weights(spark, monkeypatch):
    """Ids that are no numbers go by rounds, with weights although the shared walks of a large graph have none."""
    monkeypatch.setattr(walks, "WALK_EDGES", 5)
    names = [f"{n:02}.py" for n in range(26)]
    whole = Analysis(graph(spark, names, [(names[a], names[b]) for a, b in LINKED]))
    assert not whole.walks.weighted
    found = {names.index(r["id"]): r["pagerank"] for r in whole.pagerank.collect()}
    assert found == pytest.approx(ranks(26, LINKED), abs=1e-12)
