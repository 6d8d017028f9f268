"""Steps over the imports that once shuffled or wrote more than their result needs."""

from collections import Counter

from graphs import graph

from depweave.model import DepGraph, stack_revisions
from depweave.operators import analysis, compare, skew
from depweave.operators.analysis import Analysis
from depweave.operators.skew import HotKeys, hot_keys
from depweave.plans import catalog
from depweave.sources import tables

LINES = [(1, 7, 3), (1, 7, 4), (1, 8, 3), (2, 7, 3), (2, None, 3), (2, None, 3), (None, 9, 5), (None, 9, 5), (3, 6, None), (1, 7, 3)]


def _edges(lines, kept=lambda order: True):
    found = {(o, ("part", p)) for o, p, _ in lines if kept(o)} | {(o, ("supplier", s)) for o, _, s in lines if kept(o)}
    own = lambda kind, key: None if key is None else key if kind == "part" else -(key * 8 + 3)
    return Counter((None if o is None else -(o * 8 + 1), own(*to)) for o, to in found)


def test_line_edges_are_dealt_once(spark, tmp_path):
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(1,), (3,), (3,), (None,)], "o_orderkey long")
    lines, none = tables.line_imports(spark, str(tmp_path))
    hot = hot_keys(lines, "src", lines.count(), floor=2)
    assert not none.slices and {k for k, _ in hot.slices} == {-9, -17}
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    for keys in (none, hot, HotKeys(hot.key_type, [(-9, 1)])):
        assert rows(tables.line_edges(lines, keys)) == _edges(LINES)
        assert rows(tables.line_edges(lines, keys, orders)) == _edges(LINES, lambda order: order in (1, 3))
    plan = tables.line_edges(lines, none)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stacked_long_ids_stay_long(spark):
    file = "id long, path string, lang string, loc int, size long, n_exports int, n_functions int, n_classes int"
    files = lambda ids: spark.createDataFrame([(i, f"p{i}", "x", 1, 1, 1, 1, 1) for i in ids], file)
    edges = lambda *pairs: spark.createDataFrame(pairs, "src long, dst long")
    both = stack_revisions({
        "base": DepGraph.of(files([1, -2, 3]), edges((1, -2), (-2, 3), (3, None)), trusted=True),
        "head": DepGraph.of(files([1, -2, 4]), edges((1, -2), (4, 1), (None, 4)), trusted=True),
    })
    assert both.files.schema["id"].dataType.typeName() == "long"
    assert both.files.select("id").distinct().count() == 6
    ends = [r[0] for r in both.edges.selectExpr("explode(array(src, dst))").collect()]
    # As before, a null id is a node of its revision, and no file.
    assert None not in ends and len(set(ends) - {r["id"] for r in both.files.collect()}) == 2
    changed = {tuple(r) for r in compare.dependency_changes(Analysis(both)).collect()}
    assert changed == {("removed", "p-2", "p3"), ("added", "p4", "p1")}
    assert compare.coupling_delta(Analysis(both)).first()[0] == 0


def test_coupling_writes_no_tables(spark, monkeypatch):
    base = graph(spark, ["a/x", "a/y", "b/z"], [("a/x", "a/y"), ("b/z", "a/y")])
    head = graph(spark, ["a/x", "a/y", "b/z", "b/w"], [("a/x", "a/y"), ("b/z", "a/y"), ("b/w", "a/y"), ("b/w", "a/x")])
    both = Analysis(stack_revisions({"base": base, "head": head}))
    monkeypatch.setattr(analysis, "keep", None)
    monkeypatch.setattr(analysis, "keep_counted", None)
    assert compare.coupling_delta(both).first()[0] == 4
    assert {tuple(r) for r in compare.coupling_increased(both).collect()} == {("a/x", 1, 2), ("a/y", 2, 3), ("b/w", 0, 2)}
    trends = {(r["module"], r["before"], r["after"]) for r in compare.module_coupling_trends(both).collect()}
    assert trends == {("a", 3, 5), ("b", 1, 3)}


def test_edges_of_a_folder_need_no_degrees(spark, monkeypatch):
    class Bench:
        analysis = Analysis(graph(spark, ["orders/a", "orders/b", "x/c"], [("orders/a", "orders/b"), ("x/c", "orders/a"), ("orders/b", "x/c")]))

    monkeypatch.setattr(analysis, "with_degrees", None)
    assert [tuple(r) for r in catalog.CATALOG["subgraph_folder_edges"](Bench()).collect()] == [("orders/a", "orders/b")]


def test_first_count_of_hot_keys_is_small():
    """Every task sends one row for each bucket at most; there are far more buckets than hot keys."""
    assert 16 * skew.HOT_SHARE < skew.HASH_BUCKETS <= 1 << 16
