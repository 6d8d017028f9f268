"""Queries that once did a part of their job, and steps that once grew faster than their input."""

from graphs import graph
from test_kernels import all_distances, cyclic, random_edges

from depweave import session
from depweave.operators import analysis, codegraph, components, context, reach, walks
from depweave.operators.analysis import Analysis
from depweave.plans import catalog, workspace
from depweave.sources import resolve
from depweave.sources.extract import extract_facts


class Bench:
    """A workspace over a graph made by hand."""

    def __init__(self, analysis):
        self.analysis = analysis


def test_reach_out_has_every_file(spark):
    starts = [(f"s{i}.py", "t.py") for i in range(14)]
    nodes = sorted({n for e in starts for n in e} | {"u.py"})
    w = Bench(Analysis(graph(spark, nodes, [*starts, ("t.py", "u.py")])))
    found = {tuple(r) for r in catalog.CATALOG["reach_out"](w).collect()}
    assert found == {(s, "t.py", 1) for s, _ in starts} | {(s, "u.py", 2) for s, _ in starts} | {("t.py", "u.py", 1)}


def test_rules_on_imports_look_for_no_cycles(spark, monkeypatch):
    nodes = ["orders/a.test.ts", "orders/b.ts", "suppliers/n1x/s.java", "promo/low/t.ts", "x/tests/u.ts"]
    edges = [(nodes[0], nodes[2]), (nodes[1], nodes[2]), (nodes[3], nodes[4]), (nodes[1], nodes[3]), (nodes[3], nodes[1])]
    plain = Analysis(graph(spark, nodes, edges))
    monkeypatch.setattr(components, "strongly_connected", None)
    w = Bench(plain)
    w.import_rules = plain.configured(workspace.LAYERED, workspace.STRICT)
    rows = {(r["file"], r["to_path"]) for r in catalog.CATALOG["forbidden_imports"](w).collect()}
    assert rows == {(nodes[0], nodes[2]), (nodes[3], nodes[4])}
    layered = {(r["from"], r["to"]) for r in catalog.CATALOG["layer_violations"](w).collect()}
    assert layered == {(nodes[1], nodes[3])}


def test_parts_of_a_context_without_ranks(spark, monkeypatch):
    edges = [("promo/a.py", "b/c.py"), ("b/c.py", "d/e.py"), ("d/e.py", "promo/a.py")]
    plain = Analysis(graph(spark, sorted({n for e in edges for n in e}), edges))
    none = spark.createDataFrame([], "path string, name string")
    want = {"dependency_edges": {("promo/a.py", "b/c.py"), ("b/c.py", "d/e.py"), ("d/e.py", "promo/a.py")}, "affected_modules": {("promo",), ("b",), ("d",)}}
    monkeypatch.setattr(analysis, "pagerank", None)
    monkeypatch.setattr(components, "strongly_connected", None)
    for name, rows in want.items():
        part = context.build_context(plain, none, "fix promo", parts=(name,))
        assert list(part) == [name] and {tuple(r) for r in part[name].collect()} == rows


def test_large_joins_of_records_are_not_broadcast(spark):
    rows = [("head", f"a/m{i}.py", "python", 10, f"import b{i}\nclass C{i}(D):\n  pass\n", f"k{i}") for i in range(4)]
    files = spark.createDataFrame(rows, "rev string, path string, language string, size long, text string, key string")
    records = resolve.assemble(files, extract_facts(files))
    for df in (records, codegraph.code_edges(records, "r"), *codegraph.map_graph(codegraph.code_nodes(records, "r"), codegraph.code_edges(records, "r"))):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_loops_over_dealt_edges(spark, monkeypatch):
    """Graphs past every small size: single steps, edges dealt once, labels merged and looked up."""
    edges = random_edges(3, 60, 110)
    for limit in (0, 20):
        for module in (session, reach, components):
            monkeypatch.setattr(module, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(walks, "WALK_EDGES", 5)
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        table = walks.build_walks(df)
        assert table.steps == 1
        start = spark.createDataFrame([(min(edges)[0],)], "id long")
        away = {t: d for (s, t), d in all_distances(edges).items() if s == min(edges)[0]}
        assert {r["dst"]: r["hop"] for r in reach.reach_pairs(df, start, table).collect()} == away
        assert {r["id"] for r in reach.reachable_from(df, start, table).collect()} == {*away, min(edges)[0]}
        assert {r["id"]: r["comp"] for r in components.strongly_connected(df, table).collect()} == cyclic(edges)
    plan = table.table.where("src > 0")
    with session.dealt(plan, "src", limit + 1) as held:
        assert held.is_cached and held.count() == plan.count()
    assert not held.is_cached
