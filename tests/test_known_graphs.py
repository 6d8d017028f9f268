"""Scores, cycles, rules and impact on the graphs of ``graphs.py``, against plain Python and by hand."""

import pytest
from pyspark.sql import functions as F

from depweave.config import AnalysisConfig, ForbiddenImport, GovernanceConfig, Layer, LayerRule
from depweave.operators import health, impact, reach, rules, store
from depweave.operators.analysis import Analysis
from depweave.operators.degrees import with_degrees
from graphs import SPECS, Plain, graph, stacked

PLAIN = {rev: Plain(*spec) for rev, spec in SPECS.items()}


@pytest.fixture(scope="module")
def analysis(spark):
    return Analysis(stacked(spark))


def by_rev(df, value):
    out = {}
    for row in df.collect():
        out.setdefault(row["rev"], {})[row["path"]] = value(row)
    return out


def test_hotspot_scores(analysis):
    assert by_rev(analysis.scores, lambda r: r["score"]) == {rev: p.score for rev, p in PLAIN.items()}


def test_hotspot_list_is_cut_and_explained(analysis):
    rows = analysis.hotspots.where("rev = 'harbour'").orderBy(F.desc("score"), "path").collect()
    assert len(rows) == 10 and rows[0]["path"] == "quay.py"
    assert rows[0]["reasons"] == ["many dependents", "high centrality", "large file", "wide public API"]
    assert [r["score"] for r in rows] == sorted(PLAIN["harbour"].score.values(), reverse=True)[:10]


def test_pagerank(analysis):
    named = analysis.pagerank.join(analysis.files.select("id", "path"), "id")
    for rev, ranks in by_rev(named, lambda r: r["pagerank"]).items():
        assert ranks == pytest.approx(PLAIN[rev].rank, abs=1e-9)
        assert sum(ranks.values()) == pytest.approx(1.0, abs=1e-9)


def test_health(analysis):
    """Worked out from the counts: quarry has three pairs on cycles among ten files and two God modules."""
    rows = {r["rev"]: r for r in analysis.health.collect()}
    quarry, ladder = rows["quarry"], rows["ladder"]
    assert (quarry["cycles"], quarry["cycle_files"], quarry["god_modules"], quarry["errors"], quarry["unused"]) == (3, 6, 2, 3, 4)
    mean = sum(sorted(PLAIN["quarry"].score.values(), reverse=True)[:10]) / 10
    assert quarry["stability"] == round(100 - 60 - mean * 0.3)
    assert quarry["modularity"] == 0  # 100 - 6/10 * 150 - 4/10 * 80 - 8, never below nothing
    assert quarry["coupling"] == 100 and ladder["coupling"] == 98  # 2 * 14 / 13 imports a file are 0.15 above two
    assert (ladder["cycles"], ladder["errors"]) == (0, 0)
    assert {r["grade"] for r in rows.values()} <= set("ABCDF")


def test_health_from_volatile_files(analysis, spark):
    steady = spark.createDataFrame([("step00.ts", 10), ("step01.ts", 90), ("zz.ts", 0)], "path string, stability long")
    share = health.volatile_share(analysis.files, steady)
    inputs = health.health_inputs(analysis, analysis.violations)
    rows = {r["rev"]: r["stability"] for r in health.health_scores(inputs, share).collect()}
    assert rows["ladder"] != rows["harbour"] and rows["mill"] == 100


def test_cycles(analysis):
    rows = {(r["rev"], r["first_file"]): r for r in analysis.cycles.collect()}
    assert set(rows) == {(rev, c[0]) for rev, p in PLAIN.items() for c in p.cycles}
    ring = rows[("harbour", "ring/gate0.ts")]
    assert (ring["length"], ring["severity"], ring["break_from"], ring["break_to"]) == (4, "medium", "ring/gate0.ts", "ring/gate1.ts")
    assert {rows[("quarry", f"pair/l{i}.ts")]["severity"] for i in range(3)} == {"low"}
    members = by_rev(analysis.cycle_members, lambda r: r["path"])
    assert {rev: set(m) for rev, m in members.items()} == {rev: p.on_cycle for rev, p in PLAIN.items() if p.cycles}


def test_cycle_is_an_error_that_knows_its_files(analysis):
    errors = analysis.violations.where("rev = 'harbour' and severity = 'error'").collect()
    assert [(e["rule"], e["file"]) for e in errors] == [("noCircularDependencies", "ring/gate0.ts")]
    assert errors[0]["detail"].startswith("cycle (medium): 4 files from ring/gate0.ts")


def test_god_modules(analysis):
    found = by_rev(analysis.god_modules, lambda r: r["reasons"])
    assert found == {"quarry": {
        "rock/big.ts": ["301 LOC (> 300)", "21 functions (> 20)"], "rock/wide.py": ["7 classes (> 6)", "16 exports (> 15)"],
    }}


def test_unused(analysis):
    found = by_rev(analysis.unused, lambda r: r["reasons"])
    assert found["mill"] == {
        "attic/old.ts": ["no dependents", "unreachable from entry points"],
        "attic/box.ts": ["no dependents", "no exports", "no imports", "unreachable from entry points"],
        "checks/tests/all.ts": ["no dependents", "no exports", "unreachable from entry points"],
        "pages/home.ts": ["no dependents", "no exports", "unreachable from entry points"],
    }


def test_node_metrics(analysis):
    for r in analysis.node_metrics.collect():
        plain = PLAIN[r["rev"]]
        ahead, behind = plain.ahead[r["path"]], plain.behind[r["path"]]
        assert (r["transitive_imports"], r["transitive_dependents"]) == (len(ahead), len(behind))
        assert r["depth"] == max(ahead.values(), default=0)


def test_depth_rule(analysis):
    deep = analysis.violations.where("rule = 'maxDependencyDepth'").collect()
    want = {p: max(a.values()) for p, a in PLAIN["ladder"].ahead.items() if a and max(a.values()) > 10}
    assert {r["file"]: r["detail"] for r in deep} == {p: f"dependency depth {d} (> 10)" for p, d in want.items()}


def test_summary(analysis):
    for row in analysis.summary.collect():
        plain = PLAIN[row["rev"]]
        assert (row["files"], row["edges"], row["cycles"]) == (len(plain.paths), len(plain.edges), len(plain.cycles))
        best = max(round(r, 12) for r in plain.rank.values())
        assert row["most_central"] == min(p for p, r in plain.rank.items() if round(r, 12) == best)


def test_blast_radius_of_every_file_and_of_given_ones(analysis):
    every = {(r["rev"], r["path"]): r for r in impact.blast_radius(analysis, impact.counts_of_all(analysis)).collect()}
    assert len(every) == sum(len(p.paths) for p in PLAIN.values())
    for (rev, path), r in every.items():
        assert (r["affected"], r["max_hop"], r["raw_score"]) == pytest.approx(PLAIN[rev].blast(path, r["tests"], r["entries"]), abs=1e-6)
        assert r["in_cycle"] == (path in PLAIN[rev].on_cycle)
    stone = every[("mill", "wheel/stone.ts")]
    assert (stone["tests"], stone["entries"], stone["direct"]) == (2, 3, 3)  # by import and by name; page, route, main
    targets = analysis.files.where("path IN ('wheel/stone.ts', 'ring/gate2.ts', 'index.ts')").select("id")
    affected = impact.affected_files(analysis.edges, targets)
    few = impact.blast_radius(analysis, impact.counts_of_targets(analysis.files, analysis.edges, affected), targets).collect()
    assert {r["path"] for r in few} == {"wheel/stone.ts", "ring/gate2.ts", "index.ts"}
    assert all(every[(r["rev"], r["path"])] == r for r in few)


def one(analysis, rev, path):
    return analysis.files.where((F.col("rev") == rev) & (F.col("path") == path)).select("id")


def test_impact_hops_and_reasons(analysis):
    target = one(analysis, "ladder", "step09.ts")
    affected = impact.affected_files(analysis.edges, target)
    rows = {r["path"]: (r["hop"], r["reason"]) for r in impact.affected_with_reason(analysis.files, analysis.edges, affected).collect()}
    assert {p: h for p, (h, _) in rows.items()} == PLAIN["ladder"].behind["step09.ts"]
    assert rows["step07.ts"] == (1, "imports step09.ts") and rows["step02.ts"] == (4, "imports step05.ts")


def test_affected_tests_by_import_and_by_name(analysis):
    target = one(analysis, "mill", "wheel/stone.ts")
    affected = impact.affected_files(analysis.edges, target, analysis.walks)
    rows = impact.affected_tests(analysis.files, affected, target).collect()
    assert sorted((r["path"], r["via"]) for r in rows) == [("checks/tests/all.ts", "import"), ("wheel/stone.test.ts", "naming")]
    kinds = impact.affected_entry_points(analysis.files, affected).collect()
    assert sorted((r["path"], r["kind"]) for r in kinds) == [("main.ts", "main"), ("pages/home.ts", "page/route"), ("routes/sell.ts", "route")]
    assert impact.affected_files(analysis.edges, one(analysis, "mill", "main.ts")).count() == 0


def test_layers_and_forbidden_imports(analysis):
    config = AnalysisConfig(
        layers=(Layer("yard", ("wheel/**",)), Layer("front", ("pages/**", "routes/**"))), rules=(LayerRule("front", ("yard",)),)
    )
    banned = GovernanceConfig(forbidden_imports=(ForbiddenImport("attic/*", "wheel/**"), ForbiddenImport("main.*", "routes/*", "through the pages")))
    ruled = analysis.configured(config, banned)
    rows = ruled.layer_violations.collect()
    assert sorted((r["from"], r["to"], r["rule"]) for r in rows) == [
        ("pages/home.ts", "wheel/grain.ts", "front cannot import yard"), ("routes/sell.ts", "wheel/stone.ts", "front cannot import yard"),
    ]
    found = {(r["rule"], r["detail"]) for r in ruled.violations.where("rev = 'mill'").collect()}
    assert found == {
        ("layerViolation", "front cannot import yard: pages/home.ts → wheel/grain.ts"),
        ("layerViolation", "front cannot import yard: routes/sell.ts → wheel/stone.ts"),
        ("forbiddenImport", "attic/old.ts must not import wheel/stone.ts"), ("forbiddenImport", "through the pages"),
    }


def test_gate(analysis):
    rows = {r["rev"]: r["passes"] for r in analysis.gate().collect()}
    assert rows == {"harbour": False, "ladder": True, "quarry": False, "mill": True}
    zero, some = F.lit(0), F.lit(1)
    row = analysis.files.select(
        rules.passes(zero, some, "warning"), rules.passes(some, some, "none"), rules.passes(some, zero, "odd")
    ).first()
    assert tuple(row) == (False, True, True)


def test_shortest_path(spark):
    """Two ways of three steps: the one by the smaller last file is taken; a longer way and a dead end are not."""
    edges = [("in", "b1"), ("in", "b2"), ("b1", "c2"), ("b2", "c1"), ("c1", "out"), ("c2", "out"), ("in", "d1"), ("d1", "d2"), ("d2", "d3"), ("d3", "out")]
    g = graph(spark, ["in", "b1", "b2", "c1", "c2", "d1", "d2", "d3", "out", "alone"], edges)
    ids = lambda x: spark.createDataFrame([(x,)], "id string")
    path = lambda x, y: [tuple(r) for r in reach.shortest_path(g.edges, ids(x), ids(y)).orderBy("hop").collect()]
    assert path("in", "out") == [(0, "in"), (1, "b2"), (2, "c1"), (3, "out")]
    assert path("d1", "d3") == [(0, "d1"), (1, "d2"), (2, "d3")] and path("d3", "out") == [(0, "d3"), (1, "out")]
    assert path("out", "in") == path("in", "alone") == []
    assert path("c1", "c1") == [(0, "c1")]


def test_store(spark):
    g = graph(spark, ["lib/x1", "lib/x2", "lib/sub/x3", "top"], [("lib/x1", "lib/x2"), ("lib/x2", "lib/sub/x3"), ("lib/sub/x3", "lib/x1")])
    degrees = with_degrees(g.files, g.edges)
    seed = lambda x: spark.createDataFrame([(x,)], "id string")
    near = lambda x, d, k: store.neighbors(g.files, g.edges, seed(x), d, k)
    names = lambda df: sorted(r["path"] for r in df.collect())
    nodes, edges = near("lib/x2", "both", 1)
    assert names(nodes) == ["lib/sub/x3", "lib/x1", "lib/x2"] and edges.count() == 3
    assert names(near("lib/x1", "out", 1)[0]) == ["lib/x1", "lib/x2"]
    assert names(near("lib/x1", "in", 1)[0]) == ["lib/sub/x3", "lib/x1"]
    assert names(near("top", "out", 3)[0]) == ["top"] and names(near("lib/x1", "out", 0)[0]) == ["lib/x1"]
    assert names(near("nowhere", "out", 2)[0]) == []
    assert names(store.subgraph(degrees, g.edges, folder="lib/sub")[0]) == ["lib/sub/x3"]
    assert names(store.subgraph(degrees, g.edges, limit=2)[0]) == ["lib/sub/x3", "lib/x1"]
    assert names(store.subgraph(degrees, g.edges, min_degree=1)[0]) == ["lib/sub/x3", "lib/x1", "lib/x2"]
    assert names(store.search_path(g.files, "  LIB ", 2)) == ["lib/sub/x3", "lib/x1"]
    assert names(store.search_path(g.files, " ")) == []
    assert names(store.search_path_short_first(g.files, "%")) == []
    assert store.resolve_target(g.files, "./lib/x2").first()["path"] == "lib/x2"
    assert store.resolve_target(g.files, "/srv/code/lib/x1").first()["path"] == "lib/x1"
    assert store.resolve_target(g.files, "x3").first()["path"] == "lib/sub/x3"
    assert store.resolve_target(g.files, "nothing").count() == 0


def test_loops_and_unknown_ends_are_dropped(spark):
    g = graph(spark, ["p", "q"], [("q", "q"), ("p", "q"), ("p", "q"), ("q", "away"), ("away", "p")])
    assert [tuple(r) for r in g.edges.collect()] == [("p", "q")]
