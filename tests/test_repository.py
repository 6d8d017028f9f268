"""A source tree and a scratch git repository from the files to the answers."""

import json
import os
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from depweave import Repository
from depweave.operators import codegraph, compare
from depweave.operators.fingerprint import graph_fingerprint, stored_result
from depweave.sinks import export, reports
from depweave.sources import git, tree
from depweave.sources.ignore import compile_rules, ignored
from depweave.sources.workspaces import package_folders, stated_patterns

FILES = {
    "index.ts": 'import { foo } from "./src/a.js";\nfoo();\n',
    "src/a.ts": 'import { helper } from "./b.js";\nimport r from "react";\nexport function foo() { return helper(); }\nexport const bar = () => 42;\nexport class Baz {}\n',
    "src/b.ts": "export function helper() { return 1; }\n",
    "src/animal.ts": "export interface Named { name: string }\nexport class Animal { move() {} }\nexport class Dog extends Animal implements Named { bark() {} }\n",
    "pkg/__init__.py": "",
    "pkg/main.py": "from .models import User\nfrom pkg.utils import helper\nimport os\n\nclass App:\n    def run(self):\n        return User()\n",
    "pkg/models.py": "class User:\n    pass\n\ndef _private():\n    pass\n",
    "pkg/utils.py": "def helper():\n    return 1\n",
    "com/app/Server.java": "package com.app;\nimport com.lib.Helper;\nimport java.util.List;\npublic class Server { public void start() {} }\n",
    "com/lib/Helper.java": "package com.lib;\npublic class Helper {}\n",
    "node_modules/x/i.js": "module.exports = 1;\n",
    ".hidden/h.ts": "export const h = 1;\n",
    ".github/script.js": "const s = 1;\n",
    "vendor/v.js": "const v = 1;\n",
    "gen/keep.js": "const k = 1;\n",
    "gen/drop.js": "const d = 1;\n",
    "notes.txt": "nothing",
    ".gitignore": "vendor/\n/gen/*\n!gen/keep.js\n# comment\n",
}


def fill(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    fill(folder, FILES)
    os.symlink(folder / "src/a.ts", folder / "link.ts")
    return folder


@pytest.fixture(scope="module")
def repo(spark, root, tmp_path_factory):
    return Repository(spark, str(root), cache=str(tmp_path_factory.mktemp("facts") / "facts"))


READ = {
    "index.ts", "src/a.ts", "src/b.ts", "src/animal.ts", "pkg/__init__.py", "pkg/main.py", "pkg/models.py",
    "pkg/utils.py", "com/app/Server.java", "com/lib/Helper.java", ".github/script.js", "gen/keep.js",
}


def test_walk_reads_supported_files_that_are_not_ignored(spark, root):
    rows = tree.walk(spark, str(root)).collect()
    assert {r["path"] for r in rows} == READ
    assert {r["path"]: r["size"] for r in rows}["src/b.ts"] == len(FILES["src/b.ts"])


def test_walk_config(spark, root, tmp_path):
    fill(tmp_path, {**FILES, "depweave.scan.json": json.dumps({"exclude": ["**/b.ts", "com"], "languages": ["typescript", "java"]})})
    assert {r["path"] for r in tree.walk(spark, str(tmp_path)).collect()} == {"index.ts", "src/a.ts", "src/animal.ts"}
    (tmp_path / "depweave.scan.json").write_text("not json")
    assert {r["path"] for r in tree.walk(spark, str(tmp_path)).collect()} == READ


def test_ignore_rules(spark):
    rules = compile_rules(["*.log", "!keep.log", "/top", "doc/**/x", "a[0-9].js", "dir/", "#no", "", "\\#yes"])
    cases = {
        "a.log": True, "d/a.log": True, "keep.log": False, "top/x": True, "d/top": False, "doc/x": True,
        "doc/a/b/x": True, "a1.js": True, "ab.js": False, "dir/f": True, "dir": False, "#yes": True, "#no": False,
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r["path"]: r["i"] for r in df.select("path", ignored(F.col("path"), rules).alias("i")).collect()}
    assert got == cases


def test_file_graph(repo):
    edges = codegraph.file_edges(repo.file_nodes)
    assert {(r["source"][5:], r["target"][5:]) for r in edges.collect()} == {
        ("index.ts", "src/a.ts"), ("src/a.ts", "src/b.ts"), ("pkg/main.py", "pkg/models.py"),
        ("pkg/main.py", "pkg/utils.py"), ("com/app/Server.java", "com/lib/Helper.java"),
    }
    rows = {r["path"]: r for r in repo.file_nodes.collect()}
    a = rows["src/a.ts"]
    assert [f["name"] for f in a["functions"]] == ["foo", "bar"] and [c["name"] for c in a["classes"]] == ["Baz"]
    assert a["exports"] == ["foo", "bar", "Baz"] and (a["name"], a["dir"], a["loc"]) == ("a.ts", "src", 6)
    assert rows["pkg/__init__.py"]["loc"] == 0 and rows["index.ts"]["dir"] == ""
    assert not rows["com/app/Server.java"]["functions"]  # methods are no file-level functions
    assert [i["external"] for i in rows["pkg/main.py"]["imports"]] == [False, False, True]


def test_property_graph(repo):
    ids = {r["id"] for r in repo.code_edges.collect()}
    sym = "sym:src/animal.ts#"
    assert f"EXTENDS:{sym}class:Dog@3->{sym}class:Animal@2" in ids
    assert f"IMPLEMENTS:{sym}class:Dog@3->{sym}interface:Named@1" in ids
    assert f"CONTAINS:{sym}class:Dog@3->{sym}method:bark@3" in ids
    assert "CONTAINS:dir:com->dir:com/app" in ids and f"CONTAINS:repo:{repo.root}->dir:com" in ids
    assert "IMPORTS:file:pkg/main.py->pkg:os" in ids and "IMPORTS:file:src/a.ts->pkg:react" in ids
    assert f"EXPORTS:file:src/animal.ts->{sym}class:Dog@3" in ids
    assert len(ids) == repo.code_edges.count()
    types = {r["type"]: r["nodes"] for r in codegraph.node_type_counts(repo.code_nodes).collect()}
    assert types["File"] == len(READ) and types["Repository"] == 1 and types["Interface"] == 1
    nodes, edges = repo.map_graph()
    assert {r["type"] for r in nodes.collect()} == {"File", "Directory", "Package"}
    assert {r["type"] for r in edges.collect()} == {"IMPORTS", "CONTAINS"}


def test_facts_are_cached_by_content(repo, spark, root, monkeypatch):
    first = {r["path"]: r for r in repo.records.collect()}
    seen = []
    monkeypatch.setattr(
        "depweave.sources.cache.extract_facts",
        lambda texts, real=__import__("depweave.sources.extract", fromlist=["x"]).extract_facts: (
            seen.append(texts.count()), real(texts))[1],
    )
    (root / "src/new.ts").write_text("export const fresh = 1;\n")
    try:
        again = {r["path"]: r for r in tree.scan(spark, str(root), cache=repo.cache).collect()}
    finally:
        (root / "src/new.ts").unlink()
    assert seen == [1]
    assert again.pop("src/new.ts")["exports"] == ["fresh"] and again == first


def test_questions(repo):
    assert repo.dependency_path("index.ts", "src/b.ts").count() == 3
    assert {(r["relation"], r["path"]) for r in repo.search_imports("a.ts").collect()} == {
        ("dependency", "src/b.ts"), ("dependent", "index.ts"),
    }
    hits = repo.search_symbol("helper")
    assert {r["path"] for r in hits["hits"].collect()} >= {"src/b.ts", "pkg/utils.py"}
    assert {r["reference"] for r in hits["references"].collect()} == {"src/a.ts", "pkg/main.py", "com/app/Server.java"}
    metrics = repo.search_file("index.ts")["metrics"].first()
    assert (metrics["transitive_imports"], metrics["depth"], metrics["transitive_dependents"]) == (2, 2, 0)
    report = repo.impact("src/b.ts")
    assert [(r["path"], r["hop"]) for r in report["affected"].collect()] == [("src/a.ts", 1), ("index.ts", 2)]
    assert report["report"].first()["affected"] == 2
    assert repo.impact("no/such/file") is None
    assert {r["path"] for r in repo.find_entry_points().collect()} == {"index.ts", "pkg/main.py"}
    parts = repo.build_context("fix the animal helper")
    assert {r["path"] for r in parts["related"].collect()} >= {"src/animal.ts", "src/b.ts", "pkg/utils.py"}


def test_reports_and_export(repo, spark, tmp_path):
    rows = list(reports.ordered(reports.report_rows(repo.analysis)))
    assert [r["part"] for r in rows] == sorted(r["part"] for r in rows)
    facts = {r["item"]: r["value"] for r in rows if r["part"] == "count"}
    assert facts["files"] == str(len(READ)) and int(facts["errors"]) == sum(r["part"] == "error" for r in rows)
    assert "[score]" in list(reports.text_lines(rows)) and f"  files = {len(READ)}" in list(reports.text_lines(rows))
    page = "".join(reports.html_lines(rows, "<root>"))
    assert "&lt;root&gt;" in page and "<meter" in page and "<root>" not in page
    assert [json.loads(x)["item"] for x in reports.json_lines(rows)] == [r["item"] for r in rows]
    export.write_export(repo.records, repo.root, str(tmp_path / "out"))
    nodes = spark.read.text(str(tmp_path / "out/section=nodes"))
    assert sorted(json.loads(r["value"])["path"] for r in nodes.collect()) == sorted(READ)
    export.save_code_graph(repo.code_nodes, repo.code_edges, str(tmp_path / "graph"))
    loaded, _ = export.load_code_graph(spark, str(tmp_path / "graph"))
    assert loaded.count() == repo.code_nodes.count()


def test_endpoints(repo):
    from depweave.endpoints import answer, whole

    paths = lambda df: {r["path"] for r in df.collect()}
    assert paths(answer(repo, "/api/search", {"q": "SRC/", "limit": "2"})) == {"src/a.ts", "src/animal.ts"}
    assert paths(answer(repo, "/api/neighbors", {"id": "src/a.ts"})["nodes"]) == {"index.ts", "src/a.ts", "src/b.ts"}
    assert paths(answer(repo, "/api/subgraph", {"folder": "pkg", "minDegree": "1"})["nodes"]) == {
        "pkg/main.py", "pkg/models.py", "pkg/utils.py",
    }
    assert answer(repo, "/api/stats").first()["edges"] == 5
    assert answer(repo, "/api/impact", {"id": "nope"}) is None and answer(repo, "/nothing") is None
    assert answer(repo, "/graph.json")["edges"].count() > 0
    assert whole({"k": "x"}, "k", 7) == 7 and whole({"k": "3"}, "k", 7) == 3


def test_results_are_remembered_per_graph_and_settings(repo, spark, tmp_path):
    from depweave.config import AnalysisConfig, GovernanceConfig

    a = repo.analysis
    key = graph_fingerprint(a.files, a.edges, (a.config, a.governance))
    assert key == graph_fingerprint(a.files.repartition(3), a.edges, (a.config, a.governance)) == repo.fingerprint
    assert key != graph_fingerprint(a.files, a.edges, (AnalysisConfig(entry_points=()), GovernanceConfig()))
    assert key != graph_fingerprint(a.files, a.edges.limit(1), (a.config, a.governance))
    built = []
    make = lambda: built.append(1) or repo.hotspots()
    first = stored_result(spark, str(tmp_path / "hot"), make).count()
    assert stored_result(spark, str(tmp_path / "hot"), make).count() == first and built == [1]
    export.save_store(a.files, a.edges, str(tmp_path / "store"))
    files, edges = export.load_store(spark, str(tmp_path / "store"))
    assert files.where("path = 'src/b.ts'").first()["in_degree"] == 1 and edges.count() == 5


def test_commands(repo, tmp_path, capsys):
    from depweave import cli

    args = cli.parser().parse_args(["report", repo.root, "--format", "html", "--out", str(tmp_path / "r.html")])
    assert cli.COMMANDS["report"](repo, args) == 0 and "grade" in (tmp_path / "r.html").read_text()
    args = cli.parser().parse_args(["impact", repo.root, "no/such/file"])
    assert cli.COMMANDS["impact"](repo, args) == 1 and "no match" in capsys.readouterr().out
    args = cli.parser().parse_args(["insights", repo.root])
    assert cli.COMMANDS["insights"](repo, args) == 0 and "src/b.ts" in capsys.readouterr().out


def test_health_series(repo):
    first = repo.record_health("2024-01-01").collect()
    assert [r["direction"] for r in first] == ["first-scan"]
    second = repo.record_health("2024-02-01").orderBy("timestamp").collect()
    assert [r["direction"] for r in second] == ["first-scan", "stable"]


def test_workspaces(spark, tmp_path):
    fill(tmp_path, {
        "package.json": '{"workspaces": {"packages": ["./packages/*/", "tools", "!packages/old", 7]}}',
        "pnpm-workspace.yaml": "# kinds\npackages:\n  - 'apps/*' # all\n  - \"libs/**\"\nother:\n  - no/*\n",
        "packages/web/package.json": "{}", "packages/old/package.json": "{}", "apps/api/package.json": "{}",
        "tools/package.json": "{}", "libs/a/b/package.json": "{}", "no/x/package.json": "{}",
    })
    assert stated_patterns(str(tmp_path)) == (["packages/*", "tools", "apps/*", "libs/**"], ["packages/old"])
    paths = ["packages/web/src/x.ts", "packages/none/y.ts", "packages/old/z.ts", "apps/api/a.ts", "tools/t.py", "libs/a/b/c.ts", "no/x/n.ts", "top.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = sorted(r["package"] for r in package_folders(files, str(tmp_path)).collect())
    assert found == ["apps/api", "libs/a/b", "packages/web", "tools"]
    assert package_folders(files, str(tmp_path / "apps")).count() == 0


def run(folder, *args, when="2024-01-01T00:00:00+00:00", author="Ada"):
    env = {
        **os.environ, "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": author,
        "GIT_AUTHOR_EMAIL": "a@example.org", "GIT_COMMITTER_NAME": author, "GIT_COMMITTER_EMAIL": "a@example.org",
    }
    subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("git")
    run(folder, "init", "-b", "main")
    fill(folder, {"src/a.ts": 'import { b } from "./b";\nexport const a = b;\n', "src/b.ts": "export const b = 1;\n"})
    run(folder, "add", ".")
    run(folder, "commit", "-m", "first")
    fill(folder, {"src/a.ts": 'import { b } from "./b";\nexport const a = b + 1;\n', "src/c.ts": 'import { b } from "./b";\nexport const c = b;\n'})
    run(folder, "add", ".")
    run(folder, "commit", "-m", "second", when="2024-02-01T00:00:00+00:00", author="Bob")
    return Repository(spark, str(folder))


def test_git_history(history, spark):
    assert git.is_repository(history.root) and not git.is_repository("/")
    assert [r["subject"] for r in history.commits().orderBy("position").collect()] == ["second", "first"]
    assert git.branches(history.root) == ["main"] and git.tags(history.root) == []
    stats = {r["path"]: r for r in history.file_stats.collect()}
    assert (stats["src/a.ts"]["commits"], stats["src/a.ts"]["authors"]) == (2, 2)
    assert (stats["src/a.ts"]["insertions"], stats["src/a.ts"]["deletions"]) == (3, 1)
    assert stats["src/c.ts"]["commits"] == 1 and stats["src/a.ts"]["first_date"].startswith("2024-01-01")
    report = history.history_report(with_coupling=True)
    assert report["evolution"].first()["most_changed_module"] == "src"
    assert [(r["module"], r["before"], r["after"]) for r in report["coupling"].collect()] == [("src", 2, 4)]
    assert [r["subject"] for r in history.timeline(2).collect()] == ["first", "second"]
    assert [tuple(r)[2:] for r in history.replay(2).collect()] == [("2024-01-01", "first", 2, 1), ("2024-02-01", "second", 3, 2)]
    assert history.file_history("src/a.ts")["commits"].count() == 2
    assert git.read_file(history.root, "HEAD~1", "src/a.ts").endswith("a = b;\n")
    assert git.read_file(history.root, "HEAD", "none.ts") is None


def test_replay_keeps_revisions_without_sources(spark, tmp_path):
    run(tmp_path, "init", "-b", "main")
    fill(tmp_path, {"notes.txt": "nothing"})
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-m", "words only", when="2023-05-06T00:00:00+00:00")
    fill(tmp_path, {"a.ts": "export const a = 1;\n"})
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-m", "code")
    rows = [tuple(r)[2:] for r in Repository(spark, str(tmp_path)).replay(5).collect()]
    assert rows == [("2023-05-06", "words only", 0, 0), ("2024-01-01", "code", 1, 0)]


def test_health_series_survives_a_broken_write(spark, tmp_path, monkeypatch):
    fill(tmp_path, {"a.ts": "export const a = 1;\n"})
    repo = Repository(spark, str(tmp_path))
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        repo.record_health(day)
    days = lambda: sorted(r["timestamp"] for r in repo.health_history().collect())
    assert days() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert len(list(Path(repo.health_folder).glob("generation-*"))) == 2  # the newest and the one before

    def broken(self, target):
        raise OSError("power cut")

    monkeypatch.setattr(Path, "replace", broken)
    with pytest.raises(OSError, match="power cut"):
        repo.record_health("2024-01-04")
    assert days() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    monkeypatch.undo()
    repo.record_health("2024-01-05")
    assert days() == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"]


def test_a_half_written_result_is_built_anew(spark, tmp_path):
    make = lambda: spark.range(5)
    folder = tmp_path / "result"
    stored_result(spark, str(folder), make)
    (folder / "_SUCCESS").unlink()
    next(folder.glob("part-*")).unlink()
    assert stored_result(spark, str(folder), make).count() == 5
    assert stored_result(spark, str(folder), lambda: spark.range(9)).count() == 5


def test_tree_changes(spark):
    """One-to-one by content: two of three copies move, the third is deleted; unknown contents never move."""
    base = [("same", "s"), ("edit", "1"), ("c1", "x"), ("c2", "x"), ("c3", "x"), ("gone", "g"), ("odd", None), (None, "n"), ("same", "s")]
    head = [("same", "s"), ("edit", "2"), ("d1", "x"), ("d2", "x"), ("new", "h"), ("odd2", None)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, key string")
    found = {tuple(r) for r in compare.tree_changes(frame(base), frame(head)).collect()}
    assert found == {
        ("M", "edit", None), ("R", "d1", "c1"), ("R", "d2", "c2"), ("D", "c3", None), ("D", "gone", None),
        ("D", "odd", None), ("A", "new", None), ("A", "odd2", None),
    }
    none = frame([])
    assert {r["status"] for r in compare.tree_changes(none, frame(head)).collect()} == {"A"}
    assert compare.tree_changes(none, none).count() == 0


def test_renamed_and_oddly_named_files(spark, tmp_path):
    run(tmp_path, "init", "-b", "main")
    fill(tmp_path, {"a.ts": "export const a = 1;\n", "b\nc.ts": "export const b = 1;\n"})
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-m", "first")
    run(tmp_path, "mv", "a.ts", "moved.ts")
    run(tmp_path, "commit", "-m", "second")
    changed = git.changed_files(spark, str(tmp_path), "HEAD~1", "HEAD").collect()
    assert [tuple(r) for r in changed] == [("R", "moved.ts", "a.ts")]
    sources = git.revision_sources(spark, str(tmp_path), "HEAD").collect()
    assert {r["path"]: r["text"] for r in sources} == {"moved.ts": "export const a = 1;\n", "b\nc.ts": "export const b = 1;\n"}
    assert git.comparison_base(str(tmp_path)) == "HEAD~1" and git.comparison_base(str(tmp_path), "v1") == "v1"


def test_git_compare(history):
    diff = history.compare("HEAD~1", "HEAD")
    assert {(r["status"], r["path"]) for r in diff["changed_files"].collect()} == {("M", "src/a.ts"), ("A", "src/c.ts")}
    assert [tuple(r) for r in diff["dependencies"].collect()] == [("added", "src/c.ts", "src/b.ts")]
    assert diff["cycles"].count() == 0
    assert history.compare("HEAD~1", "nowhere") is None
    branch = history.analyze_branch("HEAD~1")
    row = branch["report"].first()
    assert row["blast_radius_increase"] == 2 and row["passes"]
    assert [(r["from"], r["to"]) for r in branch["new_dependencies"].collect()] == [("src/c.ts", "src/b.ts")]
    assert {r["path"]: (r["before"], r["after"]) for r in branch["coupling_increased"].collect()} == {
        "src/b.ts": (1, 2), "src/c.ts": (0, 1),
    }
