import json
import re

from pyspark.sql import functions as F

from depweave import config
from depweave.functions import classify, exprs
from depweave.functions.globs import glob_regex
from depweave.functions.tokens import STOP_WORDS, keywords
from depweave.operators import history
from depweave.operators.context import request_keywords
from depweave.sources.ignore import compile_rules, ignored


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_globs():
    match = lambda glob, path: bool(re.search(glob_regex(glob), path))
    assert match("**/main.*", "main.ts") and match("**/main.*", "a/b/main.ts") and not match("**/main.*", "xmain.ts")
    assert match("src/*.ts", "src/a.ts") and not match("src/*.ts", "src/b/a.ts")
    assert match("tests/**", "tests/a/b.ts") and not match("tests/**", "x/tests/a.ts")
    assert match("a?c", "abc") and not match("a?c", "a/c") and match("x[1].{a}", "x[1].{a}")


def test_classifiers(spark):
    paths = ["src/main.ts", "src/api/login.ts", "src/models/user.ts", "src/config.ts", "tests/login.test.ts", "src/util.ts"]
    pick = lambda p: [x for x, hit in zip(paths, values(spark, paths, p)) if hit]
    assert pick(classify.entry_kind) == ["src/main.ts", "src/api/login.ts"]
    assert pick(classify.is_api_route) == ["src/api/login.ts"]
    assert pick(classify.is_model) == ["src/models/user.ts"]
    assert pick(classify.is_config) == ["src/config.ts"]
    assert pick(classify.is_test) == ["tests/login.test.ts"]
    kinds = ["pages/x.ts", "routes/api/x.ts", "handler/x.ts", "setup.py", "__main__.py", "main.test.ts"]
    assert values(spark, kinds, classify.entry_kind) == ["page/route", "route", "handler", "entry", "main", None]
    names = ["a.TS", "b.tsx", "c.mjs", "d.py", "e.java", "f.txt", ".ts", "g"]
    assert values(spark, names, classify.language_of) == [
        "typescript", "typescript", "javascript", "python", "java", None, None, None,
    ]


def test_paths(spark):
    assert values(spark, ["a/b/c.ts", "c.ts", "a/b"], exprs.dirname) == ["a/b", "", "a"]
    assert values(spark, ["a/b.ts", "b.ts"], exprs.top_dir) == ["a", "(root)"]
    assert values(spark, ["x/session.test.ts", "session_spec.py", "a.b.ts", "plain"], exprs.stem) == [
        "session", "session", "a.b", "plain",
    ]
    assert values(spark, ["a/./b/../c", "../x", "a/../../x", "", "./a//b"], exprs.normalize_path) == [
        "a/c", "../x", "../x", "", "a/b",
    ]
    renames = ["src/{a => b}/c.ts", "old.ts => new.ts", "lib/{x => }/m.ts", "plain.ts"]
    assert values(spark, renames, exprs.normalize_rename) == ["src/b/c.ts", "new.ts", "lib/m.ts", "plain.ts"]


def test_numbers(spark):
    assert values(spark, [0.5, -0.5, 1.5, 2.4999999999999], exprs.js_round, "double") == [1, 0, 2, 3]
    assert values(spark, [-3.0, 55.5, 140.0], exprs.clamp_score, "double") == [0, 56, 100]
    assert values(spark, [95, 80, 79, 55, 54], exprs.grade, "int") == ["A", "B", "C", "D", "F"]
    assert values(spark, [9, 10, 30, 55, 80], exprs.churn_level, "int") == ["Very Low", "Low", "Medium", "High", "Extreme"]
    assert values(spark, [2, 4, 5], exprs.cycle_severity, "int") == ["low", "medium", "high"]


def test_texts(spark):
    assert values(spark, ["", "a", "a\n", "a\r\nb\rc\nd"], exprs.line_count) == [0, 1, 2, 4]
    assert values(spark, ["<a href='x'>&\""], exprs.html_escape) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    request = "Please MODIFY the Auth-login flow, auth and db!"
    assert values(spark, [request], keywords) == [["auth", "login", "flow"]]
    assert request_keywords(request) == ["auth", "login", "flow"]
    assert len(STOP_WORDS) == len(set(STOP_WORDS))


def test_config(tmp_path):
    root = str(tmp_path)
    assert config.load_scan_config(root) == config.ScanConfig()
    assert config.load_analysis_config(root) == config.AnalysisConfig()
    assert config.load_governance_config(root) == config.GovernanceConfig()
    (tmp_path / config.ANALYSIS_FILE).write_text(json.dumps({
        "thresholds": {"minSignals": 3, "odd": 1}, "layers": [{"name": "ui", "patterns": ["ui/**"]}],
        "rules": [{"from": "ui", "cannotImport": ["db"]}],
    }))
    loaded = config.load_analysis_config(root)
    assert loaded.thresholds.min_signals == 3 and loaded.thresholds.loc == 300
    assert loaded.layers[0].name == "ui" and loaded.rules[0].cannot_import == ("db",)
    (tmp_path / config.GOVERNANCE_FILE).write_text(json.dumps({
        "rules": {"maxImports": 3, "allowCircularDependencies": True}, "failOn": "warning",
        "forbiddenImports": [{"from": "a/**", "to": "b/**", "message": "no"}],
    }))
    rules = config.load_governance_config(root)
    assert rules.rules.max_imports == 3 and rules.rules.allow_circular_dependencies and rules.fail_on == "warning"
    assert rules.forbidden_imports[0].message == "no"
    (tmp_path / config.GOVERNANCE_FILE).write_text("[1]")
    assert config.load_governance_config(root) == config.GovernanceConfig()


def test_history_of_text_dates(spark):
    rows = [
        ("c1", "a/x", "Ada", "2024-01-01", 10, 0), ("c2", "a/x", "Bob", "2024-01-05", 5, 5),
        ("c2", "a/y", "Bob", "2024-01-05", 1, 1), ("c3", "z", "Ada", "2024-03-01", 2, 0),
    ]
    schema = "commit_id string, path string, author string, ts string, insertions long, deletions long"
    stats = history.file_history(spark.createDataFrame(rows, schema))
    churn = {r["path"]: (r["churn"], r["score"], r["level"]) for r in history.churn(stats).collect()}
    assert churn == {"a/x": (20, 100, "Extreme"), "a/y": (2, 10, "Low"), "z": (2, 10, "Low")}
    steady = {r["path"]: r["stability"] for r in history.stability(stats).collect()}
    assert steady == {"a/x": 0, "a/y": 62, "z": 62}
    row = history.evolution_insights(stats).first()
    assert (row["most_changed_module"], row["most_stable_subsystem"], row["newest_layer"]) == ("a", "a", "(root)")
    assert row["fastest_growing_subsystem"] == "(root)" and row["most_volatile_file"] == "a/x"


def test_timeline(spark):
    commits = spark.range(11).select(F.col("id").alias("n"))
    pick = lambda k: sorted(r["n"] for r in history.sample_timeline(commits, k, [F.col("n")]).collect())
    assert pick(5) == [0, 3, 5, 8, 10] and pick(1) == [0] and pick(50) == list(range(11)) and pick(2) == [0, 10]


def test_repeated_rule_keeps_its_place(spark):
    rules = compile_rules(["*.log", "!a.log", "*.log", "!a.log"])
    assert values(spark, ["a.log", "b.log"], lambda p: ignored(p, rules)) == [False, True]
