import pytest

from depweave.sources.resolve import resolve_imports

CASES = [
    # language, importing file, specifier, files, resolved
    ("typescript", "src/a.ts", "./b", ["src/a.ts", "src/b.ts"], "src/b.ts"),
    ("typescript", "src/a.ts", "./b.js", ["src/a.ts", "src/b.ts"], "src/b.ts"),
    ("typescript", "src/a.ts", "./b.js", ["src/b.ts", "src/b.js"], "src/b.js"),
    ("typescript", "src/a.ts", "./feature", ["src/feature/index.ts"], "src/feature/index.ts"),
    ("typescript", "src/a.ts", "react", ["react.ts"], None),
    ("javascript", "a.js", "node:fs", ["fs.js"], None),
    ("javascript", "a.js", "./b", ["a.js", "b.js"], "b.js"),
    ("javascript", "src/a.js", "..", ["index.js"], "index.js"),
    ("javascript", "a.js", "../b", ["b.js"], None),
    ("typescript", "src/deep/a.ts", "../b.js", ["src/b.ts"], "src/b.ts"),
    ("typescript", "src/a.ts", "./b", ["src/b.tsx", "src/b.js", "src/b/index.ts"], "src/b.tsx"),
    ("python", "pkg/main.py", ".models", ["pkg/models.py"], "pkg/models.py"),
    ("python", "pkg/main.py", "pkg.utils", ["pkg/utils.py"], "pkg/utils.py"),
    ("python", "app/main.py", "app.sub", ["app/sub/__init__.py"], "app/sub/__init__.py"),
    ("python", "app/main.py", "app.sub", ["app/sub/__init__.py", "app/sub.py"], "app/sub.py"),
    ("python", "a/b/c.py", "..x", ["a/x.py", "a/b/x.py"], "a/x.py"),
    ("python", "a/b/c.py", ".", ["a/b/__init__.py"], "a/b/__init__.py"),
    ("python", "a/c.py", "....x", ["x.py"], "x.py"),
    ("python", "c.py", ".", ["__init__.py"], "__init__.py"),
    ("python", "pkg/main.py", "os", ["pkg/os.py"], None),
    ("python", "pkg/main.py", "numpy.linalg", [], None),
    ("java", "x/A.java", "com.lib.Helper", ["com/lib/Helper.java"], "com/lib/Helper.java"),
    ("java", "x/A.java", "com.lib.Helper", ["z/com/lib/Helper.java", "src/com/lib/Helper.java"], "src/com/lib/Helper.java"),
    ("java", "x/A.java", "com.lib.*", ["com/lib/Helper.java"], None),
]


def test_every_case(spark):
    """One job: each case is a revision of its own."""
    imports = [(str(i), src, lang, raw) for i, (lang, src, raw, _, _) in enumerate(CASES)]
    files = [(str(i), p) for i, (_, _, _, paths, _) in enumerate(CASES) for p in paths]
    found = resolve_imports(
        spark.createDataFrame(imports, "rev string, path string, language string, raw string"),
        spark.createDataFrame(files, "rev string, path string"),
    )
    got = {int(r["rev"]): r["resolved"] for r in found.collect()}
    assert len(got) == len(CASES)
    for i, case in enumerate(CASES):
        assert got[i] == case[4], case


@pytest.mark.parametrize("copies", [12])
def test_a_package_all_files_import_is_spread(spark, monkeypatch, copies):
    monkeypatch.setattr("depweave.operators.skew.HOT_FLOOR", 4)
    monkeypatch.setattr("depweave.operators.skew.SLICE_ROWS", 2)
    monkeypatch.setattr("depweave.operators.skew.lookup.__defaults__", ("inner", None, 4))
    imports = [("r", f"m{i}.py", "python", "util") for i in range(copies)]
    found = resolve_imports(
        spark.createDataFrame(imports, "rev string, path string, language string, raw string"),
        spark.createDataFrame([("r", "util.py")], "rev string, path string"),
    )
    assert [r["resolved"] for r in found.collect()] == ["util.py"] * copies
