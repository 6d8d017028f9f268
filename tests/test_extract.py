"""Golden facts of short sources in every language."""

import ast
import os
import time
from pathlib import Path

import pytest

from depweave.sources import extract
from depweave.sources.extract import EXTRACTORS, facts_or_empty
from depweave.sources.facts_table import register

TS = '''
import type { A } from "./a";
import def, * as ns from './ns.js'
export { x as y, z } from "./re";
export * from "./star";
export default class Foo<T> extends ns.Base<T> implements I1, I2<string> {
  private a?: number = 3;
  static async run<T>(x: T): Promise<void> { const y = `a ${x} }`; }
  get v() { return 1; }
  abstract foo(): void;
  [key: string]: any;
  constructor(private z: string) { super(); }
}
export const r = async (x: number): Promise<number> => x, MAX = 10;
const fn = function () { function hidden() {} return require("./inner"); }
function outer() { function nested() {} require("./no"); }
(() => { function visible() {} })();
if (x) { class InBlock {} }
export default function () { return 1 }
export interface Named { name: string }
export const enum Kind { A }
const re = /["'`]/g, two = 2
let noinit
const dyn = await import("./dyn")
// c1
/* c2 */
'''


def names(facts, kind=None):
    return [s["name"] for s in facts["symbols"] if kind in (None, s["kind"])]


def raws(facts):
    return [i["raw"] for i in facts["imports"]]


def test_typescript():
    facts = EXTRACTORS["typescript"](TS)
    assert raws(facts) == ["./a", "./ns.js", "./re", "./star", "./inner", "./dyn"]
    assert names(facts, "class") == ["Foo", "InBlock"]
    assert names(facts, "method") == ["run", "v", "constructor"]
    assert names(facts, "function") == ["r", "fn", "outer", "visible"]
    assert names(facts, "interface") == ["Named"] and names(facts, "enum") == ["Kind"]
    assert names(facts, "variable") == ["a", "MAX", "re", "two", "noinit", "dyn"]
    foo = facts["symbols"][0]
    assert foo["extends"] == ["ns.Base"] and foo["implements"] == ["I1", "I2"] and foo["exported"]
    assert foo["line"] == 6
    assert facts["exports"] == ["x", "z", "default", "Foo", "r", "MAX", "Named", "Kind"]
    assert facts["comments"] == ["/* c2 */", "// c1"]


ODD_SCRIPT = """#!/usr/bin/env node
export const a1 = `one ${`two ${ {x: "}"}.x } \\` three`} four`;
export const a2 = <T,>(x: T) => x;
export const { aa, bb } = make(), [c1 = 2] = list;
export const half = (a1) / 2; // not / a pattern
if (a1) /['"`]/.test(b);
export const rx = /[/"]\\/`/g.exec("`");
const m: Map<string, number> = new Map<string, Array<number>>(), n2 = 1;
export const view = () => <div title="it's" on={() => { const q = `}`; return q; }}>
  // not a comment, don't stop {list.map((x) => <li key={x}>{x}'s `tick</li>)}
  <Foo.Bar /> <></>
</div>;
export function after<T extends { a: string }>(x: T) { return x < 3 && y > 2; }
let i = 0; i++ / 2; const j = x! / 4 / 1;
export const lazy = `${require("./in-template")}`;
const cmp = a < b, d9 = c > d;
export const cast = <number>half;
function* gen() { yield /x"/; }
export { last as named } from "./last";
"""


def test_templates_patterns_and_tags_hide_nothing():
    facts = EXTRACTORS["typescript"](ODD_SCRIPT)
    assert facts["exports"] == [
        "a1", "a2", "{ aa, bb }", "[c1 = 2]", "half", "rx", "view", "after", "lazy", "cast", "last",
    ]
    kinds = {s["name"]: s["kind"] for s in facts["symbols"]}
    assert kinds == {
        "a1": "variable", "a2": "function", "{ aa, bb }": "variable", "[c1 = 2]": "variable", "half": "variable",
        "rx": "variable", "m": "variable", "n2": "variable", "view": "function", "after": "function", "i": "variable",
        "j": "variable", "lazy": "variable", "cmp": "variable", "d9": "variable", "cast": "variable", "gen": "function",
    }
    assert raws(facts) == ["./in-template", "./last"]
    assert facts["comments"] == ["// not / a pattern", "#!/usr/bin/env node"]


def test_what_never_ends_costs_only_itself():
    for start in ("const t = `open", "const v = <div>text", "f(a, {", "/* open", "class A { m() {", "x = [1, ("):
        facts = EXTRACTORS["javascript"](f'import "./first";\n{start}\nexport const kept = 1;\nexport function f2() {{}}\nimport "./end";\n')
        assert facts["exports"] == ["kept", "f2"], start
        assert raws(facts) == ["./first", "./end"], start


def test_a_minified_line_is_read_in_time():
    text = "export const k=`${[1].map(x=>`a${x}`)}`,f=(a)=>/[/]/.test(a)?<b>{a}</b>:a/2;" * 3000
    start = time.perf_counter()
    facts = EXTRACTORS["javascript"](text)
    assert facts["exports"] == ["k", "f"] and len(facts["symbols"]) == 6000
    assert time.perf_counter() - start < 20


def test_members_are_never_exported_and_know_their_class():
    facts = EXTRACTORS["typescript"]("export class A { b = 1; c() {} }")
    assert [(s["name"], s["parent"], s["exported"]) for s in facts["symbols"][1:]] == [
        ("b", "A", False), ("c", "A", False),
    ]


def test_javascript_fields_are_no_symbols():
    facts = EXTRACTORS["javascript"]('const b = require("./b");\nclass A extends B { x = 1; m() {} }\nmodule.exports = { A };')
    assert raws(facts) == ["./b"] and names(facts) == ["b", "A", "m"]
    assert facts["symbols"][1]["extends"] == [] and facts["exports"] == []


PYTHON = '''"""Module."""
from __future__ import annotations
import os, numpy.linalg as la
from .models import User
from .. import other
try:
    import fast
except ImportError:
    fast = None

# leading
def greet():
    """Greet."""
    import hidden
    return 1

@decorated
class Thing(Base, mod.Mixin, metaclass=M):
    """Thing."""
    @property
    def method(self):
        def inner(): pass

LIMIT: int = 3
a, b = 1, 2
_private = 1
'''


def test_python():
    facts = EXTRACTORS["python"](PYTHON)
    assert raws(facts) == ["os", "numpy.linalg", ".models", "..", "fast"]
    assert [(s["name"], s["kind"], s["exported"]) for s in facts["symbols"]] == [
        ("greet", "function", True), ("Thing", "class", True), ("method", "method", True),
        ("LIMIT", "variable", True), ("_private", "variable", False),
    ]
    thing = facts["symbols"][1]
    assert thing["extends"] == ["Base", "mod.Mixin"] and thing["doc"] == "Thing."
    assert facts["symbols"][2]["parent"] == "Thing"
    assert facts["exports"] == ["greet"]  # decorated definitions are no exports
    assert facts["comments"] == ["# leading"]


def test_python_that_does_not_parse_keeps_its_top_level():
    facts = EXTRACTORS["python"]("import os\nfrom .a import b\ndef f(:\n  pass\nclass C: pass\n")
    assert raws(facts) == ["os", ".a"] and names(facts) == ["f", "C"]


BROKEN = '''# old
import os, sys as system, a.b
from . import near; from ..far import (x,
    y)
LIMIT = 10; other: int = 3
if LIMIT:
    import inside
    try: import urllib2
    except ImportError, e: import urllib.request
class Old(Base, mod.Mixin, metaclass=M, object):
    """Kept."""
    name = "no symbol"
    def method(self, x=(1, 2)):
        "Short"
        print "import nothing"
        def inner(): import hidden
    @property
    def _private(self): return self._x
    class Inner: pass
async def work(a, b={"k": [1]}):
    ''' + "'''long\n    text'''" + '''
    exec "code" in scope
@wrapped
def decorated(): pass
def open_bracket(a, b
    return call(1,
class After:
    def still(self): pass
text = """def no(): pass
import no"""
total = 1 \\
    + 2
total += 1
def _hidden(): pass
'''


def test_python_that_does_not_parse_loses_only_the_broken_line():
    facts = EXTRACTORS["python"](BROKEN)
    assert raws(facts) == ["os", "sys", "a.b", ".", "..far", "inside", "urllib2", "urllib.request"]
    found = [(s["name"], s["kind"], s["parent"], s["doc"]) for s in facts["symbols"]]
    assert found == [
        ("LIMIT", "variable", None, None), ("other", "variable", None, None), ("Old", "class", None, "Kept."),
        ("method", "method", "Old", "Short"), ("_private", "method", "Old", None), ("work", "function", None, "long\n    text"),
        ("decorated", "function", None, None), ("open_bracket", "function", None, None), ("After", "class", None, None),
        ("still", "method", "After", None), ("text", "variable", None, None), ("total", "variable", None, None),
        ("_hidden", "function", None, None),
    ]
    assert next(s for s in facts["symbols"] if s["name"] == "Old")["extends"] == ["Base", "mod.Mixin", "object"]
    assert facts["exports"] == ["Old", "work", "open_bracket", "After"]
    assert facts["comments"] == ["# old"]


def test_text_that_starts_with_a_letter_of_a_prefix():
    """The letters before the quote tell a formatted text or bytes, not those behind it."""
    docs = {"'Fetch it'": "Fetch it", '"be brief"': "be brief", 'R"""raw"""': "raw", "f'x'": None, "rb'x'": None, "Fr'x'": None}
    for text, doc in docs.items():
        (found,) = extract.python_by_indentation(f"def a():\n    {text}\n")["symbols"]
        assert found["doc"] == doc, text


def test_indentation_reader_agrees_with_the_parser_on_sound_texts():
    """Modules of the standard library: every symbol, line, base, text, import and comment."""
    folder = Path(os.__file__).parent
    read = 0
    for file in sorted([*folder.glob("*.py"), *folder.glob("*/*.py")])[::9]:
        try:
            text = file.read_text(encoding="utf-8")
            ast.parse(text)
        except (SyntaxError, UnicodeDecodeError):
            continue
        if "\\" in text and '"""' in text or len(text) > 60_000:  # escapes in texts are read as they are written
            continue
        mine, theirs = (extract.python_by_indentation(text), extract.python_facts(text))
        for key in ("symbols", "imports", "exports", "comments"):
            assert sorted(map(str, mine[key])) == sorted(map(str, theirs[key])), (file.name, key)
        read += 1
    assert read > 25


JAVA = """package a.b;
import static java.util.Map.of;
import java.util.*;
/** doc */
@Entity(name = "x")
public final class Foo<T extends Bar> extends Base<T> implements A, b.C {
  private static final int X = 1, Y = 2;
  @Override public List<String> get(int a) throws E { if (a) { return null; } }
  public Foo(int x) { super(x); }
  abstract void nope();
  static { init(); }
  enum Color { RED, GREEN; int f() { return 1; } }
  public interface Inner { int K = 1; void go(); }
}
"""


def test_java():
    facts = EXTRACTORS["java"](JAVA)
    assert raws(facts) == ["java.util.Map.of", "java.util.*"]
    assert [(s["name"], s["kind"], s["exported"]) for s in facts["symbols"]] == [
        ("Foo", "class", True), ("X", "variable", False), ("Y", "variable", False), ("get", "method", True),
        ("nope", "method", False), ("Color", "enum", False), ("Inner", "interface", True), ("go", "method", False),
    ]
    foo = facts["symbols"][0]
    assert foo["line"] == 5 and foo["implements"] == ["b.C", "A"] and "Base" in foo["extends"]
    assert facts["exports"] == ["Foo", "Inner"] and facts["comments"] == ["/** doc */"]


def test_odd_texts_yield_facts_and_never_fail():
    for language in EXTRACTORS:
        for text in ("", "\x00", "'", "`${`", "/*", "}{)(", "class", "export", "import", "function(", "<" * 50, "@"):
            assert set(facts_or_empty(language, text)) == {"symbols", "imports", "exports", "comments"}


def test_table_function(spark):
    register(spark)
    texts = [(1, "python", "import os\ndef f(): pass"), (2, "javascript", None), (3, "cobol", "import x"), (4, None, "x"), (5, "typescript", "")]
    spark.createDataFrame(texts, "id int, language string, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, f.* FROM texts, LATERAL source_facts(language, text) f").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [
        (1, "symbol", "f", "function", 2, True, None), (1, "import", "os", None, 1, None, None), (1, "export", "f", None, None, None, None),
    ]))
    with pytest.raises(Exception, match="no extractor for 'cobol'"):
        spark.sql("SELECT * FROM source_facts('cobol', 'x')").collect()
    with pytest.raises(Exception, match="text must be a string"):
        spark.sql("SELECT * FROM source_facts('python', 3)").collect()
