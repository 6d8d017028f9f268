"""Facts of one source text: declared symbols, imports, exports, comments.

``extract_facts`` is the Spark operator; the functions below it read one text each and know
nothing about other files. Resolution, line counts, caching and assembly are DataFrame jobs.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from depweave.schema import FACTS
from depweave.session import ship_package
from depweave.sources.indented import indented_facts
from depweave.sources.lexer import VALUE_SIGNS, Lexer, closers

_JAVA_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<str>\"{3}.*?\"{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<id>[#@]?[A-Za-z_$\u0080-￿][\w$]*)"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<p>=>|\.\.\.|[^\s])",
    re.S,
)
_BEFORE_VALUE = VALUE_SIGNS - {"/"} | set("return typeof new void case in of await throw".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Tokens(list):
    """Tokens ``(kind, text, line)`` of a brace language and its comments, last first."""

    def __init__(self, tokens: list, spans: list, source: str, comments: list[str]):
        super().__init__(tokens)
        self.spans, self.source, self.comments = spans, source, comments[::-1]
        self.ends = closers(tokens, spans, source)

    @classmethod
    def script(cls, text: str, typed: bool) -> _Tokens:
        read = Lexer(text, typed)
        return cls(read.tokens, read.spans, text, read.comments)

    @classmethod
    def java(cls, text: str) -> _Tokens:
        tokens, spans, comments = [], [], []
        at, line = 0, 1
        while (m := _JAVA_TOKEN.search(text, at)) is not None:
            line += text.count("\n", at, m.start())
            if m.lastgroup == "comment":
                comments.append(m.group())
            else:
                tokens.append((m.lastgroup, m.group(), line))
                spans.append(m.span())
            line += m.group().count("\n")
            at = m.end()
        return cls(tokens, spans, text, comments)

    def text(self, i: int) -> str:
        return self[i][1] if 0 <= i < len(self) else ""

    def raw(self, i: int, stop: int) -> str:
        """The source of the tokens from ``i`` up to ``stop``, as it is written."""
        return self.source[self.spans[i][0] : self.spans[stop - 1][1]] if i < stop <= len(self) else ""

    def after(self, i: int) -> int:
        """Index after the bracket group opened at ``i``."""
        return self.ends[i] if i < len(self) else i + 1

    def until(self, i: int, stops: str) -> int:
        """Index of the first of ``stops`` outside brackets."""
        while i < len(self) and not (self[i][0] == "p" and self[i][1] in stops):
            i = self.after(i) if self[i][1] in _CLOSE and self[i][0] == "p" else i + 1
        return i

    def angle(self, i: int) -> int:
        """Index after the type parameters or arguments opened by ``<`` at ``i``; ``i`` if it compares."""
        depth, at = 0, i
        while at < len(self):
            kind, piece, _ = self[at]
            if piece == "<":
                depth += 1
            elif piece == ">":
                depth -= 1
                if not depth:
                    return at + 1
            elif kind == "p" and piece not in _IN_TYPES:
                return i
            at = self.after(at) if piece in _CLOSE and kind == "p" else at + 1
        return i


_IN_TYPES = set(", . | & ? : = => [ ( { ...".split())


def _symbol(name, kind, line, exported, parent=None, extends=None, implements=None, doc=None):
    return dict(
        name=name, kind=kind, line=line, exported=exported, parent=parent,
        extends=extends or [], implements=implements or [], doc=doc,
    )


def _facts(symbols=(), imports=(), exports=(), comments=()):
    return dict(
        symbols=list(symbols),
        imports=[dict(raw=raw, line=line) for raw, line in imports],
        exports=list(dict.fromkeys(exports)),
        comments=list(comments),
    )


# --- JavaScript and TypeScript ---------------------------------------------------------------


def script_facts(text: str, typed: bool) -> dict:
    t = _Tokens.script(text, typed)
    symbols, imports, exports = [], [], []

    def heritage(i: int, end: int) -> tuple[list[str], list[str]]:
        found = {"extends": [], "implements": []}
        while i < end:
            word = t.text(i)
            if word in found:
                i += 1
                while i < end and t.text(i) not in found:
                    stop = i
                    while stop < end and t.text(stop) not in found and (t[stop][0] == "id" or t.text(stop) == "."):
                        stop += 1
                    name = "".join(t.text(k) for k in range(i, stop))
                    if name and t.text(stop) != "(":
                        found[word].append(name)
                    depth = 0
                    while stop < end and (depth or t.text(stop) != ",") and t.text(stop) not in found:
                        depth += (t.text(stop) in "<([{") - (t.text(stop) in ">)]}")
                        stop += 1
                    i = stop + (t.text(stop) == ",")
            else:
                i += 1
        return found["extends"], found["implements"]

    def members(i: int, end: int, parent: str) -> None:
        while i < end:
            first, line = i, t[i][2]
            stop = i
            while stop < end and t.text(stop) not in ("(", "{", ";", "=", ":") :
                stop = t.after(stop) if t.text(stop) == "[" else stop + 1
                if stop < end and t[stop][2] != t[stop - 1][2] and t[stop][0] == "id" and t.text(stop - 1) not in _MODIFIERS:
                    break
            cut = next((k for k in range(first + 1, stop) if t.text(k) == "<"), stop)
            name = next((t.text(k) for k in range(cut - 1, first - 1, -1) if t[k][0] in ("id", "str", "num")), None)
            if t.text(stop) == "(":
                stop = t.after(stop)
                stop = t.until(stop, "{;}") if t.text(stop) == ":" else stop
                if t.text(stop) == "{" and stop < end:
                    if name:
                        symbols.append(_symbol(name, "method", line, False, parent))
                    stop = t.after(stop)
            else:
                if name and typed and t.text(first) != "[" and not name.startswith("@"):
                    symbols.append(_symbol(name, "variable", line, False, parent))
                if t.text(stop) in ("=", ":"):
                    stop = _statement_end(t, stop + 1, end)
                elif t.text(stop) == "{":
                    stop = t.after(stop)
            i = max(stop + (t.text(stop) == ";"), first + 1)

    def declarators(i: int, line: int, exported: bool, on: bool) -> int:
        while True:
            if t.text(i) in _CLOSE:
                stop = t.after(i)
                name = t.raw(i, stop)  # a pattern is named as it is written
            else:
                name, stop = (t.text(i) if i < len(t) and t[i][0] == "id" else ""), i + 1
            value, stop = _declarator_value(t, stop)
            kind = "function" if value is not None and _is_function(t, value) else "variable"
            if on and name:
                symbols.append(_symbol(name, kind, line, exported))
            if exported and name:
                exports.append(name)
            end = stop
            if value is not None:
                end = _statement_end(t, value, len(t), commas=True)
                walk(value, end, False, False)
            if t.text(end) != ",":
                return end
            i = end + 1

    def walk(i: int, end: int, exported: bool, on: bool) -> None:
        while i < end:
            kind, word, line = t[i]
            start, prev = i, t.text(i - 1)
            i += 1
            if kind != "id" or prev == "." or (t.text(i) == ":" and word in _DECLARING):
                exported = exported and kind == "id"
                continue
            plain = prev not in _BEFORE_VALUE or prev in (";", "{", ":", "") or word in _STARTS and line > t[start - 1][2]
            if word == "import" and t.text(i) == "(" or word == "require" and t.text(i) == "(":
                if i + 1 < len(t) and t[i + 1][0] == "str" and t.text(i + 1)[0] != "`":
                    imports.append((t.text(i + 1)[1:-1], line))
            elif word == "import" and plain and t.text(i) != ".":
                stop = i
                while stop < end and t[stop][0] != "str" and t.text(stop) not in (";", "="):
                    stop += 1
                if stop < end and t[stop][0] == "str":
                    imports.append((t.text(stop)[1:-1], t[stop][2]))
                    i = stop + 1
            elif word == "export" and plain:
                i = export(i, end, on)
            elif word in ("async", "abstract", "declare", "default") and plain:
                continue  # the declaration follows, still exported
            elif word == "function" and (plain or prev in _PREFIX):
                i += t.text(i) == "*"
                name = t.text(i) if i < len(t) and t[i][0] == "id" else None
                body = t.until(i, "{;")
                if name:
                    symbols.append(_symbol(name, "function", _first_line(t, start), exported)) if on else None
                    if exported:
                        exports.append(name)
                    i = t.after(body) if t.text(body) == "{" else body
            elif word == "class" and (plain or prev in _PREFIX):
                name = t.text(i) if i < len(t) and t[i][0] == "id" and t.text(i) not in ("extends", "implements") else None
                body = t.until(i, "{;")
                if name:
                    ext, impl = heritage(i + 1, body) if typed else ([], [])
                    if on:
                        symbols.append(_symbol(name, "class", _first_line(t, start), exported, None, ext, impl))
                    if exported:
                        exports.append(name)
                    stop = t.after(body)
                    if on:
                        members(body + 1, stop - 1, name)
                    i = stop
            elif word in ("interface", "enum") and typed and i < len(t) and t[i][0] == "id" and (plain or prev in _PREFIX):
                if on:
                    symbols.append(_symbol(t.text(i), word, _first_line(t, start), exported))
                if exported:
                    exports.append(t.text(i))
                i = t.after(t.until(i, "{;"))
            elif word in ("const", "let", "var") and (plain or prev in ("export", "(", "declare")):
                if t.text(i) == "enum":
                    continue
                if prev == "(" and t.text(start - 2) in ("for", "await"):
                    stop = t.until(i, ";)")
                    if on:
                        symbols.append(_symbol(t.text(i), "variable", line, exported))
                    walk(i + 1, stop, False, False)
                    i = stop
                else:
                    i = declarators(i, line, exported, on)
            exported = False

    def export(i: int, end: int, on: bool) -> int:
        if t.text(i) == "default":
            exports.append("default")
        j = i + (t.text(i) == "type" and t.text(i + 1) in ("{", "*"))
        if t.text(j) in ("{", "*"):
            stop = t.after(j) if t.text(j) == "{" else j + 1
            if t.text(j) == "{":
                heads = [j + 1] + [k + 1 for k in range(j, stop) if t.text(k) == ","]
                heads = [k + (t.text(k) == "type" and t[k + 1][0] == "id" and t.text(k + 1) != "as") for k in heads]
                exports.extend(t.text(k) for k in heads if k < stop - 1 and t[k][0] in ("id", "str"))
            elif t.text(stop) == "as":
                stop += 2
            if t.text(stop) == "from" and stop + 1 < len(t) and t[stop + 1][0] == "str":
                imports.append((t.text(stop + 1)[1:-1], t[stop + 1][2]))
                stop += 2
            return stop
        stop = _statement_end(t, i, end)
        head = i
        while t.text(head) in ("default", "async", "abstract", "declare"):
            head += 1
        if t.text(head) in ("function", "class", "interface", "enum", "const", "let", "var"):
            body = t.until(head, "{;")
            if t.text(head) in ("function", "class", "interface", "enum") or t.text(head + 1) == "enum":
                stop = t.after(body) if t.text(body) == "{" else body
            walk(i, max(stop, i + 1), True, on)
        else:
            walk(i, stop, False, on)
        return max(stop, i + 1)

    walk(0, len(t), False, True)
    return _facts(symbols, imports, exports, t.comments)


_MODIFIERS = set("public private protected static readonly abstract override async get set declare accessor".split())
_PREFIX = {"export", "default", "async", "abstract", "declare", "const"}
_DECLARING = {"function", "class", "interface", "enum", "const", "let", "var", "export", "import", "default"}


def _first_line(t: _Tokens, i: int) -> int:
    while t.text(i - 1) in ("async", "abstract", "declare", "const"):
        i -= 1
    return t[i][2]


def _declarator_value(t: _Tokens, i: int) -> tuple[int | None, int]:
    """Start of the initialiser, if any, and end of the declarator whose name ends at ``i``."""
    while i < len(t) and t.text(i) not in ("=", ",", ";", "}", "of", "in"):
        if t[i][2] != t[i - 1][2] and t.text(i - 1) not in (":", "|", "&", "<", ",", "=>"):
            return None, i
        i = max(t.angle(i), i + 1) if t.text(i) == "<" else t.after(i) if t.text(i) in _CLOSE else i + 1
    return (i + 1 if t.text(i) == "=" else None), i


def _is_function(t: _Tokens, i: int) -> bool:
    i += t.text(i) == "async"
    if t.text(i) == "function":
        return t.text(i + 1) != "*"
    if t.text(i) == "<":
        i = t.angle(i)
    if t.text(i) == "(":
        i = t.after(i)
        return t.text(i) == "=>" or (t.text(i) == ":" and "=>" in [t.text(k) for k in range(i, t.until(i, ";{}"))])
    return i < len(t) and t[i][0] == "id" and t.text(i + 1) == "=>"


def _statement_end(t: _Tokens, i: int, end: int, commas: bool = False) -> int:
    """End of the expression at ``i``: a semicolon, a closing bracket or a line that starts anew."""
    first = i
    while i < end:
        word = t.text(i)
        if t[i][0] == "p" and (word in ";)]}" or (commas and word == ",")):
            return i
        if i > first and t[i][2] > t[i - 1][2] + t[i - 1][1].count("\n"):
            if word in _STARTS and (word != "import" or t.text(i + 1) not in ("(", ".")):
                return i
            goes_on = t.text(i - 1) in _BEFORE_VALUE or t[i - 1][1] in (".", "/", "as", "extends")
            if not goes_on and (t[i][0] in ("id", "str", "num") and word not in ("as", "in", "instanceof", "of") or word == "@"):
                return i
        if word == "<" and t[i][0] == "p" and (behind := t.angle(i)) > i and t.text(behind) in _AFTER_TYPES:
            i = behind  # commas between type arguments part nothing
        else:
            i = t.after(i) if word in _CLOSE and t[i][0] == "p" else i + 1
    return end


# Words that never go on an expression.
_STARTS = {"export", "import", "const", "let", "var"}
_AFTER_TYPES = set("( ) , ; [ ] } . ` =>".split()) | {""}


# --- Java ------------------------------------------------------------------------------------


def java_facts(text: str) -> dict:
    t = _Tokens.java(text)
    symbols, imports, exports = [], [], []

    def declared_at(i: int) -> int:
        """Index of the first modifier or annotation of the declaration whose keyword is at ``i``."""
        while i > 0:
            k = i - 1
            if t.text(k) == ")":
                while k > 0 and t.text(k) != "(":
                    k -= 1
                k -= 1
                if not t.text(k).startswith("@"):
                    break
            elif not (t.text(k) in _JAVA_MODIFIERS or t.text(k).startswith("@")):
                break
            i = k
        return i

    def types_in(i: int, end: int, stop_words=("implements", "permits", "extends")) -> list[str]:
        names, name = [], ""
        while i < end and t.text(i) not in stop_words:
            piece = t[i]
            if piece[0] == "id" and not piece[1].startswith("@") or piece[1] == ".":
                name = name + piece[1] if name.endswith(".") or piece[1] == "." else piece[1]
                if piece[0] == "id" and t.text(i + 1) != ".":
                    names.append(name)
                    name = ""
            i += 1
        return names[::-1]

    def members(i: int, end: int, parent: str, fields: bool) -> None:
        while i < end:
            first = i
            while t.text(i).startswith("@") and t.text(i) != "@interface":
                i = t.after(i + 1) if t.text(i + 1) == "(" else i + 1
            head, depth = i, 0
            while i < end and (depth or t.text(i) not in ("(", "{", ";", "=", ",")):
                depth += (t.text(i) == "<") - (t.text(i) == ">")
                i += 1
            words = [t.text(k) for k in range(head, i)]
            public = "public" in words
            names = [w for k, w in enumerate(words) if t[head + k][0] == "id" and w not in _JAVA_MODIFIERS]
            is_type = bool({"class", "interface", "enum", "record", "@interface"} & set(words))
            line = t[first][2] if first < len(t) else 0
            if is_type:
                i = t.after(t.until(i, "{;"))
            elif t.text(i) == "(":
                if len(names) > 1:
                    symbols.append(_symbol(names[-1], "method", line, public, parent))
                i = t.until(t.after(i), "{;")
                i = t.after(i) if t.text(i) == "{" else i + 1
            elif t.text(i) == "{":
                i = t.after(i)
            else:
                while i < end and len(names) > 1:
                    if fields:
                        symbols.append(_symbol(names[-1], "variable", line, public, parent))
                    i = t.until(i, ",;") if t.text(i) == "=" else i
                    if t.text(i) != ",":
                        break
                    names.append(t.text(i + 1))
                    i += 2
                i = t.until(i, ";") + 1
            i = max(i, first + 1)

    def walk(i: int, end: int) -> None:
        while i < end:
            kind, word, line = t[i]
            i += 1
            if kind != "id" or t.text(i - 2) == ".":
                continue
            if word == "import":
                stop = t.until(i, ";")
                raw = "".join(t.text(k) for k in range(i + (t.text(i) == "static"), stop))
                if raw:
                    imports.append((raw, line))
                i = stop
            elif word in ("class", "interface", "enum") and i < len(t) and t[i][0] == "id":
                name, body = t.text(i), t.until(i, "{;")
                mods = {t.text(k) for k in range(declared_at(i - 1), i - 1)}
                clause = {t.text(k): k for k in range(body, i, -1) if t.text(k) in ("extends", "implements")}
                # A bound such as <T extends X> is not a clause.
                if "extends" in clause and _inside_angle(t, i, clause["extends"]):
                    later = [k for k in range(clause["extends"] + 1, body) if t.text(k) == "extends" and not _inside_angle(t, i, k)]
                    clause["extends"] = later[0] if later else None
                ext = types_in(clause["extends"] + 1, body) if word == "class" and clause.get("extends") else []
                impl = types_in(clause["implements"] + 1, body) if word != "interface" and clause.get("implements") else []
                symbols.append(_symbol(name, word, t[declared_at(i - 1)][2], "public" in mods, None, ext, impl))
                if "public" in mods:
                    exports.append(name)
                stop = t.after(body)
                if word != "enum":
                    members(body + 1, stop - 1, name, fields=word == "class")
                walk(body + 1, stop - 1)
                i = stop

    walk(0, len(t))
    return _facts(symbols, imports, exports, t.comments)


_JAVA_MODIFIERS = set(
    "public private protected static final abstract default synchronized native transient volatile strictfp sealed".split()
)


def _inside_angle(t: _Tokens, i: int, at: int) -> bool:
    return sum((t.text(k) == "<") - (t.text(k) == ">") for k in range(i, at)) > 0


# --- Python ----------------------------------------------------------------------------------


def python_facts(text: str) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return python_by_indentation(text)
    symbols, imports, exports = [], [], []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append(_defined(node, "function"))
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            symbols.append(_defined(node, "class", extends=bases))
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            symbols.extend(_defined(m, "method", parent=node.name) for m in methods)
        else:
            target = node.targets[0] if isinstance(node, ast.Assign) else getattr(node, "target", None)
            if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(target, ast.Name):
                symbols.append(_symbol(target.id, "variable", node.lineno, not target.id.startswith("_")))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            if not node.decorator_list and not node.name.startswith("_"):
                exports.append(node.name)

    def visit(nodes) -> None:
        for node in nodes:
            if isinstance(node, ast.Import):
                imports.extend((alias.name, node.lineno) for alias in node.names)
            elif isinstance(node, ast.ImportFrom):
                raw = "." * node.level + (node.module or "")
                if raw != "__future__":
                    imports.append((raw, node.lineno))
            elif not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(c for c in ast.iter_child_nodes(node) if isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case)))

    visit(tree.body)
    return _facts(symbols, imports, exports, _python_comments(text))


def python_by_indentation(text: str) -> dict:
    """As :func:`python_facts`, also for texts that do not parse."""
    symbols, imports, comments = indented_facts(text)
    plain = [s.pop("plain", True) for s in symbols]
    exports = [s["name"] for s, p in zip(symbols, plain) if p and s["exported"] and s["kind"] in ("function", "class")]
    return _facts([_symbol(**s) for s in symbols], imports, exports, comments)


def _defined(node, kind: str, parent=None, extends=None) -> dict:
    doc = ast.get_docstring(node, clean=False)
    doc = doc.strip() if doc is not None else None
    return _symbol(node.name, kind, node.lineno, not node.name.startswith("_"), parent, extends, None, doc)


def _python_comments(text: str) -> list[str]:
    found: list[str] = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                found.append(token.string)
    except (tokenize.TokenError, SyntaxError):
        pass
    return found[::-1]


# --- The operator ----------------------------------------------------------------------------

# One entry per language; another language is added here and nowhere else.
EXTRACTORS: dict[str, Callable[[str], dict]] = {
    "javascript": lambda text: script_facts(text, typed=False),
    "typescript": lambda text: script_facts(text, typed=True),
    "python": python_facts,
    "java": java_facts,
}


def facts_or_empty(language: str, text: str) -> dict:
    """Facts of a text; a text that cannot be read yields none instead of failing the job."""
    try:
        return EXTRACTORS[language](text)
    except Exception:  # noqa: BLE001 - one odd file must not lose a partition
        return _facts()


def extract_facts(texts: DataFrame) -> DataFrame:
    """``texts(key, language, text)`` to one row of facts per text, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [facts_or_empty(lang, text or "") for lang, text in zip(batch["language"], batch["text"])]
            out = pd.DataFrame(rows, columns=["exports", "symbols", "comments", "imports"])
            out.insert(0, "key", batch["key"].to_numpy())
            yield out

    ship_package(texts.sparkSession)
    return texts.select("key", "language", "text").mapInPandas(run, FACTS)
