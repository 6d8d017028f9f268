"""Facts of Python texts that do not parse, by their indentation.

Logical lines are cut from the text (strings, comments, brackets and back slashes considered) and read
with a stack of open blocks. What a line declares depends only on its first words and on the blocks
around it, so an error in one line costs no other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PIECE = re.compile(
    r"(?P<comment>\#[^\n]*)"
    r"|(?P<long>[A-Za-z]{0,2}(?:\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}))"
    r"|(?P<str>[A-Za-z]{0,2}(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<join>\\[ \t]*\n)"
    r"|(?P<end>\n)"
    r"|(?P<gap>[ \t\f\r]+)"
    r"|(?P<sign>.)",
    re.S,
)
# Lines that begin like this never stand inside brackets: an opening one before them was left open.
_STATEMENT = re.compile(r"[ \t]*(?:def|class|import|try|return|raise|while|with|async[ \t]+def|from[ \t]+[\w.]+[ \t]+import|@\w)\b|[ \t]*@\w")
_BLOCK_WORDS = set("if elif else for while try except finally with match case async".split())


@dataclass
class Line:
    """A logical line: its indentation, number, and pieces (kind, text) without gaps and comments."""

    indent: int
    number: int
    pieces: list[tuple[str, str]]

    def word(self, i: int) -> str:
        return self.pieces[i][1] if i < len(self.pieces) else ""


def logical_lines(text: str) -> tuple[list[Line], list[str]]:
    """Logical lines and comments of a text, in order."""
    lines: list[Line] = []
    comments: list[str] = []
    pieces: list[tuple[str, str]] = []
    depth, number, at = 0, 1, 0
    first, indent, fresh = 1, 0, True

    def close() -> None:
        nonlocal pieces, depth
        if pieces:
            lines.append(Line(indent, first, pieces))
        pieces, depth = [], 0

    while at < len(text):
        if fresh and depth and _STATEMENT.match(text, at):
            close()
        m = _PIECE.match(text, at)
        kind, piece, at = m.lastgroup, m.group(), m.end()
        if fresh and not pieces:
            first, indent = number, len(piece.expandtabs(8)) if kind == "gap" else 0
        fresh = False
        number += piece.count("\n")
        if kind == "comment":
            comments.append(piece)
        elif kind == "end":
            fresh = True
            if not depth:
                close()
        elif kind not in ("gap", "join"):
            pieces.append((kind, piece))
            if kind == "sign":
                depth = max(0, depth + (piece in "([{") - (piece in ")]}"))
    close()
    return lines, comments


def _string_value(piece: str) -> str:
    body = piece.lstrip("rRuUbBfF")
    quote = 3 if body[:3] in ('"""', "'''") else 1
    return body[quote:-quote]


def _doc(pieces: list[tuple[str, str]]) -> str | None:
    """The text of a statement that is strings only."""
    strings = next(iter(_split(pieces, ";")))
    plain = all(kind in ("long", "str") and not set(re.match("[a-z]*", p.lower())[0]) & set("bf") for kind, p in strings)
    return "".join(_string_value(p) for _, p in strings).strip() if strings and plain else None


def _split(pieces: list[tuple[str, str]], mark: str) -> list[list[tuple[str, str]]]:
    """Pieces between marks outside brackets."""
    out: list[list[tuple[str, str]]] = [[]]
    depth = 0
    for kind, piece in pieces:
        depth += (piece in ("(", "[", "{")) - (piece in (")", "]", "}"))
        if piece == mark and depth <= 0:
            out.append([])
        else:
            out[-1].append((kind, piece))
    return out


def _dotted(pieces: list[tuple[str, str]]) -> str:
    """The dotted name that the pieces are, or nothing."""
    name = "".join(p for _, p in pieces)
    return name if re.fullmatch(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*", name) else ""


def _bases(pieces: list[tuple[str, str]]) -> list[str]:
    """Names between the brackets behind a class name."""
    if not pieces or pieces[0][1] != "(":
        return []
    depth, stop = 0, len(pieces)
    for k, (_, piece) in enumerate(pieces):
        depth += (piece in ("(", "[", "{")) - (piece in (")", "]", "}"))
        if not depth:
            stop = k
            break
    return [name for part in _split(pieces[1:stop], ",") if (name := _dotted(part))]


def _imported(pieces: list[tuple[str, str]]) -> list[str]:
    """Modules that a simple statement imports."""
    words = [p for _, p in pieces]
    if words[:1] == ["import"]:
        heads = (part[: next((k for k, (_, p) in enumerate(part) if p == "as"), len(part))] for part in _split(pieces[1:], ","))
        return [name for head in heads if (name := _dotted(head))]
    if words[:1] == ["from"]:
        stop = words.index("import") if "import" in words else len(words)
        raw = "".join(words[1:stop])
        return [raw] if re.fullmatch(r"\.*[\w.]*", raw) and raw and raw != "__future__" and (stop < len(words)) else []
    return []


def indented_facts(text: str) -> tuple[list[dict], list[tuple[str, int]], list[str]]:
    """Symbols, imports with their lines, and comments (last first).

    A symbol holds ``plain`` = False if it is decorated, which keeps it from being an export.
    """
    lines, comments = logical_lines(text)
    symbols: list[dict] = []
    imports: list[tuple[str, int]] = []
    blocks: list[tuple[int, str, str]] = []  # indentation, kind (def, class, other), name
    decorated = False
    waiting: tuple[int, dict] | None = None  # a definition whose next line may be its text

    def simple(pieces: list[tuple[str, str]], number: int, top: bool) -> None:
        for part in _split(pieces, ";"):
            if not part:
                continue
            if not any(kind != "other" for _, kind, _ in blocks):
                imports.extend((raw, number) for raw in _imported(part))
            if top and not blocks and part[0][0] == "word" and len(part) > 1 and part[1][1] in ("=", ":"):
                if part[1][1] == ":" or len(part) < 3 or part[2][1] != "=":
                    name = part[0][1]
                    if name not in _BLOCK_WORDS and name != "lambda":
                        symbols.append(dict(name=name, kind="variable", line=number, exported=not name.startswith("_")))

    for line in lines:
        while blocks and blocks[-1][0] >= line.indent:
            blocks.pop()
        if waiting is not None:
            if line.indent > waiting[0]:
                waiting[1]["doc"] = _doc(line.pieces)
            waiting = None
        head = line.word(0)
        if head == "@":
            decorated = True
            continue
        at = 1 if head == "async" and line.word(1) == "def" else 0
        kind = line.word(at) if line.pieces[at][0] == "word" else ""
        body = next((k for k in _colons(line.pieces)), None)
        if kind in ("def", "class") and at + 1 < len(line.pieces) and line.pieces[at + 1][0] == "word":
            name = line.word(at + 1)
            around = [b[1] for b in blocks]
            if not around or around == ["class"] and kind == "def":
                found = dict(name=name, kind="class" if kind == "class" else "function", line=line.number, exported=not name.startswith("_"))
                if around:
                    found |= dict(kind="method", parent=blocks[0][2])
                elif kind == "class":
                    found["extends"] = _bases(line.pieces[at + 2 :])
                if decorated and not around:
                    found["plain"] = False
                symbols.append(found)
                waiting = (line.indent, found)
            blocks.append((line.indent, "def" if kind == "def" else "class", name))
            if body is not None and body + 1 < len(line.pieces):
                if waiting is not None:
                    waiting[1]["doc"] = _doc(line.pieces[body + 1 :])
                    waiting = None
        elif kind in _BLOCK_WORDS and body is not None and (kind not in ("match", "case") or body + 1 == len(line.pieces)):
            blocks.append((line.indent, "other", ""))
            simple(line.pieces[body + 1 :], line.number, False)
        else:
            simple(line.pieces, line.number, True)
        decorated = False
    return symbols, imports, comments[::-1]


def _colons(pieces: list[tuple[str, str]]):
    """Places of colons outside brackets that end the head of a block."""
    depth = held = 0
    for k, (_, piece) in enumerate(pieces):
        depth += (piece in ("(", "[", "{")) - (piece in (")", "]", "}"))
        held += piece == "lambda" and depth <= 0
        if piece == ":" and depth <= 0:
            if held:
                held -= 1
            elif not (k + 1 < len(pieces) and pieces[k + 1][1] == "="):
                yield k
