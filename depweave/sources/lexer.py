"""Tokens of JavaScript and TypeScript texts: a lexer with a stack of modes.

*Code* has tokens and brackets. A template is in *template* mode between its back ticks, and each ``${`` in
it opens code again, which may hold further templates. ``<Name`` where a value is expected opens a
*tag*, its children are *tag text*, and a brace in either opens code. So nothing inside a template, a
pattern or tag text is ever taken for code.

Whether ``/`` divides or opens a pattern, and ``<`` compares or opens a tag, depends on whether a value is
expected. After a closing bracket that is decided by what stood before the opening one.

A template, tag or comment that never ends, and brackets that never close, would swallow the rest of
the text. Reading then starts again, outside all of them, at the next line that begins with a declaration.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/|\A#![^\n]*)"
    r"|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<id>[#@]?[A-Za-z_$\u0080-￿][\w$]*)"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<p>=>|\.\.\.|\?\.(?!\d)|[^\s])",
    re.S,
)
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE_STOP = re.compile(r"\\.|\$\{|`", re.S)
_TAG_NAME = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
_TAG_END = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>")
_IN_TAG = re.compile(r"/\s*>|>|\{|\"[^\"]*\"|'[^']*'|/\*.*?\*/|//[^\n]*|[\w$:.-]+|[^\s]", re.S)
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=[^>]|extends\b)")
_RESTART = re.compile(
    r"^(?:export|import|function|class|interface|enum|const|let|var|abstract|declare|type|namespace|async\s+function)\b", re.M
)

# Words and signs after which a value follows.
VALUE_WORDS = set("return typeof new void case in of await throw delete else do yield instanceof default extends".split())
VALUE_SIGNS = set("= ( , ? : => { [ ! & | + - * % < > ~ ^ ; ... /".split())
_BLOCK_WORDS = {"if", "while", "for", "with"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Lexer:
    """``tokens`` (kind, text, line) with their ``spans`` in the text, and ``comments`` in order.

    Kinds: id, str, num, re (a pattern), jsx (a piece of a tag) and p (a sign). The code inside a template or
    tag stands between round brackets, so it is one group to a reader of the tokens.
    """

    def __init__(self, text: str, typed: bool):
        self.source, self.typed = text, typed
        self.tokens: list[tuple[str, str, int]] = []
        self.spans: list[tuple[int, int]] = []
        self.comments: list[str] = []
        self.at, self.line, self.counted = 0, 1, 0
        self.value = True  # whether a value may begin here
        self.brackets: list[tuple[str, bool]] = []  # open ones, and whether a value follows the closing one
        self.modes: list[list] = []  # [kind, start, tokens before, brackets before, comments before]
        while self.at < len(text):
            {"template": self._template, "tag": self._tag, "text": self._text}.get(self._mode(), self._code)()
            if self.at >= len(text) and any(m[0] != "code" for m in self.modes):
                self._restart()

    def _mode(self) -> str:
        return self.modes[-1][0] if self.modes else "code"

    def _open(self, kind: str, start: int) -> None:
        self.modes.append([kind, start, len(self.tokens), len(self.brackets), len(self.comments)])

    def _add(self, kind: str, start: int, end: int, text: str | None = None) -> None:
        self.line += self.source.count("\n", self.counted, start) if start >= self.counted else 0
        self.counted = max(self.counted, start)
        self.tokens.append((kind, self.source[start:end] if text is None else text, self.line))
        self.spans.append((start, end))

    def _restart(self) -> None:
        """Leave the outermost template or tag that never ends, for the next declaration behind it."""
        _, start, tokens, _, comments = next(m for m in self.modes if m[0] != "code")
        del self.tokens[tokens:], self.spans[tokens:], self.comments[comments:]
        self.counted, self.line = start, self.source.count("\n", 0, start) + 1
        again = _RESTART.search(self.source, start + 1)
        self._add("str", start, start + 1, "''")  # stands for what was open
        self.modes, self.brackets, self.value = [], [], True
        self.at = again.start() if again else len(self.source)

    # -- modes

    def _code(self) -> None:
        m = _TOKEN.search(self.source, self.at)
        if m is None:
            self.at = len(self.source)
            return
        kind, piece, start, end = m.lastgroup, m.group(), m.start(), m.end()
        if kind == "comment":
            self.comments.append(piece)
            self.at = end
            return
        if kind == "p":
            if piece == "`":
                self._open("template", start)
                self.at = self._piece_from = end
                return
            if piece == "/":
                if self.source.startswith("/*", start):  # a comment without an end
                    again = _RESTART.search(self.source, start + 1)
                    self.at = again.start() if again else len(self.source)
                    return
                r = _PATTERN.match(self.source, start) if self.value else None
                if r is not None:
                    kind, end = "re", r.end()
            elif piece == "<" and self.value and self._is_tag(start):
                name = _TAG_NAME.match(self.source, start)
                self._open("tag", start)
                self._add("jsx", start, name.end())
                self.at = name.end()
                return
            elif piece == "}" and self.modes and len(self.brackets) == self.modes[-1][3]:
                self._add("p", start, end, ")")
                self.modes.pop()
                self.at = self._piece_from = end
                return
        before = self.tokens[-1] if self.tokens else ("p", ";", 0)
        touching = bool(self.spans) and self.spans[-1][1] == start
        self._add(kind, start, end)
        self.at = end
        self._expect(kind, piece, before, touching)

    def _expect(self, kind: str, piece: str, before: tuple, touching: bool) -> None:
        if kind == "id":
            self.value = piece in VALUE_WORDS and before[1] not in (".", "?.")
        elif kind != "p":
            self.value = False
        elif piece in _OPEN:
            control = piece == "(" and (before[1] in _BLOCK_WORDS or before[1] == "await" and len(self.tokens) > 2 and self.tokens[-3][1] == "for")
            # A brace where a value is expected holds an object, unless it follows a sign that ends a statement.
            block = piece == "{" and (not self.value or before[1] in (";", "{", "=>", "else", "do", ")"))
            self.brackets.append((_OPEN[piece], control or block))
            self.value = True
        elif piece in _CLOSE:
            after = False
            if self.brackets and len(self.brackets) > (self.modes[-1][3] if self.modes else 0):
                after = self.brackets.pop()[1]
            self.value = after
        elif piece in "+-" and touching and before[1] == piece and not self._value_before_pair:
            self.value = False  # a++ and a--
        elif piece == "!" and touching and not self.value and not self.source.startswith("=", self.at):
            self.value = False  # x! says that x is there
        else:
            self._value_before_pair = self.value
            self.value = piece in VALUE_SIGNS

    _value_before_pair = True
    _piece_from = 0

    def _is_tag(self, start: int) -> bool:
        source = self.source
        name = _TAG_NAME.match(source, start)
        behind = source[name.end() : name.end() + 1]
        if name.group(1) is None:
            return behind == ">"
        if _GENERIC.match(source, start):
            return False
        if behind == ">" and self.typed:  # <T>(x) => x and <T>value have no end tag
            return re.search(rf"</\s*{re.escape(name.group(1))}\s*>", source[name.end() :]) is not None
        return behind in ("", ">", "/") or behind.isspace()

    def _template(self) -> None:
        m = _TEMPLATE_STOP.search(self.source, self.at)
        if m is None:
            self.at = len(self.source)
        elif m.group() == "`":
            start = self.modes.pop()[1]
            first = self._piece_from <= start + 1
            self._add("str", start if first else self._piece_from, m.end(), None if first else "`" + self.source[self._piece_from : m.end()])
            self.at, self.value = m.end(), False
        elif m.group() == "${":
            start = self.modes[-1][1]
            self._add("str", max(start, self._piece_from - 1), m.start(), "`" + self.source[self._piece_from : m.start()])
            self._enter(m.end())
        else:
            self.at = m.end()

    def _enter(self, at: int) -> None:
        """Code inside a template, a tag or tag text."""
        self._add("p", at - 1, at, "(")
        self._open("code", at)
        self.at, self.value = at, True

    def _tag(self) -> None:
        m = _IN_TAG.search(self.source, self.at)
        if m is None:
            self.at = len(self.source)
            return
        piece, self.at = m.group(), m.end()
        if piece == "{":
            self._enter(m.end())
        elif piece == ">":
            self.modes[-1][0] = "text"
        elif piece.startswith(("/*", "//")):
            self.comments.append(piece)
        elif piece[0] == "/":
            self._end_tag(m.start(), m.end())
        elif piece == "<":  # type arguments of a tag
            depth = 1
            while depth and (n := re.compile("[<>]").search(self.source, self.at)) is not None:
                depth += 1 if n.group() == "<" else -1
                self.at = n.end()

    def _text(self) -> None:
        m = re.compile("[<{]").search(self.source, self.at)
        if m is None:
            self.at = len(self.source)
        elif m.group() == "{":
            self._enter(m.end())
        elif (end := _TAG_END.match(self.source, m.start())) is not None:
            self._end_tag(end.start(), end.end())
        else:
            name = _TAG_NAME.match(self.source, m.start())
            self._open("tag", m.start())
            self._add("jsx", m.start(), name.end())
            self.at = name.end()

    def _end_tag(self, start: int, end: int) -> None:
        self._add("jsx", start, end)
        self.modes.pop()
        self.at, self.value = end, False


def closers(tokens: list[tuple[str, str, int]], spans: list[tuple[int, int]], source: str) -> list[int]:
    """For each token that opens a bracket, the index behind its group; for others the next index.

    If brackets do not pair up, a line that begins with a declaration closes all that are open.
    """

    def paired(restart: bool) -> tuple[list[int], bool]:
        out = list(range(1, len(tokens) + 1))
        stack: list[int] = []
        fine = True
        for i, (kind, piece, _) in enumerate(tokens):
            if restart and stack and kind == "id" and (start := spans[i][0]) and source[start - 1] == "\n" and _RESTART.match(source[start : start + 40]):
                for j in stack:
                    out[j] = i
                stack.clear()
            if kind != "p":
                continue
            if piece in _OPEN:
                stack.append(i)
            elif piece in _CLOSE:
                if stack and _OPEN[tokens[stack[-1]][1]] == piece:
                    out[stack.pop()] = i + 1
                else:
                    fine = False
                    while stack and _OPEN[tokens[stack[-1]][1]] != piece:
                        out[stack.pop()] = i
                    if stack:
                        out[stack.pop()] = i + 1
        for j in stack:
            out[j] = len(tokens)
        return out, fine and not stack

    out, fine = paired(False)
    return out if fine else paired(True)[0]
