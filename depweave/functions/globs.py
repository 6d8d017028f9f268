"""Glob patterns as anchored regular expressions, and predicates over paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECES = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_SPECIAL = set(".+^${}()|[]\\")


def glob_regex(glob: str) -> str:
    """``**/`` is any number of directories, ``**`` anything, ``*`` and ``?`` stay in a segment."""
    out, at = [], 0
    while at < len(glob):
        for piece, regex in _PIECES.items():
            if glob.startswith(piece, at):
                out.append(regex)
                at += len(piece)
                break
        else:
            char = glob[at]
            out.append("\\" + char if char in _SPECIAL else char)
            at += 1
    return "^" + "".join(out) + "$"


def any_glob_regex(globs: Iterable[str]) -> str | None:
    parts = [glob_regex(g) for g in globs]
    return "|".join(f"(?:{p})" for p in parts) if parts else None


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    regex = any_glob_regex(globs)
    return F.lit(False) if regex is None else path.rlike(regex)
