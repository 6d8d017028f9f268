"""Ignore patterns of a repository as an ordered list of regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are never read.
IGNORED_FOLDERS = (
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", "target", "bin", "obj", ".gradle", ".next", ".nuxt",
    "coverage", "__pycache__", ".venv", "venv", "env", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", ".depweave",
)

# The one hidden folder that is read.
READ_HIDDEN = ".github"


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negated: bool


def compile_rules(lines: list[str]) -> list[IgnoreRule]:
    """Rules of an ignore file; a rule matches a path or any folder above it."""
    rules = []
    for line in lines:
        text = line.rstrip("\r\n")
        text = re.sub(r"(?<!\\) +$", "", text)
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        text = text[1:] if negated else text.removeprefix("\\") if text[:2] in ("\\#", "\\!") else text
        only_folder = text.endswith("/")
        text = text.rstrip("/")
        anchored = "/" in text
        body = _translate(text.removeprefix("/"))
        head = "^" if anchored else "^(?:.*/)?"
        rules.append(IgnoreRule(head + body + ("/.*$" if only_folder else "(?:/.*)?$"), negated))
    return rules


def _translate(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text[i] == "*":
            run = len(text[i:]) - len(text[i:].lstrip("*"))
            whole = (i == 0 or text[i - 1] == "/") and text[i + run : i + run + 1] in ("", "/")
            out, i = out + ("[^/]+" if whole else "[^/]*"), i + run
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            inner = text[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        else:
            char = text[i + 1] if text[i] == "\\" and i + 1 < len(text) else text[i]
            out, i = out + re.escape(char), i + (2 if text[i] == "\\" and i + 1 < len(text) else 1)
    return out


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that matches a path excludes it; an excluded folder stays excluded."""
    verdict = F.lit(False)
    for place, rule in enumerate(rules):
        if rule.negated:
            above = F.lit(False)
            for other in rules[:place]:
                if not other.negated:
                    above = above | F.regexp_replace(path, r"[^/]*$", "").rlike(other.regex)
            verdict = F.when(path.rlike(rule.regex) & ~above, F.lit(False)).otherwise(verdict)
        else:
            verdict = F.when(path.rlike(rule.regex), F.lit(True)).otherwise(verdict)
    return verdict
