"""Settings of a scan, of the analysis and of the rules, with their defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

SCAN_FILE = "depweave.scan.json"
ANALYSIS_FILE = "depweave.analysis.json"
GOVERNANCE_FILE = "depweave.governance.json"

# Roots of the reachability analysis.
DEFAULT_ENTRY_GLOBS = (
    "**/main.*",
    "**/index.*",
    "**/cli.*",
    "**/app.*",
    "**/server.*",
    "**/__init__.py",
    "**/*.test.*",
    "**/*.spec.*",
    "**/*_test.*",
    "test/**",
    "tests/**",
)


@dataclass(frozen=True)
class ScanConfig:
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Thresholds:
    """Limits of the God-module check; a file is flagged when ``min_signals`` are exceeded."""

    loc: int = 300
    functions: int = 20
    classes: int = 6
    exports: int = 15
    dependents: int = 20
    min_signals: int = 2


@dataclass(frozen=True)
class Layer:
    name: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class LayerRule:
    source: str
    cannot_import: tuple[str, ...]


@dataclass(frozen=True)
class AnalysisConfig:
    entry_points: tuple[str, ...] = DEFAULT_ENTRY_GLOBS
    thresholds: Thresholds = Thresholds()
    layers: tuple[Layer, ...] = ()
    rules: tuple[LayerRule, ...] = ()


@dataclass(frozen=True)
class Limits:
    max_dependency_depth: int = 10
    max_function_count: int = 40
    max_imports: int = 25
    max_fan_in: int = 30
    max_coupling: int = 45
    max_file_size: int = 500
    allow_circular_dependencies: bool = False


@dataclass(frozen=True)
class ForbiddenImport:
    source: str
    target: str
    message: str | None = None


@dataclass(frozen=True)
class GovernanceConfig:
    rules: Limits = Limits()
    forbidden_imports: tuple[ForbiddenImport, ...] = field(default=())
    fail_on: str = "error"


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def read_object(path: Path) -> dict:
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return raw if isinstance(raw, dict) else {}


def _merged(default, raw):
    known = {f.name for f in fields(default)}
    given = {_snake(k): v for k, v in raw.items()} if isinstance(raw, dict) else {}
    return replace(default, **{k: v for k, v in given.items() if k in known})


def load_scan_config(root: str) -> ScanConfig:
    raw = read_object(Path(root) / SCAN_FILE)
    exclude, languages = raw.get("exclude"), raw.get("languages")
    return ScanConfig(
        tuple(map(str, exclude)) if isinstance(exclude, list) else (),
        tuple(languages) if isinstance(languages, list) and languages else None,
    )


def load_analysis_config(root: str) -> AnalysisConfig:
    raw = read_object(Path(root) / ANALYSIS_FILE)
    entry, layers, rules = raw.get("entryPoints"), raw.get("layers"), raw.get("rules")
    return AnalysisConfig(
        tuple(entry) if isinstance(entry, list) else DEFAULT_ENTRY_GLOBS,
        _merged(Thresholds(), raw.get("thresholds")),
        tuple(Layer(x["name"], tuple(x["patterns"])) for x in layers) if isinstance(layers, list) else (),
        tuple(LayerRule(x["from"], tuple(x["cannotImport"])) for x in rules) if isinstance(rules, list) else (),
    )


def load_governance_config(root: str) -> GovernanceConfig:
    raw = read_object(Path(root) / GOVERNANCE_FILE)
    banned = raw.get("forbiddenImports")
    return GovernanceConfig(
        _merged(Limits(), raw.get("rules")),
        tuple(ForbiddenImport(x["from"], x["to"], x.get("message")) for x in banned)
        if isinstance(banned, list)
        else (),
        raw.get("failOn") or "error",
    )
