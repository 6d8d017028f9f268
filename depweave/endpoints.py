"""Answers by request path, for a service that wants to put them behind a socket of its own."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from depweave.operators import codegraph, summary
from depweave.repository import Repository

Params = Mapping[str, str]
Answer = dict[str, DataFrame] | DataFrame | None


def whole(params: Params, name: str, default: int | None) -> int | None:
    """A whole number of the request; anything else is the default."""
    try:
        return int(float(params[name]))
    except (KeyError, ValueError, OverflowError):
        return default


def _graph(parts: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    return {"nodes": parts[0], "edges": parts[1]}


def _governance(repo: Repository, params: Params) -> Answer:
    return {"health": repo.analysis.health, "violations": repo.analysis.violations, "gate": repo.analysis.gate()}


def _insights(repo: Repository, params: Params) -> Answer:
    return {
        "summary": repo.analysis.summary, "hotspots": repo.hotspots(), "cycles": repo.cycles(),
        "god_modules": repo.god_modules(), "unused": repo.find_unused(), "layer_violations": repo.layer_violations(),
    }


ENDPOINTS: dict[str, Callable[[Repository, Params], Answer]] = {
    "/graph.json": lambda r, p: _graph(r.map_graph()),
    "/api/insights": _insights,
    "/api/governance": _governance,
    "/api/metrics": lambda r, p: r.search_file(p.get("id", ""))["metrics"],
    "/api/impact": lambda r, p: r.impact(p.get("id", "")),
    "/api/packages": lambda r, p: r.packages(),
    "/api/history": lambda r, p: r.history_report(),
    "/api/timeline": lambda r, p: r.timeline(30),
    "/api/snapshot": lambda r, p: _graph(r.snapshot_map(p.get("rev", "HEAD"))),
    "/api/diff": lambda r, p: r.compare(p.get("a", ""), p.get("b", "")),
    "/api/stats": lambda r, p: summary.graph_stats(r.analysis.degrees).drop("rev"),
    "/api/summary": lambda r, p: r.repository_summary(),
    "/api/search": lambda r, p: r.search_path(p.get("q", ""), whole(p, "limit", 50)),
    "/api/file": lambda r, p: r.search_file(p.get("id", "")),
    "/api/neighbors": lambda r, p: _graph(r.neighbors(p.get("id", ""), p.get("dir", "both"), whole(p, "depth", 1))),
    "/api/subgraph": lambda r, p: _graph(
        r.subgraph(p.get("folder"), whole(p, "minDegree", None), whole(p, "limit", None))
    ),
    "/api/symbols": lambda r, p: dict(zip(("symbols", "contains"), codegraph.derived_symbols(r.file_nodes))),
}


def answer(repo: Repository, path: str, params: Params | None = None) -> Answer:
    """DataFrames for a request; nothing for an unknown path, file or revision."""
    handler = ENDPOINTS.get(path)
    return handler(repo, params or {}) if handler else None
