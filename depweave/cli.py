"""Command line: ``python -m depweave <command> <root> [...]``."""

from __future__ import annotations

import argparse
import contextlib
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.repository import Repository
from depweave.session import local_session
from depweave.sinks import export, reports

SHOWN = 20


def _show(parts: dict[str, DataFrame] | DataFrame | None, rows: int = SHOWN) -> int:
    if parts is None:
        print("no match")
        return 1
    for name, df in parts.items() if isinstance(parts, dict) else [("", parts)]:
        print(f"\n{name}" if name else "")
        df.show(rows, truncate=False)
    return 0


def _report(repo: Repository, save: bool) -> DataFrame:
    newest = repo.record_health(datetime.now(UTC).isoformat(), save).orderBy(F.desc("timestamp")).limit(1)
    return reports.report_rows(repo.analysis, newest)


def scan(repo: Repository, args) -> int:
    export.save_code_graph(repo.code_nodes, repo.code_edges, str(repo.output / "graph"))
    export.save_store(repo.analysis.files, repo.analysis.edges, str(repo.output / "store"))
    export.save_result(repo.analysis.summary, str(repo.output / "summary"))
    repo.record_health(datetime.now(UTC).isoformat())
    return _show(repo.repository_summary(), 10)


def summarize(repo: Repository, args) -> int:
    return _show(repo.repository_summary(), 10)


def export_graph(repo: Repository, args) -> int:
    export.write_export(repo.records, repo.root, args.out or str(repo.output / "export"))
    return 0


def insights(repo: Repository, args) -> int:
    return _show({
        "hotspots": repo.remembered("hotspots", repo.hotspots), "cycles": repo.remembered("cycles", repo.cycles),
        "god modules": repo.god_modules(), "unused": repo.find_unused(), "layer violations": repo.layer_violations(),
    })


def impact(repo: Repository, args) -> int:
    parts = repo.impact(args.target)
    for name, df in (parts or {}).items():
        export.save_result(df, str(repo.output / "impact" / name))
    return _show(parts)


def history(repo: Repository, args) -> int:
    return _show(repo.history_report(with_coupling=True), 12)


def diff(repo: Repository, args) -> int:
    return _show(repo.compare(args.base, args.head))


def replay(repo: Repository, args) -> int:
    return _show(repo.replay(args.steps))


def governance(repo: Repository, args) -> int:
    for line in reports.text_lines(reports.ordered(_report(repo, save=True))):
        print(line)
    gate = repo.analysis.gate().first()
    return 0 if gate is None or gate["passes"] else 1


def analyze_branch(repo: Repository, args) -> int:
    parts = repo.analyze_branch(args.base)
    _show(parts)
    return 0 if parts["report"].first()["passes"] else 1


def report(repo: Repository, args) -> int:
    rows = reports.ordered(_report(repo, save=False))
    lines = {
        "html": lambda: reports.html_lines(rows, f"Architecture of {repo.root}"), "json": lambda: reports.json_lines(rows),
    }.get(args.format, lambda: reports.text_lines(rows))()
    with Path(args.out).open("w", encoding="utf-8") if args.out else contextlib.nullcontext(sys.stdout) as out:
        out.writelines(f"{line}\n" for line in lines)
    return 0


COMMANDS = {
    "scan": scan, "summary": summarize, "export": export_graph, "insights": insights, "impact": impact,
    "history": history, "diff": diff, "replay": replay, "governance": governance, "analyze-pr": analyze_branch,
    "report": report,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="depweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        one = commands.add_parser(name)
        one.add_argument("root", nargs="?", default=".")
        one.add_argument("--cpus", default="8")
        if name == "impact":
            one.add_argument("target")
        if name == "diff":
            one.add_argument("base")
            one.add_argument("head")
        if name == "replay":
            one.add_argument("--steps", type=int, default=16)
        if name == "analyze-pr":
            one.add_argument("--base")
        if name in ("export", "report"):
            one.add_argument("--out")
        if name == "report":
            one.add_argument("--format", choices=("md", "html", "json"), default="md")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session(args.cpus)
    spark.sparkContext.setLogLevel("ERROR")
    repo = Repository(spark, args.root, cache=str(Path(args.root).resolve() / ".depweave" / "facts"))
    return COMMANDS[args.command](repo, args)


if __name__ == "__main__":
    sys.exit(main())
