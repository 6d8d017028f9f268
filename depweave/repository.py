"""A repository on disk, its revisions, and every question the tools and commands ask of it."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.config import load_analysis_config, load_governance_config
from depweave.model import DepGraph
from depweave.operators import codegraph, compare, context, health, history, impact, packages
from depweave.operators import reach, store, summary
from depweave.functions import classify
from depweave.operators.analysis import Analysis
from depweave.operators.fingerprint import graph_fingerprint, stored_result
from depweave.schema import HEALTH_SNAPSHOT
from depweave.session import cut, keep
from depweave.sources import git, tree
from depweave.sources.workspaces import package_folders

OUTPUT = ".depweave"


class Repository:
    """Lazily scanned and analysed; :meth:`rescan` forgets everything that was computed.

    Results are DataFrames. A file is named by id, path or path suffix.
    """

    def __init__(self, spark: SparkSession, root: str, cache: str | None = None):
        self.spark = spark
        self.root = str(Path(root).resolve())
        self.cache = cache

    @property
    def output(self) -> Path:
        return Path(self.root, OUTPUT)

    def rescan(self) -> Repository:
        for name in [n for n in self.__dict__ if n not in ("spark", "root", "cache")]:
            del self.__dict__[name]
        return self

    # --- graphs ------------------------------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        return keep(tree.scan(self.spark, self.root, cache=self.cache))

    @cached_property
    def analysis(self) -> Analysis:
        return self._analysed(self.records)

    def _analysed(self, records: DataFrame) -> Analysis:
        graph = codegraph.dependency_graph(records)
        return Analysis(graph, load_analysis_config(self.root), load_governance_config(self.root))

    @cached_property
    def file_nodes(self) -> DataFrame:
        return codegraph.file_nodes(self.records)

    @cached_property
    def code_nodes(self) -> DataFrame:
        return keep(codegraph.code_nodes(self.records, self.root))

    @cached_property
    def code_edges(self) -> DataFrame:
        return keep(codegraph.code_edges(self.records, self.root))

    @cached_property
    def symbols(self) -> DataFrame:
        return codegraph.symbol_rows(self.records)

    @cached_property
    def fingerprint(self) -> str:
        """Changes with the graph and with the settings of the analysis."""
        a = self.analysis
        return graph_fingerprint(a.files, a.edges, (a.config, a.governance))

    def remembered(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A result of the analysis, read from disk when the same graph was analysed before."""
        return stored_result(self.spark, str(self.output / "analysis" / self.fingerprint / name), build)

    def resolve(self, target: str) -> DataFrame:
        """At most one row ``(id, path)``."""
        named = self.analysis.files.withColumn("key", F.col("id")).withColumn("id", F.col("id.node"))
        best = store.resolve_target(named, target).withColumnRenamed("id", "node")
        ids = self.analysis.files.select("id", "path")
        return cut(ids.join(F.broadcast(best.select("path")), "path", "left_semi"))

    # --- repository and search ---------------------------------------------------------------

    def repository_summary(self) -> dict[str, DataFrame]:
        a = self.analysis
        return {
            "stats": summary.graph_stats(a.degrees).drop("rev"),
            "languages": summary.language_histogram(a.files).drop("rev"),
            "architecture": a.summary.drop("rev"),
            "dependency_stats": summary.degree_stats(a.degrees).drop("rev"),
            "entry_points": self.find_entry_points().orderBy("path").limit(20),
            "hubs": summary.hubs(a.degrees).drop("rev"),
            "connectors": summary.connectors(a.degrees).drop("rev"),
            "folders": summary.folder_counts(a.files).drop("rev").orderBy(F.desc("files"), "folder"),
            "externals": summary.external_packages(self._external_imports()),
        }

    def _external_imports(self) -> DataFrame:
        return self.records.select(F.explode("imports").alias("i")).where("i.external").select("i.raw")

    def search_symbol(self, name: str) -> dict[str, DataFrame]:
        hits = cut(context.search_symbols(self.symbols, name))
        return {"hits": hits, "references": context.symbol_references(hits, self.analysis.files, self.analysis.edges)}

    def search_file(self, path: str) -> dict[str, DataFrame]:
        found = self.resolve(path)
        a, ids = self.analysis, found.select("id")
        ahead = reach.reach_pairs(a.edges, ids, a.walks)
        behind = reach.reach_pairs(a.edges, ids, a.walks, direction="in")
        metrics = a.degrees.join(ids, "id", "left_semi").select("path", "in_degree", "out_degree")
        metrics = (
            metrics.withColumn("transitive_imports", ahead.agg(F.count(F.lit(1))).scalar())
            .withColumn("depth", ahead.agg(F.coalesce(F.max("hop"), F.lit(0))).scalar())
            .withColumn("transitive_dependents", behind.agg(F.count(F.lit(1))).scalar())
        )
        scored = a.scores.join(ids, "id", "left_semi").select("path", "centrality", F.col("score").alias("hotspot_score"))
        return {
            "file": self.file_nodes.join(found.select("path"), "path", "left_semi").drop("rev"),
            "metrics": metrics.join(scored, "path"),
        }

    def search_imports(self, path: str) -> DataFrame:
        return store.search_imports(self.analysis.files, self.analysis.edges, self.resolve(path)).drop("id")

    def search_path(self, text: str, limit: int = 50) -> DataFrame:
        return store.search_path(self.analysis.files, text, limit).select("path", "lang", "loc")

    def neighbors(self, path: str, direction: str = "both", depth: int = 1) -> tuple[DataFrame, DataFrame]:
        return store.neighbors(self.analysis.files, self.analysis.edges, self.resolve(path), direction, depth)

    def subgraph(self, folder=None, min_degree=None, limit=None) -> tuple[DataFrame, DataFrame]:
        return store.subgraph(self.analysis.degrees, self.analysis.edges, folder, min_degree, limit)

    def map_graph(self) -> tuple[DataFrame, DataFrame]:
        return codegraph.map_graph(self.code_nodes, self.code_edges)

    # --- architecture and impact -------------------------------------------------------------

    def hotspots(self) -> DataFrame:
        return self.analysis.hotspots.drop("rev", "id").orderBy(F.desc("score"), "path")

    def cycles(self) -> DataFrame:
        return self.analysis.cycles.drop("rev", "comp").orderBy(F.desc("length"), "first_file")

    def god_modules(self) -> DataFrame:
        return self.analysis.god_modules.drop("rev", "id").orderBy(F.desc(F.size("reasons")), "path")

    def layer_violations(self) -> DataFrame:
        return self.analysis.layer_violations.drop("rev")

    def impact(self, target: str) -> dict[str, DataFrame] | None:
        """The blast radius of one file, or nothing when no file matches."""
        found = self.resolve(target).select("id")
        if found.isEmpty():
            return None
        a = self.analysis
        affected = cut(impact.affected_files(a.edges, found, a.walks))
        on_cycle = a.cycle_members.join(found, "id", "left_semi").select("comp")
        return {
            "report": impact.blast_radius(a, impact.counts_of_targets(a.files, a.edges, affected), found).drop("rev", "target"),
            "affected": impact.affected_with_reason(a.files, a.edges, affected)
            .select("path", "hop", "reason")
            .orderBy("hop", "path"),
            "tests": impact.affected_tests(a.files, affected, found).drop("target").orderBy("path"),
            "entry_points": impact.affected_entry_points(a.files, affected).drop("target").orderBy("path"),
            "directories": impact.affected_directories(a.files, affected).drop("target").orderBy("dir"),
            "cycles": a.cycle_members.join(on_cycle, "comp", "left_semi").select("path"),
        }

    def dependency_path(self, source: str, target: str) -> DataFrame:
        a = self.analysis
        start, goal = self.resolve(source).select("id"), self.resolve(target).select("id")
        steps = reach.shortest_path(a.edges, start, goal)
        return steps.join(a.files.select("id", "path"), "id").select("hop", "path").orderBy("hop")

    def packages(self) -> DataFrame:
        placed = packages.package_of(self.analysis.files, package_folders(self.analysis.files, self.root))
        return packages.package_rollup(placed, self.analysis.edges).drop("rev").orderBy(F.desc("files"), "package")

    # --- navigation --------------------------------------------------------------------------

    def find_entry_points(self) -> DataFrame:
        kind = classify.entry_kind(F.col("path")).alias("kind")
        return self.analysis.files.select("path", kind, "lang", "n_exports").where("kind is not null")

    def _located(self, predicate, kind: str) -> DataFrame:
        files = self.analysis.files.where(predicate(F.col("path")))
        return files.select("path", F.lit(kind).alias("kind"), "lang", "n_exports")

    def find_api_routes(self) -> DataFrame:
        return self._located(classify.is_api_route, "api-route")

    def find_database_models(self) -> DataFrame:
        return self._located(classify.is_model, "model")

    def find_configuration(self) -> DataFrame:
        return self._located(classify.is_config, "config")

    def find_tests(self) -> DataFrame:
        return self._located(classify.is_test, "test")

    def find_unused(self) -> DataFrame:
        return self.analysis.unused.select("path", "reasons").orderBy("path")

    def find_dead_code(self) -> DataFrame:
        return summary.orphans(self.analysis.degrees).drop("rev")

    def build_context(self, query: str, max_files: int = context.CONTEXT_FILES) -> dict[str, DataFrame]:
        churned = steady = None
        if git.is_repository(self.root):
            churned, steady = history.churn(self.file_stats), history.stability(self.file_stats)
        return context.build_context(self.analysis, self.symbols, query, max_files, churned, steady)

    # --- governance --------------------------------------------------------------------------

    @property
    def health_folder(self) -> str:
        return str(self.output / "health-series")

    def health_history(self) -> DataFrame:
        """The series as of the last write that was finished."""
        reader = self.spark.read.schema(HEALTH_SNAPSHOT)
        current = Path(self.health_folder, "current")
        if not current.exists():
            return self.spark.createDataFrame([], HEALTH_SNAPSHOT)
        return reader.json(str(current.parent / current.read_text(encoding="utf-8")))

    def _keep_series(self, series: DataFrame) -> None:
        """Write a new generation, then point to it in one step; the one before stays for its readers."""
        folder = Path(self.health_folder)
        current = folder / "current"
        before = current.read_text(encoding="utf-8") if current.exists() else ""
        name = f"generation-{uuid.uuid4().hex}"
        series.coalesce(1).write.json(str(folder / name))
        pointer = folder / f"next-{name}"
        pointer.write_text(name, encoding="utf-8")
        pointer.replace(current)
        for old in folder.glob("generation-*"):
            if old.name not in (name, before):
                shutil.rmtree(old, ignore_errors=True)

    def record_health(self, timestamp: str, save: bool = True) -> DataFrame:
        """The trend up to now, as of this scan, and, with ``save``, the series with it."""
        now = self.analysis.health.withColumn("timestamp", F.lit(timestamp))
        now = now.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HEALTH_SNAPSHOT.fields])
        series = cut(health.retained(self.health_history().unionByName(now)))
        if save:
            self._keep_series(series)
        return health.trend(series)

    # --- history and revisions ---------------------------------------------------------------

    @cached_property
    def changes(self) -> DataFrame:
        self.output.mkdir(exist_ok=True)
        log = str(self.output / "changes.log")
        git.export_log(self.root, log)
        return keep(git.changes(self.spark, "file:" + log))

    @cached_property
    def file_stats(self) -> DataFrame:
        return keep(history.file_history(self.changes, "date_iso"))

    def commits(self, limit: int | None = None) -> DataFrame:
        return git.commits(self.spark, self.root, limit)

    def file_history(self, target: str) -> dict[str, DataFrame]:
        found = self.resolve(target).select("path")
        row = found.first()
        path = row["path"] if row else target
        return {
            "commits": git.file_commits(self.spark, self.root, path),
            "churn": history.churn(self.file_stats).where(F.col("path") == path),
            "stability": history.stability(self.file_stats).where(F.col("path") == path),
        }

    def history_report(self, with_coupling: bool = False) -> dict[str, DataFrame]:
        out = {
            "commits": self.commits(),
            "churn": history.churn(self.file_stats).orderBy(F.desc("churn"), "path"),
            "stability": history.stability(self.file_stats).orderBy("stability", "path"),
            "evolution": history.evolution_insights(self.file_stats),
        }
        ends = self.commits().agg(F.max_by("hash", "position").alias("first"), F.min_by("hash", "position").alias("last"))
        first, last = ends.first()
        if with_coupling and first != last:
            a = self.revisions([first, last])
            trends = compare.module_coupling_trends(a, first, last)
            out["coupling"] = trends
        return out

    def timeline(self, steps: int = 24, limit: int | None = None) -> DataFrame:
        return history.sample_timeline(self.commits(limit), steps, [-F.col("position").cast("long")]).drop("position")

    def revisions(self, revs: list[str]) -> Analysis:
        """Several revisions analysed at once, told apart by ``rev``."""
        return self._analysed(keep(git.scan_revisions(self.spark, self.root, revs, self.cache)))

    def snapshot(self, rev: str) -> DepGraph:
        return codegraph.dependency_graph(keep(git.scan_revisions(self.spark, self.root, [rev], self.cache)))

    def snapshot_map(self, rev: str) -> tuple[DataFrame, DataFrame]:
        """The map of one revision."""
        records = keep(git.scan_revisions(self.spark, self.root, [rev], self.cache))
        return codegraph.map_graph(codegraph.code_nodes(records, self.root), codegraph.code_edges(records, self.root))

    def replay(self, steps: int = 16) -> DataFrame:
        """Files and imports of evenly spaced commits, oldest first; a revision without sources has none."""
        picked = cut(history.sample_timeline(self.commits(), steps, [-F.col("position").cast("long")]))
        sizes = summary.graph_stats(self.revisions([r["hash"] for r in picked.collect()]).degrees)
        sizes = sizes.select(F.col("rev").alias("hash"), "files", "edges")
        found = picked.join(sizes, "hash", "left").fillna(0, ["files", "edges"])
        day = F.substring("date_iso", 1, 10).alias("date")
        return found.orderBy("position").select(F.col("hash").alias("rev"), "short_hash", day, "subject", "files", "edges")

    def compare(self, base: str, head: str) -> dict[str, DataFrame] | None:
        """Everything that differs between two revisions, or nothing when one is unknown."""
        if git.resolve_revision(self.root, base) is None or git.resolve_revision(self.root, head) is None:
            return None
        a = self.revisions([base, head])
        changed = git.changed_files(self.spark, self.root, base, head)
        return {
            "changed_files": changed,
            "moved_files": changed.where("status = 'R'").select(F.col("old_path").alias("from"), F.col("path").alias("to")),
            "dependencies": compare.dependency_changes(a, base, head),
            "cycles": compare.cycle_change_members(a, base, head),
            "hotspots": compare.score_changes(a, base, head).orderBy(F.desc(F.abs("delta")), "path"),
            "coupling": compare.coupling_changes(a, base, head).orderBy(F.desc(F.abs("delta")), "path"),
        }

    def analyze_branch(self, base: str | None = None) -> dict[str, DataFrame]:
        base, head = git.comparison_base(self.root, base), "HEAD"
        a = self.revisions([base, head])
        deps = compare.dependency_changes(a, base, head)
        hot = compare.hotspot_changes(a, base, head)
        return {
            "report": compare.branch_report(a, base, head),
            "new_dependencies": deps.where("change = 'added'").orderBy("from", "to"),
            "removed_dependencies": deps.where("change = 'removed'").orderBy("from", "to"),
            "cycles": compare.cycle_change_members(a, base, head),
            "violations": compare.violation_changes(a, base, head),
            "new_hotspots": hot.where("is_new").select("path"),
            "worsened": hot.where("worsened").select("path"),
            "coupling_increased": compare.coupling_increased(a, base, head),
            "changed_files": git.changed_files(self.spark, self.root, base, head),
        }


# Names under which an agent or a service reaches the questions.
TOOLS = {
    "get_repository_summary": Repository.repository_summary,
    "scan_repo": Repository.rescan,
    "search_symbol": Repository.search_symbol,
    "search_file": Repository.search_file,
    "search_imports": Repository.search_imports,
    "get_hotspots": Repository.hotspots,
    "get_cycles": Repository.cycles,
    "get_layer_violations": Repository.layer_violations,
    "impact_analysis": Repository.impact,
    "dependency_path": Repository.dependency_path,
    "history": Repository.file_history,
    "compare": Repository.compare,
    "find_entry_points": Repository.find_entry_points,
    "find_api_routes": Repository.find_api_routes,
    "find_database_models": Repository.find_database_models,
    "find_configuration": Repository.find_configuration,
    "find_tests": Repository.find_tests,
    "find_unused": Repository.find_unused,
    "find_dead_code": Repository.find_dead_code,
    "build_context": Repository.build_context,
}
