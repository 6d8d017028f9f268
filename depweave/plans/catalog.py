"""Named queries over the given tables, one per operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.config import DEFAULT_ENTRY_GLOBS
from depweave.functions import classify, exprs
from depweave.functions.globs import matches_any
from depweave.functions.tokens import keywords
from depweave.operators import codegraph, compare, context, health, history, impact, packages
from depweave.operators import reach, rules, scores, store, summary
from depweave.plans.workspace import PACKAGES, TableWorkspace, workspace
from depweave.sinks import export, reports
from depweave.sources import derived, facts_table
from depweave.sources.workspaces import package_frame

Query = Callable[[TableWorkspace], DataFrame]
CATALOG: dict[str, Query] = {}

SEARCH_TEXT = "core/m1"
TARGET_TEXT = "./core/m16.js"
SYMBOL_TEXT = "c12"
REQUEST_TEXT = "Please fix the promo routes and update config handling"


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def _text(column: str):
    return F.array_join(column, "; ").alias(column)


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _paths(w: TableWorkspace, name: str) -> DataFrame:
    return w.analysis.files.select(F.col("id").alias(name), F.col("path").alias(f"{name}_path"))


# --- counts and degrees ----------------------------------------------------------------------


@query
def file_graph_stats(w):
    return summary.graph_stats(w.analysis.degrees).drop("rev")


@query
def language_histogram(w):
    return summary.language_histogram(w.analysis.files).drop("rev")


@query
def degrees(w):
    return w.analysis.degrees.select("path", "in_degree", "out_degree", "degree")


@query
def degree_stats(w):
    return summary.degree_stats(w.analysis.degrees).drop("rev")


@query
def hubs(w):
    return summary.hubs(w.analysis.degrees).drop("rev")


@query
def connectors(w):
    return summary.connectors(w.analysis.degrees).drop("rev")


@query
def orphans(w):
    return summary.orphans(w.analysis.degrees).drop("rev")


@query
def folder_counts(w):
    return summary.folder_counts(w.analysis.files).drop("rev")


@query
def external_packages(w):
    return summary.external_packages(w.links)


@query
def file_edges(w):
    return w.analysis.edge_paths.select("from_path", "to_path")


# --- store -----------------------------------------------------------------------------------


@query
def search_path(w):
    return store.search_path(w.analysis.files, SEARCH_TEXT).select("path")


@query
def search_path_short_first(w):
    return store.search_path_short_first(w.analysis.files, SEARCH_TEXT, 20).select("path")


@query
def search_map(w):
    nodes, _ = codegraph.map_graph(w.code_nodes, w.code_edges)
    return store.search_map(nodes, SEARCH_TEXT).select("id", "path")


@query
def filter_map(w):
    nodes, _ = codegraph.map_graph(w.code_nodes, w.code_edges)
    kept = store.filter_map(nodes, ["File", "Directory"], ["python", "java"], "promo", 0)
    return kept.select("id", "type", "degree")


@query
def subgraph_folder(w):
    nodes, _ = store.subgraph(w.analysis.degrees, w.analysis.edges, folder="orders/")
    return nodes.select("path", "degree")


@query
def subgraph_folder_edges(w):
    _, edges = store.subgraph(w.analysis.files, w.analysis.imports, folder="orders/")
    return edges.select("src", "dst")


@query
def subgraph_min_degree(w):
    nodes, _ = store.subgraph(w.analysis.degrees, w.analysis.edges, min_degree=4)
    return nodes.select("path", "degree")


@query
def subgraph_limit(w):
    nodes, _ = store.subgraph(w.analysis.degrees, w.analysis.edges, folder="large", min_degree=2, limit=25)
    return nodes.select("path", "degree")


@query
def neighbors_out_2(w):
    return store.neighbors(w.analysis.files, w.analysis.edges, w.top_hub, "out", 2)[0].select("path")


@query
def neighbors_in_2(w):
    return store.neighbors(w.analysis.files, w.analysis.edges, w.top_hub, "in", 2)[0].select("path")


@query
def neighbors_both_1(w):
    return store.neighbors(w.analysis.files, w.analysis.edges, w.top_hub, "both", 1)[0].select("path")


@query
def neighbors_both_2_edges(w):
    return store.neighbors(w.analysis.files, w.analysis.edges, w.top_hub, "both", 2)[1].select("src", "dst")


@query
def resolve_target(w):
    return store.resolve_target(w.analysis.files, TARGET_TEXT)


@query
def search_imports(w):
    return store.search_imports(w.analysis.files, w.analysis.edges, w.top_hub).drop("id")


# --- reach -----------------------------------------------------------------------------------


@query
def reach_out(w):
    """All that any file depends on, with the distance."""
    return w.analysis.bits.pairs()


@query
def reach_in(w):
    return w.analysis.bits.behind().join(w.analysis.files, "id").select("path", "transitive_dependents", "max_hop")


@query
def dependency_depth(w):
    return w.analysis.depths.join(w.analysis.files, "id").select("path", "depth")


@query
def deep_files(w):
    found = w.analysis.deep_files(10)
    return found.join(w.analysis.files, "id").select("path", "depth")


@query
def node_metrics(w):
    return w.analysis.node_metrics.select(
        "path", "in_degree", "out_degree", "transitive_imports", "transitive_dependents", "depth",
        F.round("centrality", 9).alias("centrality"), "hotspot_score",
    )


def _longest_way(w):
    """The way to the top hub from the file farthest from it."""
    a = w.analysis
    farthest = F.min_by("id", F.struct(-F.col("hop"), F.col("id"))).alias("id")
    start = _affected(w).agg(farthest).where("id is not null")
    return reach.shortest_path(a.edges, start, w.top_hub)


@query
def shortest_path(w):
    """Ends and length of the longest of the shortest ways to the top hub."""
    return _longest_way(w).agg(
        F.min_by("id", "hop").alias("source"), F.max_by("id", "hop").alias("target"), F.max("hop").alias("length")
    )


@query
def path_nodes(w):
    """Every file on that way."""
    return _longest_way(w).join(w.analysis.files, "id").select("hop", "path")


@query
def reachable_from_entries(w):
    a = w.analysis
    roots = a.files.where(matches_any(F.col("path"), ("**/tests/**", "**/*.test.*"))).select("id")
    return reach.reachable_from(a.edges, roots, a.walks).join(a.files, "id").select("path")


# --- cycles, centrality, scores --------------------------------------------------------------


@query
def cycles(w):
    return w.analysis.cycles.select("first_file", "length", "severity", "break_from", "break_to")


@query
def cycle_members(w):
    return w.analysis.cycle_members.join(w.analysis.cycles.select("comp", "first_file"), "comp").select(
        "first_file", "path"
    )


@query
def pagerank(w):
    return w.analysis.pagerank.join(w.analysis.files.select("id", "path"), "id").select(
        "path", F.round("pagerank", 9).alias("pagerank")
    )


@query
def most_central(w):
    return scores.most_central(w.analysis.pagerank, w.analysis.files).select("path", F.round("pagerank", 9).alias("pagerank"))


@query
def hotspots(w):
    return w.analysis.hotspots.select("path", "score", _text("reasons"), "dependents", "dependencies", "loc", "exports")


@query
def hotspot_scores(w):
    return w.analysis.scores.select("path", F.round("raw_score", 6).alias("raw_score"), "score", _text("reasons"))


@query
def god_modules(w):
    return w.analysis.god_modules.select("path", _text("reasons"), "dependents")


@query
def unused_files(w):
    return w.analysis.unused.select("path", _text("reasons"))


# --- rules and health ------------------------------------------------------------------------


@query
def layer_violations(w):
    return w.import_rules.layer_violations.drop("rev")


@query
def forbidden_imports(w):
    return w.import_rules.forbidden_imports.drop("rev")


@query
def rule_violations(w):
    return w.ruled.violations.drop("rev")


@query
def violation_gate(w):
    return w.ruled.gate().drop("rev")


@query
def health_score(w):
    return w.analysis.health.drop("rev")


@query
def analysis_summary(w):
    return w.analysis.summary.drop("rev")


# --- impact ----------------------------------------------------------------------------------


def _affected(w):
    return impact.affected_files(w.analysis.edges, w.top_hub, w.analysis.walks)


@query
def impact_hops(w):
    found = impact.affected_with_reason(w.analysis.files, w.analysis.edges, _affected(w))
    return found.select("path", "hop", "reason")


@query
def affected_tests(w):
    return impact.affected_tests(w.analysis.files, _affected(w), w.top_hub).drop("target")


@query
def affected_entry_points(w):
    return impact.affected_entry_points(w.analysis.files, _affected(w)).drop("target")


@query
def affected_directories(w):
    return impact.affected_directories(w.analysis.files, _affected(w)).drop("target")


@query
def blast_radius(w):
    return impact.blast_radius(w.analysis, impact.counts_of_all(w.analysis)).drop("rev", "target")


@query
def impact_report(w):
    counts = impact.counts_of_targets(w.analysis.files, w.analysis.edges, _affected(w))
    return impact.blast_radius(w.analysis, counts, w.top_hub).drop("rev", "target")


# --- history ---------------------------------------------------------------------------------


@query
def file_history(w):
    return w.file_stats.select(
        "path", "commits", "insertions", "deletions", "authors", _stamp("first_date"), _stamp("last_date"), "churn"
    )


@query
def churn(w):
    return history.churn(w.file_stats)


@query
def stability(w):
    return history.stability(w.file_stats)


@query
def churn_by_directory(w):
    return history.churn_by_directory(w.file_stats).withColumn("oldest", _stamp("oldest"))


@query
def evolution_insights(w):
    return history.evolution_insights(w.file_stats)


@query
def timeline_sample(w):
    commits = w.changes.select("commit_id", "ts", "author")
    picked = history.sample_timeline(commits, 24, [F.col("ts"), F.col("commit_id")])
    return picked.select("position", "commit_id", "author", _stamp("ts"))


@query
def rename_paths(w):
    part = w.table("part")
    old, new = F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    key = F.col("p_partkey").cast("string")
    raw = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("src/{"), old, F.lit(" => "), new, F.lit("}/m"), key))
        .when(F.col("p_partkey") % 3 == 1, F.concat(old, F.lit("/m"), key, F.lit(" => "), new, F.lit("/m"), key))
        .otherwise(F.concat(F.lit("lib/{"), old, F.lit(" => }/m"), key))
    )
    return part.select(F.col("p_partkey").alias("id"), exprs.normalize_rename(raw).alias("path"))


# --- comparison ------------------------------------------------------------------------------


@query
def revision_sizes(w):
    return summary.graph_stats(w.compared.degrees).select("rev", "files", "edges")


@query
def dependency_changes(w):
    return compare.dependency_changes(w.compared)


@query
def file_changes(w):
    return compare.file_changes(w.compared.files)


@query
def cycle_changes(w):
    return compare.cycle_change_members(w.compared)


@query
def cycle_changes_backward(w):
    return compare.cycle_change_members(w.compared, "head", "base")


@query
def violation_changes(w):
    return compare.violation_changes(w.compared)


@query
def hotspot_changes(w):
    return compare.hotspot_changes(w.compared)


@query
def score_changes(w):
    return compare.score_changes(w.compared)


@query
def coupling_changes(w):
    return compare.coupling_changes(w.compared).select("path", "before", "after", "delta")


@query
def coupling_increased(w):
    return compare.coupling_increased(w.compared)


@query
def coupling_trends(w):
    return compare.module_coupling_trends(w.compared)


@query
def coupling_delta(w):
    return compare.coupling_delta(w.compared)


@query
def architecture_diff(w):
    return compare.architecture_diff(w.compared)


@query
def branch_report(w):
    return compare.branch_report(w.compared)


@query
def health_trend(w):
    snapshots = w.compared.health.withColumnRenamed("rev", "timestamp")
    return health.trend(health.retained(snapshots)).select(
        "timestamp", "overall", "grade", "direction", "health_delta", "coupling_delta", "cycles_delta",
        "hotspots_delta", "god_modules_delta",
    )


@query
def health_range(w):
    return health.series_range(w.compared.health)


# --- texts and the property graph ------------------------------------------------------------


@query
def line_count(w):
    return w.table("documents").select("doc_id", exprs.line_count(F.col("text")).alias("loc"))


@query
def keyword_counts(w):
    words = w.table("conversations").select(F.explode(keywords(F.col("text"))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count(F.lit(1)).alias("turns"))


@query
def source_symbols(w):
    rows = codegraph.symbol_rows(w.records)
    return rows.select("path", "name", "kind", "line", "exported", "parent", _text("extends"), "doc")


@query
def source_facts(w):
    """Every fact of every text, by the table function in SQL."""
    facts_table.register(w.spark)
    derived.part_sources(w.spark, w.sf_dir).createOrReplaceTempView("part_sources")
    return w.spark.sql(
        "SELECT s.path, f.fact, f.name, f.kind, f.line, f.exported, f.parent "
        "FROM part_sources s, LATERAL source_facts(s.language, s.text) f"
    )


@query
def source_exports(w):
    return w.records.select("path", F.explode("exports").alias("name"))


@query
def source_comments(w):
    return w.records.select("path", F.explode("comments").alias("comment"))


@query
def source_files(w):
    return w.records.select("path", "language", "size", "loc")


@query
def import_resolution(w):
    rows = w.records.select("path", F.explode("imports").alias("i"))
    return rows.select("path", "i.raw", "i.resolved", "i.external", "i.line")


@query
def resolved_file_graph(w):
    edges = codegraph.file_edges(codegraph.file_nodes(w.records))
    return edges.select("source", "target", "raw")


@query
def code_graph_nodes(w):
    return w.code_nodes.select("id", "type", "name", "path", "language", "loc", "line", "exported", "external")


@query
def code_graph_edges(w):
    return w.code_edges.select("id", "type", "source", "target")


@query
def node_type_counts(w):
    return codegraph.node_type_counts(w.code_nodes).drop("rev")


@query
def edge_type_counts(w):
    return codegraph.edge_type_counts(w.code_edges).drop("rev")


@query
def directory_tree(w):
    return codegraph.directory_rows(w.records).drop("rev")


@query
def primary_language(w):
    return codegraph.primary_language(w.records).drop("rev")


@query
def map_graph_nodes(w):
    nodes, _ = codegraph.map_graph(w.code_nodes, w.code_edges)
    return nodes.select("id", "type", "path", "language", "degree")


@query
def map_graph_edges(w):
    _, edges = codegraph.map_graph(w.code_nodes, w.code_edges)
    return edges.select("id", "type", "source", "target")


@query
def map_facets(w):
    return codegraph.map_facets(codegraph.map_graph(w.code_nodes, w.code_edges)[0]).drop("rev")


@query
def map_extent(w):
    return codegraph.map_extent(codegraph.map_graph(w.code_nodes, w.code_edges)[0]).drop("rev")


@query
def derived_symbols(w):
    symbols, _ = codegraph.derived_symbols(codegraph.file_nodes(w.records))
    return symbols.select("id", "name", "kind", "path", "line", "exported")


@query
def derived_contains(w):
    _, contains = codegraph.derived_symbols(codegraph.file_nodes(w.records))
    return contains.select("id", "source", "target")


def _placed(w):
    return packages.package_of(w.analysis.files, package_frame(w.spark, list(PACKAGES)))


@query
def package_rollup(w):
    return packages.package_rollup(_placed(w), w.analysis.edges).select("package", "files", "loc", _text("depends_on"))


@query
def package_dependencies(w):
    return packages.package_dependencies(_placed(w), w.analysis.edges).drop("rev")


# --- navigation, context, documents ----------------------------------------------------------


@query
def find_entry_points(w):
    files = w.analysis.files.withColumn("kind", classify.entry_kind(F.col("path")))
    return files.where("kind is not null").select("path", "kind", "lang", "n_exports")


def _located(w, predicate):
    return w.analysis.files.where(predicate(F.col("path"))).select("path", "lang", "n_exports")


@query
def find_tests(w):
    return _located(w, classify.is_test)


@query
def find_api_routes(w):
    return _located(w, classify.is_api_route)


@query
def find_models(w):
    return _located(w, classify.is_model)


@query
def find_config(w):
    return _located(w, classify.is_config)


@query
def symbol_search(w):
    hits = context.search_symbols(codegraph.symbol_rows(w.records), SYMBOL_TEXT)
    return hits.select("id", "name", "kind", "line", "exported")


@query
def symbol_references(w):
    hits = context.search_symbols(codegraph.symbol_rows(w.records), SYMBOL_TEXT)
    return context.symbol_references(hits, w.analysis.files, w.analysis.edges)


def _context(w, part):
    symbols = codegraph.symbol_rows(w.records)
    return context.build_context(w.analysis, symbols, REQUEST_TEXT, parts=(part,))[part]


@query
def context_related(w):
    return _context(w, "related").drop("id")


@query
def context_edges(w):
    return _context(w, "dependency_edges")


@query
def context_modules(w):
    return _context(w, "affected_modules")


@query
def export_document(w):
    return export.export_lines(w.records, derived.ROOT)


@query
def export_sections(w):
    lines = export.export_lines(w.records, derived.ROOT)
    return lines.groupBy("section").agg(F.count(F.lit(1)).alias("lines"))


@query
def health_report(w):
    return reports.report_rows(w.analysis).drop("rev")


@query
def tree_changes(w):
    """The documents as two listed trees: by language, and by source without blanks at their ends."""
    docs = w.table("documents")
    name = F.concat(F.lit("/"), F.col("doc_id").cast("string"))
    base = docs.select(F.concat("lang", name).alias("path"), F.md5("text").alias("key"))
    moved = F.when(F.col("lang") == "en", F.concat("source", name)).otherwise(F.concat("lang", name))
    head = docs.select(moved.alias("path"), F.md5(F.rtrim("text")).alias("key"))
    return compare.tree_changes(base, head)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(workspace(spark, sf_dir))

    return {name: bind(fn) for name, fn in CATALOG.items()}
