"""One analysed graph: every shared intermediate is computed once and kept."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.config import AnalysisConfig, GovernanceConfig
from depweave.model import DepGraph
from depweave.operators import bitreach, components, health, rules, scores
from depweave.operators.centrality import pagerank
from depweave.operators.degrees import with_degrees
from depweave.operators.skew import HotKeys, hot_join, hot_keys
from depweave.operators.walks import Walks, build_walks
from depweave.session import cut, keep, keep_counted


# Members that no setting changes.
CONFIG_FREE = (
    "files",
    "_counted_edges",
    "edge_paths",
    "degrees",
    "walks",
    "pagerank",
    "bits",
    "scores",
    "hotspots",
    "components",
    "cycles",
    "cycle_members",
    "cycle_signatures",
    "depths",
    "node_metrics",
)


class Analysis:
    """The full analysis of a graph of one or more revisions.

    Members are DataFrames with a ``rev`` column. Those that several others use are written to
    the checkpoint folder on first use, the way a warm session reuses them.
    """

    def __init__(
        self,
        graph: DepGraph,
        config: AnalysisConfig = AnalysisConfig(),
        governance: GovernanceConfig = GovernanceConfig(),
    ):
        self.config = config
        self.governance = governance
        self.source = graph

    def configured(self, config: AnalysisConfig, governance: GovernanceConfig) -> Analysis:
        """The same graph under other settings; what does not depend on them is shared."""
        other = Analysis(self.source, config, governance)
        for name in CONFIG_FREE:
            if name in self.__dict__:
                other.__dict__[name] = self.__dict__[name]
        return other

    @cached_property
    def files(self) -> DataFrame:
        return keep(self.source.files)

    @cached_property
    def _counted_edges(self) -> tuple[DataFrame, int]:
        return keep_counted(self.source.edges)

    @property
    def edges(self) -> DataFrame:
        return self._counted_edges[0]

    @cached_property
    def edge_paths(self) -> DataFrame:
        """``(rev, src, dst, from_path, to_path)`` of every edge."""
        return self.paths_between(F.lit(True), F.lit(True))

    def paths_between(self, source: Column, target: Column) -> DataFrame:
        """As :attr:`edge_paths`, of the edges whose two ends' ``path`` holds ``source`` and ``target``.

        The files are filtered before the joins, so an edge is named only if both its ends may count.
        """
        edges, rows = self._counted_edges
        ends = self.files.select("id", "rev", "path")
        none = HotKeys(edges.schema["src"].dataType)
        importing = ends.where(source).toDF("src", "rev", "from_path")
        imported = ends.where(target).drop("rev").toDF("dst", "to_path")
        named = hot_join(edges, importing, "src", hot_keys(edges, "src", rows), none)
        return hot_join(named, imported, "dst", hot_keys(edges, "dst", rows), none)

    @cached_property
    def degrees(self) -> DataFrame:
        return keep(with_degrees(self.files, self.edges))

    @property
    def imports(self) -> DataFrame:
        """The edges for a question that reads them once: as kept, or else straight from their source, without writing them."""
        return self.edges if "_counted_edges" in self.__dict__ else self.source.edges

    @property
    def coupling(self) -> DataFrame:
        """``(rev, id, path, degree)`` of every file, for questions that need no more of :attr:`degrees`."""
        if "degrees" in self.__dict__:
            found = self.degrees
        else:
            found = with_degrees(self.source.files.select("rev", "id", "path"), self.imports)
        return found.select("rev", "id", "path", "degree")

    @cached_property
    def walks(self) -> Walks:
        return build_walks(self.edges, rows=self._counted_edges[1])

    @cached_property
    def pagerank(self) -> DataFrame:
        weighted = lambda: self.walks if self.walks.weighted else build_walks(self.edges)
        return pagerank(self.files, self.edges, walks=weighted, parts=lambda: self.components)

    @cached_property
    def bits(self) -> bitreach.BitReach:
        """Reach of every file from every file, 64 sources in a number."""
        return bitreach.packed_reach(self.edges, bitreach.numbered(self.files, self.components), self.components)

    @cached_property
    def depths(self) -> DataFrame:
        """``(id, transitive_imports, depth)`` of the files that import anything."""
        return keep(self.bits.ahead())

    @cached_property
    def scores(self) -> DataFrame:
        return keep(scores.hotspot_scores(self.degrees, self.pagerank))

    @cached_property
    def hotspots(self) -> DataFrame:
        return cut(scores.top_hotspots(self.scores))

    @cached_property
    def components(self) -> DataFrame:
        return components.strongly_connected(self.edges)

    @cached_property
    def cycles(self) -> DataFrame:
        return cut(components.cycle_report(self.files, self.edges, self.components, self.degrees))

    @cached_property
    def cycle_members(self) -> DataFrame:
        return components.cycle_members(self.files, self.components)

    @cached_property
    def cycle_signatures(self) -> DataFrame:
        return components.cycle_signatures(self.files, self.components)

    @cached_property
    def god_modules(self) -> DataFrame:
        return scores.god_modules(self.degrees, self.config.thresholds)

    @cached_property
    def unused(self) -> DataFrame:
        return scores.unused_files(self.degrees, self.config.entry_points)

    @cached_property
    def layer_violations(self) -> DataFrame:
        source, target = rules.layer_ends(F.col("path"), self.config)
        return rules.layer_violations(self.paths_between(source, target), self.config)

    @cached_property
    def forbidden_imports(self) -> DataFrame:
        banned = self.governance.forbidden_imports
        source, target = rules.forbidden_ends(F.col("path"), banned)
        return rules.forbidden_imports(self.paths_between(source, target), banned)

    def deep_files(self, limit: int) -> DataFrame:
        """``(id, depth)`` of files deeper than ``limit``."""
        return self.depths.select("id", "depth").where(F.col("depth") > limit)

    @cached_property
    def violations(self) -> DataFrame:
        return cut(rules.evaluate_rules(self, self.governance))

    @cached_property
    def health(self) -> DataFrame:
        return cut(health.health_scores(health.health_inputs(self, self.violations)))

    @cached_property
    def summary(self) -> DataFrame:
        """One row of counts per revision."""
        base = self.degrees.groupBy("rev").agg(
            F.count(F.lit(1)).alias("files"), F.sum("out_degree").alias("edges")
        )
        parts = {
            "cycles": self.cycles,
            "hotspots": self.hotspots,
            "god_modules": self.god_modules,
            "unused": self.unused,
            "layer_violations": self.layer_violations,
        }
        for name, df in parts.items():
            counted = df.groupBy("rev").agg(F.count(F.lit(1)).alias(name))
            base = base.join(F.broadcast(counted), "rev", "left").fillna(0, [name])
        central = scores.most_central(self.pagerank, self.files)
        central = central.select("rev", F.col("path").alias("most_central"))
        return base.join(F.broadcast(central), "rev", "left")

    @cached_property
    def node_metrics(self) -> DataFrame:
        """Degrees, reach both ways, depth, centrality and score of every file."""
        ahead = self.depths
        behind = self.bits.behind().select("id", "transitive_dependents")
        return (
            self.degrees.select("rev", "id", "path", "in_degree", "out_degree")
            .join(ahead, "id", "left")
            .join(behind, "id", "left")
            .fillna(0, ["transitive_imports", "transitive_dependents", "depth"])
            .join(self.scores.select("id", "centrality", F.col("score").alias("hotspot_score")), "id")
        )

    def gate(self) -> DataFrame:
        """Errors, warnings and whether the configured level lets the revision pass."""
        counted = self.files.select("rev").distinct()
        counted = counted.join(rules.count_by_severity(self.violations), "rev", "left")
        counted = counted.fillna(0, ["errors", "warnings"])
        ok = rules.passes(F.col("errors"), F.col("warnings"), self.governance.fail_on)
        return counted.withColumn("passes", ok)
