"""What the queries over the given tables share: one analysed graph per session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.config import AnalysisConfig, ForbiddenImport, GovernanceConfig, Layer, LayerRule
from depweave.model import stack_revisions
from depweave.operators import codegraph, history
from depweave.operators.analysis import Analysis
from depweave.session import cut, keep
from depweave.sources import derived, tables

# Rules of the example project that the tables stand for.
LAYERED = AnalysisConfig(
    layers=tuple(Layer(name, (f"{name}/**",)) for name in ("orders", "customers", "promo", "large", "nations", "regions")),
    rules=(LayerRule("orders", ("promo", "large")), LayerRule("customers", ("orders",)), LayerRule("regions", ("nations",))),
)
STRICT = GovernanceConfig(
    forbidden_imports=(
        ForbiddenImport("*/low/**", "*/tests/**"),
        ForbiddenImport("orders/**/*.test.ts", "suppliers/n1*/*.java", "tests stay away from the suppliers"),
    )
)
PACKAGES = ("economy", "medium", "standard", "promo", "large", "small/api", "orders", "customers", "suppliers", "nations")


class TableWorkspace:
    """Lazily computed parts; each is computed once and reused until the workspace is dropped."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def analysis(self) -> Analysis:
        return Analysis(tables.table_graph(self.spark, self.sf_dir))

    @cached_property
    def ruled(self) -> Analysis:
        _ = self.analysis.cycles, self.analysis.degrees
        return self.analysis.configured(LAYERED, STRICT)

    @cached_property
    def import_rules(self) -> Analysis:
        """As :attr:`ruled` for the rules on single imports, which need no cycles."""
        _ = self.analysis.files, self.analysis.edges
        return self.analysis.configured(LAYERED, STRICT)

    @cached_property
    def compared(self) -> Analysis:
        return Analysis(stack_revisions(tables.table_snapshots(self.spark, self.sf_dir)))

    @cached_property
    def changes(self) -> DataFrame:
        return tables.event_changes(self.spark, self.sf_dir)

    @cached_property
    def file_stats(self) -> DataFrame:
        return keep(history.file_history(self.changes))

    @cached_property
    def links(self) -> DataFrame:
        return tables.page_links(self.spark, self.sf_dir)

    @cached_property
    def records(self) -> DataFrame:
        return keep(derived.part_records(self.spark, self.sf_dir))

    @cached_property
    def code_nodes(self) -> DataFrame:
        return keep(codegraph.code_nodes(self.records, derived.ROOT))

    @cached_property
    def code_edges(self) -> DataFrame:
        return keep(codegraph.code_edges(self.records, derived.ROOT))

    @cached_property
    def top_hub(self) -> DataFrame:
        """The file most files import, the target of the single-file queries."""
        best = self.analysis.degrees.orderBy(F.desc("in_degree"), "path").limit(1)
        return cut(best.select("id"))

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name)


_open: dict[tuple[str, str], TableWorkspace] = {}


def workspace(spark: SparkSession, sf_dir: str, fresh: bool = False) -> TableWorkspace:
    """The workspace of a session and folder; ``fresh`` forgets what was computed before."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _open:
        _open[key] = TableWorkspace(spark, sf_dir)
    return _open[key]
