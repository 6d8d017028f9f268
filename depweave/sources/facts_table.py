"""The extractors as a table function, for SQL with LATERAL.

    register(spark)
    spark.sql("SELECT s.path, f.* FROM sources s, LATERAL source_facts(s.language, s.text) f")

One row for each symbol, import and export of a text, in that order; a text of an unknown language, a
null text and one without facts give no row. Names of columns that are asked for are checked when the
query is analysed: ``language`` must be a constant or a column of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from depweave.session import ship_package
from depweave.sources.extract import EXTRACTORS, facts_or_empty

NAME = "source_facts"
ROW = T.StructType(
    [
        T.StructField("fact", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("parent", T.StringType()),
    ]
)


class SourceFacts:
    """``source_facts(language, text)``."""

    @staticmethod
    def analyze(language: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        for name, argument in (("language", language), ("text", text)):
            if argument.isTable or not isinstance(argument.dataType, (T.StringType, T.NullType)):
                raise ValueError(f"{NAME}: {name} must be a string")
        if language.isConstantExpression and language.value not in (None, *EXTRACTORS):
            raise ValueError(f"{NAME}: no extractor for {language.value!r}, only for {', '.join(EXTRACTORS)}")
        return AnalyzeResult(schema=ROW)

    def eval(self, language: str | None, text: str | None) -> Iterator[tuple]:
        if text is None or language not in EXTRACTORS:
            return
        facts = facts_or_empty(language, text)
        for s in facts["symbols"]:
            yield "symbol", s["name"], s["kind"], s["line"], s["exported"], s["parent"]
        for i in facts["imports"]:
            yield "import", i["raw"], None, i["line"], None, None
        for name in facts["exports"]:
            yield "export", name, None, None, None, None


def register(spark: SparkSession) -> None:
    """Make ``source_facts`` known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register(NAME, udtf(SourceFacts))
