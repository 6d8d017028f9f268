"""The health report as rows, and those rows as text, HTML or JSON lines.

``report_rows`` is one DataFrame with everything a report says, whole lists included. The writers take
its rows one after the other, so a long list never stands in memory.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SCORES = ("overall", "maintainability", "stability", "modularity", "coupling", "complexity", "grade")
COUNTS = ("files", "edges", "cycles", "cycle_files", "god_modules", "unused", "errors", "warnings")
CHANGES = ("direction", "health_delta", "coupling_delta", "cycles_delta", "god_modules_delta")
SCHEMA = "rev string, part string, item string, value string"


def _facts(df: DataFrame, part: str, names: Iterable[str]) -> DataFrame:
    """A row for each of the named columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("string").alias("value")) for n in names])
    return df.select("rev", F.lit(part).alias("part"), F.explode(pairs).alias("p")).select("rev", "part", "p.item", "p.value")


def report_rows(analysis, trend: DataFrame | None = None) -> DataFrame:
    """``(rev, part, item, value)``: scores, counts, every violation and the hotspots.

    ``trend`` adds the changes since the last scan, a row of :func:`depweave.operators.health.trend`.
    """
    broken = analysis.violations.select(
        "rev", F.col("severity").alias("part"), F.concat_ws(" ", "rule", "file").alias("item"), F.col("detail").alias("value")
    )
    hot = analysis.hotspots.select(
        "rev", F.lit("hotspot").alias("part"), F.col("path").alias("item"),
        F.concat(F.col("score").cast("string"), F.lit(": "), F.array_join("reasons", "; ")).alias("value"),
    )
    rows = _facts(analysis.health, "score", SCORES).unionByName(_facts(analysis.health, "count", COUNTS))
    if trend is not None:
        rows = rows.unionByName(_facts(trend.withColumnRenamed("timestamp", "rev"), "change", CHANGES))
    return rows.unionByName(broken).unionByName(hot)


def ordered(rows: DataFrame) -> Iterator[Row]:
    """The rows in reading order, a partition at a time."""
    return rows.orderBy("rev", "part", "item", "value").toLocalIterator()


def text_lines(rows: Iterable[Row]) -> Iterator[str]:
    part = None
    for row in rows:
        if row["part"] != part:
            part = row["part"]
            yield f"[{part}]"
        yield f"  {row['item']} = {row['value']}"


def html_lines(rows: Iterable[Row], title: str) -> Iterator[str]:
    """A page of one table; scores are drawn as meters."""
    yield f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>"
    for row in rows:
        part, item, value = (html.escape(str(row[c])) for c in ("part", "item", "value"))
        drawn = f"<meter min=0 max=100 value={value}></meter> {value}" if part == "score" and value.isdigit() else value
        yield f"<tr class={part}><td>{part}<td>{item}<td>{drawn}"
    yield "</table>"


def json_lines(rows: Iterable[Row]) -> Iterator[str]:
    for row in rows:
        yield json.dumps({c: row[c] for c in ("part", "item", "value")}, ensure_ascii=False)
