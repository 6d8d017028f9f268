"""Source texts derived from the part table, one text per part, row by row.

They let the whole way from text to graph run over the given tables: extraction, resolution,
property graph. Nothing is grouped, so no part can make a text grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.sources.cache import extract_cached
from depweave.sources.resolve import assemble
from depweave.sources.tables import part_files

ROOT = "parts"


def _fill(template: str, **values: Column) -> Column:
    """A template whose ``{name}`` gaps are filled with columns."""
    text: Column = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


SCRIPT = """// {name}
import { dep } from "./m{near}";
import lib from "{brand}";
export function f{key}() { return lib(dep); }
const g{key} = 1;
export class C{key} extends C{prior} {
  h{key}() { return g{key}; }
}
"""

PYTHON = '''# {name}
import {brand}
from .m{near} import dep

def f{key}():
    """Makes {name}."""
    return dep

_g{key} = 1

class C{key}(C{prior}):
    def h{key}(self):
        return _g{key}
'''

JAVA = """// {name}
package {kind}.{folder};
import {kind}.{folder}.m{near};
import java.util.{brand};
public class C{key} extends C{prior} {
  private int g{key} = 1;
  public int h{key}() { return g{key}; }
}
"""


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rev, path, language, size, text, key)``; each part imports its folder's next file."""
    rows = part_files(spark, sf_dir, "p_name", "p_brand").withColumnRenamed("lang", "language")
    number = F.col("id") - F.col("id") % 8
    values = {
        "name": F.col("p_name"),
        "near": (number + 8).cast("string"),
        "brand": F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""),
        "key": F.col("id").cast("string"),
        "prior": (F.col("id") + 8).cast("string"),
        "kind": F.substring_index("path", "/", 1),
        "folder": F.substring_index(F.substring_index("path", "/", 2), "/", -1),
    }
    text = (
        F.when(F.col("language") == "python", _fill(PYTHON, **values))
        .when(F.col("language") == "java", _fill(JAVA, **values))
        .otherwise(_fill(SCRIPT, **values))
    )
    return rows.select(
        "rev",
        "path",
        "language",
        F.octet_length(text).cast("long").alias("size"),
        text.alias("text"),
        F.concat_ws(":", "language", F.sha1(text)).alias("key"),
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = part_sources(spark, sf_dir)
    return assemble(sources, extract_cached(sources))
