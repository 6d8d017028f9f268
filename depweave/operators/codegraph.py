"""The typed property graph and the file graph, projected from per-file records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.exprs import basename, dirname
from depweave.model import DepGraph
from depweave.operators.skew import lookup
from depweave.schema import GRAPH_NODE
from depweave.session import spread

# Symbol kind to node type.
NODE_TYPE = {
    "class": "Class",
    "function": "Function",
    "method": "Method",
    "interface": "Interface",
    "enum": "Enum",
    "variable": "Variable",
}
INHERITABLE = {"EXTENDS": ("class",), "IMPLEMENTS": ("interface", "class")}
MAP_NODE_TYPES = ("File", "Directory", "Package")
MAP_EDGE_TYPES = ("IMPORTS", "CONTAINS")


def _prefixed(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column)


def _node(df: DataFrame, **values: Column) -> DataFrame:
    columns = [
        (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in GRAPH_NODE.fields
    ]
    return df.select("rev", *columns)


def _edge(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
    edge_id = F.concat(F.lit(kind + ":"), source, F.lit("->"), target)
    return df.select(
        "rev", edge_id.alias("id"), F.lit(kind).alias("type"), source.alias("source"), target.alias("target")
    )


def file_nodes(records: DataFrame) -> DataFrame:
    """File-graph nodes with their top-level functions and classes nested."""

    def declared(kind: str) -> Column:
        own = F.filter("symbols", lambda s: (s["kind"] == kind) & s["parent"].isNull())
        return F.transform(own, lambda s: F.struct(*[s[n].alias(n) for n in ("name", "kind", "line", "exported")]))

    return records.select(
        "rev",
        _prefixed("file:", F.col("path")).alias("id"),
        "path",
        basename(F.col("path")).alias("name"),
        dirname(F.col("path")).alias("dir"),
        F.col("language").alias("lang"),
        "loc",
        "size",
        "imports",
        "exports",
        declared("function").alias("functions"),
        declared("class").alias("classes"),
    )


def file_edges(nodes: DataFrame) -> DataFrame:
    """One edge per pair of files; the first import statement gives ``raw``; no self imports."""
    stated = nodes.select("rev", F.col("id").alias("source"), F.posexplode("imports").alias("pos", "i"))
    stated = stated.where("i.resolved is not null").select(
        "rev", "source", _prefixed("file:", F.col("i.resolved")).alias("target"), "pos", "i.raw"
    )
    pairs = stated.where(F.col("source") != F.col("target")).groupBy("rev", "source", "target")
    first = pairs.agg(F.min_by("raw", "pos").alias("raw"))
    edge_id = F.concat("source", F.lit("->"), "target")
    return first.select("rev", edge_id.alias("id"), "source", "target", F.lit("import").alias("type"), "raw")


def dependency_graph(records: DataFrame) -> DepGraph:
    """The graph the operators work on; ids of several revisions are told apart by revision."""
    nodes = file_nodes(records)
    key = lambda rev, node: F.struct(F.col(rev).alias("rev"), node.alias("node"))
    files = nodes.select(
        "rev",
        key("rev", F.col("id")).alias("id"),
        "path",
        "lang",
        "loc",
        "size",
        F.size("exports").alias("n_exports"),
        F.size("functions").alias("n_functions"),
        F.size("classes").alias("n_classes"),
    )
    edges = file_edges(nodes).select(
        key("rev", F.col("source")).alias("src"), key("rev", F.col("target")).alias("dst")
    )
    return DepGraph.of(files, edges, trusted=True)


def symbol_rows(records: DataFrame) -> DataFrame:
    """One row per declared symbol, with its node id and its position in the file."""
    rows = records.select("rev", "path", "language", F.posexplode("symbols").alias("pos", "s"))
    rows = rows.select("rev", "path", "language", "pos", "s.*")
    symbol_id = F.concat(
        F.lit("sym:"), "path", F.lit("#"), "kind", F.lit(":"), "name", F.lit("@"), F.col("line").cast("string")
    )
    return rows.withColumn("id", symbol_id)


def directory_rows(records: DataFrame) -> DataFrame:
    """``(rev, dir, parent)`` of every folder above a file; the parent of a top folder is empty."""
    dirs = records.select("rev", dirname(F.col("path")).alias("dir")).where("dir <> ''").distinct()
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    every = dirs.select("rev", F.explode(chain).alias("dir")).distinct()
    return every.withColumn("parent", dirname(F.col("dir")))


def code_nodes(records: DataFrame, root: str) -> DataFrame:
    """Repository, folders, files, symbols and external packages; the first of equal ids is kept."""
    revisions = records.select("rev").distinct()
    short = root.rstrip("/").rsplit("/", 1)[-1] or root
    symbols = symbol_rows(records).groupBy("rev", "id").agg(
        F.min_by(F.struct("path", "language", "name", "kind", "line", "exported", "doc"), "pos").alias("s")
    )
    types = F.create_map(*[F.lit(x) for pair in NODE_TYPE.items() for x in pair])
    packages = _imports(records).where("resolved is null").select("rev", "raw").distinct()
    col = F.col
    parts = [
        _node(revisions, id=F.lit(f"repo:{root}"), type=F.lit("Repository"), name=F.lit(short), path=F.lit("")),
        _node(
            directory_rows(records),
            id=_prefixed("dir:", col("dir")), type=F.lit("Directory"), name=basename(col("dir")), path=col("dir"),
        ),
        _node(
            records,
            id=_prefixed("file:", col("path")), type=F.lit("File"), name=basename(col("path")), path=col("path"),
            language=col("language"), size=col("size"), loc=col("loc"),
        ),
        _node(
            symbols,
            id=col("id"), type=types[col("s.kind")], name=col("s.name"), path=col("s.path"),
            language=col("s.language"), line=col("s.line"), kind=col("s.kind"), exported=col("s.exported"),
            doc=col("s.doc"),
        ),
        _node(packages, id=_prefixed("pkg:", col("raw")), type=F.lit("Package"), name=col("raw"), external=F.lit(True)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _imports(records: DataFrame) -> DataFrame:
    return records.select("rev", "path", F.explode("imports").alias("i")).select("rev", "path", "i.raw", "i.resolved")


def enclosing_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols with ``holder``: the nearest symbol, at or before them, named like their parent.

    Declarations and look-ups of one name in one file are sorted together and the last
    declaration is carried forward, so no pair of symbols is built.
    """
    declared = symbols.select(
        "rev", "path", F.col("name").alias("word"), "pos", F.lit(0).alias("asks"), F.col("id").alias("decl"), "id"
    )
    asked = symbols.where("parent is not null").select(
        "rev", "path", F.col("parent").alias("word"), "pos", F.lit(1).alias("asks"),
        F.lit(None).cast("string").alias("decl"), "id",
    )
    over = Window.partitionBy("rev", "path", "word").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, 0)
    carried = declared.unionByName(asked).withColumn("holder", F.last("decl", ignorenulls=True).over(over))
    return carried.where("asks = 1").select("rev", "id", "pos", "path", "holder")


def inheritance_edges(symbols: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS, linked only where one symbol of the revision fits the name."""
    parts = []
    for kind, allowed in INHERITABLE.items():
        written = symbols.select("rev", F.col("id").alias("source"), F.explode(kind.lower()).alias("ref"))
        written = written.select("source", F.struct("rev", F.substring_index("ref", ".", -1).alias("name")).alias("name"))
        unique = (
            symbols.where(F.col("kind").isin(*allowed))
            .groupBy(F.struct("rev", "name").alias("name"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target"))
            .where("n = 1")
        )
        linked = lookup(written, unique.drop("n"), "name").withColumn("rev", F.col("name.rev"))
        parts.append(_edge(linked, kind, F.col("source"), F.col("target")))
    return reduce(DataFrame.unionByName, parts)


def code_edges(records: DataFrame, root: str) -> DataFrame:
    """All typed edges, one per type and pair of nodes."""
    symbols = symbol_rows(records)
    col = F.col
    file_id = _prefixed("file:", col("path"))
    repo = F.lit(f"repo:{root}")
    folder = dirname(col("path"))
    holder = F.when(folder == "", repo).otherwise(_prefixed("dir:", folder))
    above = F.when(col("parent") == "", repo).otherwise(_prefixed("dir:", col("parent")))
    held = enclosing_symbols(symbols)
    free = symbols.where("parent is null")
    imports = _imports(records)
    target = F.when(col("resolved").isNotNull(), _prefixed("file:", col("resolved"))).otherwise(
        _prefixed("pkg:", col("raw"))
    )
    parts = [
        _edge(directory_rows(records), "CONTAINS", above, _prefixed("dir:", col("dir"))),
        _edge(records, "CONTAINS", holder, file_id),
        _edge(held.where("holder is not null"), "CONTAINS", col("holder"), col("id")),
        _edge(held.where("holder is null"), "DECLARES", file_id, col("id")),
        _edge(free, "DECLARES", file_id, col("id")),
        _edge(free.where("exported"), "EXPORTS", file_id, col("id")),
        _edge(imports, "IMPORTS", file_id, target),
        inheritance_edges(symbols),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("rev", "type").agg(F.count(F.lit(1)).alias("nodes"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rev", "type").agg(F.count(F.lit(1)).alias("edges"))


def primary_language(records: DataFrame) -> DataFrame:
    """Language of most files, the smallest name on a tie."""
    counted = records.groupBy("rev", "language").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("language", F.struct(-F.col("n"), F.col("language")))
    return counted.groupBy("rev").agg(best.alias("primary_language"))


def map_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files, folders and packages with their import degree, and the edges between them."""
    imports = edges.where(F.col("type") == "IMPORTS")
    ends = imports.select("rev", F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("rev", "id").agg(F.count(F.lit(1)).alias("degree"))
    kept = nodes.where(F.col("type").isin(*MAP_NODE_TYPES))
    shown = kept.join(spread(degree), ["rev", "id"], "left").select(
        "rev",
        "id",
        "type",
        "name",
        F.coalesce("path", "name").alias("path"),
        "language",
        F.coalesce("loc", F.lit(0)).alias("loc"),
        F.coalesce("degree", F.lit(0)).alias("degree"),
    )
    ids = spread(kept.select("rev", "id"))
    linked = edges.where(F.col("type").isin(*MAP_EDGE_TYPES))
    linked = linked.join(ids.toDF("rev", "source"), ["rev", "source"], "left_semi")
    linked = linked.join(ids.toDF("rev", "target"), ["rev", "target"], "left_semi")
    return shown, linked.select("rev", "id", "type", "source", "target")


def map_facets(map_nodes: DataFrame) -> DataFrame:
    """``(rev, facet, value, nodes)``: map nodes per type and per language."""
    types = map_nodes.select("rev", F.lit("type").alias("facet"), F.col("type").alias("value"))
    spoken = map_nodes.where("language is not null")
    languages = spoken.select("rev", F.lit("language").alias("facet"), F.col("language").alias("value"))
    return types.unionByName(languages).groupBy("rev", "facet", "value").agg(F.count(F.lit(1)).alias("nodes"))


def map_extent(map_nodes: DataFrame) -> DataFrame:
    """Greatest degree and number of folders of the map."""
    return map_nodes.groupBy("rev").agg(
        F.max("degree").alias("max_degree"), F.count_if(F.col("type") == "Directory").alias("directories")
    )


def derived_symbols(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions, then classes, of file nodes as symbols, and the edges from their files."""
    rows = nodes.select("rev", F.col("id").alias("file"), "path", "lang", F.explode(F.concat("functions", "classes")).alias("d"))
    symbol_id = F.concat(
        F.lit("sym:"), "path", F.lit("#"), "d.kind", F.lit(":"), "d.name", F.lit("@"), F.col("d.line").cast("string")
    )
    rows = rows.select("rev", symbol_id.alias("id"), "d.name", "d.kind", "file", "path", "lang", "d.line", "d.exported")
    contains = rows.select(
        "rev",
        F.concat("file", F.lit("=>"), "id").alias("id"),
        F.col("file").alias("source"),
        F.col("id").alias("target"),
        F.lit("contains").alias("type"),
    )
    return rows, contains


