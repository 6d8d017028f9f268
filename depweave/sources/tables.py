"""The given tables read as a repository: rows are files, their keys the imports, events the changes.

Every row of ``region``, ``nation``, ``customer``, ``supplier``, ``part`` and ``orders`` is a file, and every key
between them, also those of each row of ``lineitem``, is an import. The orders of a customer form a chain
in the order of their dates; the customer imports its latest one. So the graph has hubs (nations,
suppliers), long chains, many cycles of some ten files, and layers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.model import DepGraph
from depweave.operators.skew import HotKeys, hot_keys, lead_by_group

# Number of each kind in the ids of files; parts keep their keys, which are not negative.
KINDS = {"orders": 1, "customers": 2, "suppliers": 3, "nations": 4, "regions": 5}
# Two revisions: orders up to, and from, these days. They overlap by half a year.
BASE_BEFORE = "1998-07-01"
HEAD_FROM = "1998-01-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def part_files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One file per part; the key decides its folder, suffix and language.

    ``more`` names further columns of the part table to carry along.
    """
    key = F.col("p_partkey")
    folder = (
        F.when(key % 8 == 0, "api").when(key % 8 == 1, "models").when(key % 8 == 2, "tests")
        .when(key % 8 == 3, "config").when(key % 8 == 4, "routes").otherwise("core")
    )
    suffix = F.when(key % 4 == 0, ".ts").when(key % 4 == 1, ".js").when(key % 4 == 2, ".py").otherwise(".java")
    lang = (
        F.when(key % 4 == 0, "typescript").when(key % 4 == 1, "javascript")
        .when(key % 4 == 2, "python").otherwise("java")
    )
    path = F.concat(
        F.lower("p_type"), F.lit("/"), folder, F.lit("/m"), (key - key % 8).cast("string"),
        F.when(key % 8 == 2, ".test").otherwise(""), suffix,
    )
    return read(spark, sf_dir, "part").select(
        F.lit("head").alias("rev"),
        key.alias("id"),
        path.alias("path"),
        lang.alias("lang"),
        (F.col("p_size") * 10).alias("loc"),
        (F.col("p_size") * 400).cast("long").alias("size"),
        (key % 18).cast("int").alias("n_exports"),
        (F.col("p_size") % 45).cast("int").alias("n_functions"),
        (key % 8).cast("int").alias("n_classes"),
        *more,
    )


def file_id(kind: str, key: Column) -> Column:
    return -(key * 8 + KINDS[kind])


def _files(kind: str, rows: DataFrame, key: Column, path: Column, lang: str) -> DataFrame:
    number = (key % 60).cast("int")
    return rows.select(
        F.lit("head").alias("rev"), file_id(kind, key).alias("id"), path.alias("path"), F.lit(lang).alias("lang"),
        (number * 10).alias("loc"), (number * 400).cast("long").alias("size"), (key % 18).cast("int").alias("n_exports"),
        (key % 45).cast("int").alias("n_functions"), (key % 8).cast("int").alias("n_classes"),
    )


def _named(prefix: str, name: Column, *rest: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    return F.concat(F.lit(f"{prefix}/"), plain, *[F.lit(r) if isinstance(r, str) else r for r in rest])


def table_files(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One file per row of the six tables; ``orders`` may be those of a period."""
    orders = read(spark, sf_dir, "orders") if orders is None else orders
    urgency = F.regexp_replace(F.lower(F.col("o_orderpriority").substr(3, 20)), "[^a-z]+", "_")
    test = F.when(F.col("o_orderstatus") == "P", ".test").otherwise("")
    order = F.col("o_orderkey")
    files = [
        part_files(spark, sf_dir),
        _files("orders", orders, order, F.concat(F.lit("orders/"), urgency, F.lit("/o"), order.cast("string"), test, F.lit(".ts")), "typescript"),
    ]
    for kind, table, path, lang in (
        ("customers", "customer", _named("customers", F.col("c_mktsegment"), "/c", F.col("c_custkey").cast("string"), ".py"), "python"),
        ("suppliers", "supplier", F.concat(F.lit("suppliers/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".java")), "java"),
        ("nations", "nation", _named("nations", F.col("n_name"), "/index.js"), "javascript"),
        ("regions", "region", _named("regions", F.col("r_name"), "/index.ts"), "typescript"),
    ):
        key = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}[table]
        files.append(_files(kind, read(spark, sf_dir, table), F.col(key), path, lang))
    return reduce(DataFrame.unionByName, files)


def line_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, HotKeys]:
    """``(src, part, supplier)``: the files that each row of ``lineitem`` makes its order import, and the hot orders."""
    order, supplier = file_id("orders", F.col("l_orderkey")), file_id("suppliers", F.col("l_suppkey"))
    lines = read(spark, sf_dir, "lineitem").select(order.alias("src"), F.col("l_partkey").alias("part"), supplier.alias("supplier"))
    return lines, hot_keys(lines, "src", lines.count())


def _of_orders(lines: DataFrame, orders: DataFrame | None) -> DataFrame:
    if orders is None:
        return lines
    return lines.join(orders.select(file_id("orders", F.col("o_orderkey")).alias("src")), "src", "left_semi")


def _distinct_targets(lines: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` to parts, and to suppliers, in one pass over the lines."""
    targets = [F.struct(F.lit(kind).alias("kind"), F.col(name).alias("dst")) for kind, name in enumerate(("part", "supplier"))]
    return lines.select("src", F.inline(F.array(*targets))).distinct().select("src", "dst")


def line_edges(lines: DataFrame, hot: HotKeys, orders: DataFrame | None = None) -> DataFrame:
    """Distinct imports by the lines, of ``orders`` if given.

    The lines are dealt by their order once, for every period and both kinds of import. The lines of a
    hot order, which would all go to one task, are dealt by both ends instead.
    """
    if not hot.slices:
        return _distinct_targets(_of_orders(lines.repartition("src"), orders))
    keys = hot.frame(lines.sparkSession, "src", "_n").drop("_n")
    usual = _of_orders(lines.join(keys, "src", "left_anti").repartition("src"), orders)
    return _distinct_targets(usual).unionByName(_distinct_targets(_of_orders(lines.join(keys, "src", "left_semi"), orders)))


def table_edges(
    spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, lines: tuple[DataFrame, HotKeys] | None = None
) -> DataFrame:
    """Distinct imports ``(src, dst)`` by every key of the tables; ``orders`` may be those of a period.

    ``lines`` are the :func:`line_imports`, if they are there already.
    """
    imports = line_edges(*(lines or line_imports(spark, sf_dir)), orders)
    orders = read(spark, sf_dir, "orders") if orders is None else orders
    dated = orders.select("o_custkey", "o_orderdate", "o_orderkey")
    rows = dated.count()
    newest_first = dated.withColumn("back", -F.unix_micros(F.col("o_orderdate").cast("timestamp"))).withColumn("minus", -F.col("o_orderkey"))
    chain = lead_by_group(newest_first, "o_custkey", ["back", "minus"], "o_orderkey", "before", rows).where("before IS NOT NULL")
    latest = dated.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))

    def link(df: DataFrame, source: Column, target: Column) -> DataFrame:
        return df.select(source.alias("src"), target.alias("dst"))

    def of(kind: str, key: str) -> Column:
        return file_id(kind, F.col(key))

    nations = read(spark, sf_dir, "nation")
    return reduce(
        DataFrame.unionByName,
        [
            link(orders, of("orders", "o_orderkey"), of("customers", "o_custkey")),
            link(chain, of("orders", "o_orderkey"), of("orders", "before")),
            link(latest, of("customers", "o_custkey"), of("orders", "latest")),
            imports,
            link(read(spark, sf_dir, "customer"), of("customers", "c_custkey"), of("nations", "c_nationkey")),
            link(read(spark, sf_dir, "supplier"), of("suppliers", "s_suppkey"), of("nations", "s_nationkey")),
            link(nations, of("nations", "n_nationkey"), of("regions", "n_regionkey")),
            link(nations, of("regions", "n_regionkey"), of("nations", "n_nationkey")),
        ],
    )


def table_graph(spark: SparkSession, sf_dir: str) -> DepGraph:
    return DepGraph.of(table_files(spark, sf_dir), table_edges(spark, sf_dir), trusted=True)


def table_snapshots(spark: SparkSession, sf_dir: str) -> dict[str, DepGraph]:
    """Two revisions: the orders of an earlier and of a later period, with all that they may import."""
    orders = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    periods = {
        "base": orders.where(day < F.lit(BASE_BEFORE).cast("timestamp_ntz")),
        "head": orders.where(day >= F.lit(HEAD_FROM).cast("timestamp_ntz")),
    }
    lines = line_imports(spark, sf_dir)
    return {
        rev: DepGraph.of(table_files(spark, sf_dir, some), table_edges(spark, sf_dir, some, lines), rev, trusted=True)
        for rev, some in periods.items()
    }


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a change log: one changed file per event."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("commit_id"),
        F.concat("event_type", F.lit("/f"), F.regexp_extract("props", "[0-9]+", 0)).alias("path"),
        F.col("user_id").cast("string").alias("author"),
        F.col("ts"),
        F.floor("value").cast("long").alias("insertions"),
        (F.col("event_id") % 7).alias("deletions"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, the import statements of a web page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    return pages.select("page_id", "url", F.explode(links).alias("raw"))
