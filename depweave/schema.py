"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql import types as T

IMPORT_REF = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("resolved", T.StringType()),
        T.StructField("external", T.BooleanType()),
        T.StructField("line", T.IntegerType()),
    ]
)

RAW_IMPORT = T.StructType(
    [T.StructField("raw", T.StringType()), T.StructField("line", T.IntegerType())]
)

SYMBOL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("parent", T.StringType()),
        T.StructField("extends", T.ArrayType(T.StringType())),
        T.StructField("implements", T.ArrayType(T.StringType())),
        T.StructField("doc", T.StringType()),
    ]
)

# One row per source text. ``key`` names the text: a path, or a content hash.
FACTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("exports", T.ArrayType(T.StringType())),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("comments", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(RAW_IMPORT)),
    ]
)

FILES_IR = T.StructType(
    [
        T.StructField("rev", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("loc", T.IntegerType()),
        T.StructField("imports", T.ArrayType(IMPORT_REF)),
        T.StructField("exports", T.ArrayType(T.StringType())),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("comments", T.ArrayType(T.StringType())),
    ]
)

SYMBOL_INFO = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("exported", T.BooleanType()),
    ]
)

FILE_NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("loc", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("imports", T.ArrayType(IMPORT_REF)),
        T.StructField("exports", T.ArrayType(T.StringType())),
        T.StructField("functions", T.ArrayType(SYMBOL_INFO)),
        T.StructField("classes", T.ArrayType(SYMBOL_INFO)),
    ]
)

FILE_EDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

GRAPH_NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("loc", T.IntegerType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("exported", T.BooleanType()),
        T.StructField("external", T.BooleanType()),
        T.StructField("doc", T.StringType()),
    ]
)

GRAPH_EDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("short_hash", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("date_iso", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("commit_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date_iso", T.StringType()),
        T.StructField("insertions", T.LongType()),
        T.StructField("deletions", T.LongType()),
    ]
)

HEALTH_SNAPSHOT = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [
        T.StructField(name, T.LongType())
        for name in (
            "overall",
            "maintainability",
            "stability",
            "modularity",
            "coupling",
            "complexity",
            "cycles",
            "god_modules",
            "hotspot_avg",
            "unused",
        )
    ]
    + [T.StructField("avg_degree", T.DoubleType())]
)
