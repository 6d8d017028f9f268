"""A source tree as per-file records.

The tree must lie in a folder that every executor can reach. Spark's own file sources leave out
names with a leading underscore or dot, package markers among them, so tasks list the folders
level by level and read the files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.config import ScanConfig, load_scan_config
from depweave.functions.classify import language_of
from depweave.session import cut_counted, keep, ship_package
from depweave.sources.cache import extract_cached
from depweave.sources.ignore import IGNORED_FOLDERS, READ_HIDDEN, compile_rules, ignored
from depweave.sources.resolve import assemble

ENTRY = "path string, folder boolean, size long"
# Files read before a task hands a batch on.
FILES_PER_BATCH = 64


def _ignore_lines(root: str) -> list[str]:
    try:
        return Path(root, ".gitignore").read_text(encoding="utf-8").splitlines()
    except OSError:
        return []


def _listing(root: str):
    """Entries of each folder of a batch; links are not followed, unreadable folders are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in entries:
                            path = f"{folder}/{e.name}" if folder else e.name
                            if e.is_dir(follow_symlinks=False):
                                rows.append((path, True, 0))
                            elif e.is_file(follow_symlinks=False):
                                rows.append((path, False, e.stat(follow_symlinks=False).st_size))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "folder", "size"])

    return run


def walk(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """``(path, language, size)`` of the supported files below ``root`` that are not ignored.

    Ignored folders are dropped before they are listed.
    """
    config = config or load_scan_config(root)
    ship_package(spark)
    rules = compile_rules(_ignore_lines(root) + list(config.exclude))
    name = F.substring_index("path", "/", -1)
    skipped = name.isin(*IGNORED_FOLDERS) | (name.startswith(".") & (name != READ_HIDDEN))
    level, folders, found = spark.createDataFrame([("",)], "path string"), 1, []
    while folders:
        tasks = min(folders, max(1, spark.sparkContext.defaultParallelism) * 8)
        entries, _ = cut_counted(level.repartition(tasks).mapInPandas(_listing(root), ENTRY))
        if rules:
            asked = F.when(F.col("folder"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))
            entries = entries.where(~ignored(asked, rules))
        files = entries.where(~F.col("folder")).withColumn("language", language_of(F.col("path")))
        files = files.where(F.col("language").isNotNull())
        if config.languages:
            files = files.where(F.col("language").isin(*config.languages))
        found.append(files.select("path", "language", "size"))
        level = entries.where(F.col("folder") & ~skipped).select("path")
        folders = level.count()
    return reduce(DataFrame.unionByName, found)


def read_sources(spark: SparkSession, root: str, config: ScanConfig | None = None, rev: str = "head") -> DataFrame:
    """``(rev, path, language, size, text, key)``; the key names the language and the content."""
    files = walk(spark, root, config).repartition("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), FILES_PER_BATCH):
                part = batch.iloc[at : at + FILES_PER_BATCH]
                contents = []
                for path in part["path"]:
                    try:
                        contents.append(Path(root, path).read_bytes())
                    except OSError:
                        contents.append(None)
                yield part.assign(content=contents)

    read = files.mapInPandas(run, "path string, language string, size long, content binary")
    return read.select(
        F.lit(rev).alias("rev"),
        "path",
        "language",
        "size",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.concat_ws(":", "language", F.sha1("content")).alias("key"),
    )


def scan(spark: SparkSession, root: str, config: ScanConfig | None = None, cache: str | None = None) -> DataFrame:
    """Parse a tree into per-file records, re-using cached facts of unchanged contents."""
    sources = keep(read_sources(spark, root, config))
    return assemble(sources, extract_cached(sources, cache))
