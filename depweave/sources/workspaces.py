"""Packages of a repository: folders of scanned files that a workspace pattern names and that hold a manifest."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.config import read_object
from depweave.functions.globs import matches_any
from depweave.session import ship_package

MANIFEST = "package.json"
LIST_FILE = "pnpm-workspace.yaml"


def _listed(text: str) -> list[str]:
    """Entries of the ``packages`` list of a workspace file; quotes and comments are taken off."""
    found, inside = [], False
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].strip()
        if bare.startswith("- ") and inside:
            found.append(bare[2:].strip().strip("'\""))
        elif bare and not bare.startswith("#"):
            inside = bare == "packages:"
    return found


def stated_patterns(root: str) -> tuple[list[str], list[str]]:
    """Patterns of package folders, and of those left out (``!``), from both places that may state them."""
    stated = read_object(Path(root, MANIFEST)).get("workspaces")
    patterns = stated.get("packages") if isinstance(stated, dict) else stated
    patterns = [p for p in patterns if isinstance(p, str)] if isinstance(patterns, list) else []
    listed = Path(root, LIST_FILE)
    if listed.is_file():
        patterns += _listed(listed.read_text(encoding="utf-8", errors="replace"))
    clean = [p.strip().removeprefix("./").rstrip("/") for p in patterns]
    return [p for p in clean if p and p[0] != "!"], [p[1:].removeprefix("./") for p in clean if p[:1] == "!"]


def package_folders(files: DataFrame, root: str) -> DataFrame:
    """``package``: folders above the ``files(path)`` that match a pattern and hold a manifest.

    The folders come from the scan, so nothing is listed twice; tasks look for the manifests.
    """
    chosen, left_out = stated_patterns(root)
    ship_package(files.sparkSession)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nested = files.where(F.size(parts) > 1)
    folders = nested.select(F.explode(above).alias("package")).distinct()
    named = folders.where(matches_any(F.col("package"), chosen) & ~matches_any(F.col("package"), left_out))

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[os.path.isfile(os.path.join(root, p, MANIFEST)) for p in batch["package"]]]

    return named.mapInPandas(holding, "package string")


def package_frame(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in folders], "package string")
