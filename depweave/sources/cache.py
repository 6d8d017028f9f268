"""Cache of extracted facts, keyed by the content of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from depweave.schema import FACTS
from depweave.session import cut
from depweave.sources.extract import extract_facts

# Raised whenever extraction changes, so that old facts are not used.
FACTS_VERSION = 1


def load_facts(spark, folder: str) -> DataFrame | None:
    """Facts stored so far; a content that two scans stored at once counts once."""
    try:
        return spark.read.schema(FACTS).parquet(f"{folder}/v{FACTS_VERSION}").dropDuplicates(["key"])
    except AnalysisException:
        return None


def extract_cached(sources: DataFrame, folder: str | None = None) -> DataFrame:
    """Facts of ``sources(language, text, key)``; each distinct key is parsed once.

    A key names a language and a content, so it is equal for files with equal facts.

    With a folder, contents found there are not parsed again, and the facts that were missing are
    appended to it.
    """
    spark = sources.sparkSession
    texts = sources.select("key", "language", "text").dropDuplicates(["key"])
    if folder is None:
        return extract_facts(texts)
    known = load_facts(spark, folder)
    if known is None:
        fresh = cut(extract_facts(texts))
        fresh.write.mode("append").parquet(f"{folder}/v{FACTS_VERSION}")
        return fresh
    fresh = cut(extract_facts(texts.join(known.select("key"), "key", "left_anti")))
    hits = known.join(texts.select("key"), "key", "left_semi")
    merged = cut(hits.unionByName(fresh))
    fresh.write.mode("append").parquet(f"{folder}/v{FACTS_VERSION}")
    return merged


def prune(spark, folder: str, live: DataFrame) -> None:
    """Keep only the facts of contents in ``live(key)``."""
    known = load_facts(spark, folder)
    if known is not None:
        kept = cut(known.join(live.select("key").distinct(), "key", "left_semi"))
        kept.write.mode("overwrite").parquet(f"{folder}/v{FACTS_VERSION}")
