"""The registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depweave.llm import (
    chat,
    decontaminate,
    infill,
    mixing,
    neighbours,
    ngram_join,
    quality_model,
    quality_rules,
    secrets,
    spelling,
    substring,
    token_files,
    urls,
)
from depweave.llm.common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def documents(operator):
        return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))

    return {
        "op1_secret_scan": documents(secrets.digest),
        "op2_substring_dedup": documents(substring.digest),
        "op3_quality_classifier": lambda spark, sf_dir: quality_model.digest(
            read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
        ),
        "op4_decontamination": lambda spark, sf_dir: decontaminate.digest(
            read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
        ),
        "op5_source_mixing": documents(mixing.digest),
        "op6_url_filter": lambda spark, sf_dir: urls.digest(read(spark, sf_dir, "pages")),
        "op7_chat_formatting": lambda spark, sf_dir: chat.digest(read(spark, sf_dir, "conversations")),
        "op8_quality_rules": documents(quality_rules.digest),
        "op9_ngram_jaccard_join": documents(ngram_join.digest),
        "op10_token_files": documents(token_files.digest),
        "op11_fill_in_middle": documents(infill.digest),
        "op12_nearest_neighbours": lambda spark, sf_dir: neighbours.nearest(read(spark, sf_dir, "embeddings")),
        "op13_spelling_variants": documents(spelling.digest),
    }
