"""Identity of a graph and its settings, and results stored under it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _content(df: DataFrame) -> tuple:
    """Row count and two independent sums of row hashes; the order of rows does not matter."""
    one = F.xxhash64(*df.columns).cast("decimal(38,0)")
    two = F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.sum(one), F.sum(two)).first())


def graph_fingerprint(files: DataFrame, edges: DataFrame, settings: object = None) -> str:
    """Digest of everything an analysis depends on, settings included."""
    inputs = files.select("rev", "id", "path", "loc", "n_exports", "n_functions", "n_classes")
    text = repr((STORED_FORM, _content(inputs), _content(edges.select("src", "dst")), settings))
    return hashlib.sha256(text.encode()).hexdigest()


# Goes into every digest; a change of what is stored needs another one.
STORED_FORM = 2


def _complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder was finished; Spark leaves a marker then."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def stored_result(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result in ``folder``, built and written there first if it is missing or half written."""
    if not _complete(spark, folder):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
