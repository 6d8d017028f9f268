"""Incremental re-scan: source texts that arrive as files are parsed once per content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from depweave.sources.cache import extract_cached

# What a producer writes for every changed file; the key names the language and the content.
SOURCE_ROW = T.StructType(
    [
        T.StructField("rev", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def rescan_stream(
    spark: SparkSession, incoming: str, facts: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Extract the facts of arriving texts into the facts folder, skipping contents found there.

    A batch that is run again after a failure finds its own facts and adds none, so the folder
    holds every content once.
    """
    texts = spark.readStream.schema(SOURCE_ROW).parquet(incoming)

    def absorb(batch: DataFrame, _: int) -> None:
        extract_cached(batch, facts)

    writer = texts.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
